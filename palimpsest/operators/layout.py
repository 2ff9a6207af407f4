"""Page layout: lines and blocks with boxes, reading order, page reconstruction.

Boxes are struct<x0, y0, x1, y1>. Everything happens within a page, so pages are the unit of parallel work, and a page
is small: its rows are gathered once, and only the recursive cut runs as an Arrow-batched function on arrays, row by row of
the page table, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scripts import TAMIL, ScriptProfile

#: Label groups; fixed values.
TEXT_LABELS = ["Text", "SectionHeader", "Caption", "ListItem", "Footnote", "TableOfContents", "Form", "Code"]
HEADER_LABELS = ["SectionHeader", "PageHeader"]
SKIP_LABELS = ["Picture", "Figure", "Table", "Equation"]
STRUCTURAL_LABELS = ["PageHeader", "PageFooter"]
MIN_CONFIDENCE, MIN_OVERLAP, SAME_BLOCK, SAME_BLOCK_COLUMNS = 0.30, 0.50, 0.70, 0.60

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return width * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(F.lit(0.0))


def crop(box: Column, width: Column, height: Column, pad: int = 4) -> Column:
    return F.struct(
        F.greatest(F.lit(0), F.floor(box["x0"]) - pad).alias("x0"), F.greatest(F.lit(0), F.floor(box["y0"]) - pad).alias("y0"),
        F.least(width, F.floor(box["x1"]) + pad).alias("x1"), F.least(height, F.floor(box["y1"]) + pad).alias("y1"),
    )


def usable_blocks(blocks: DataFrame) -> DataFrame:
    """Confident blocks; a page without any text block becomes one full-page text block (``fallback``)."""
    page = ["doc", "page"]
    good = blocks.withColumn("ok", F.col("confidence") >= MIN_CONFIDENCE)
    has_text = good.groupBy(*page, "width", "height").agg(F.coalesce(F.bool_or(F.col("ok") & F.col("label").isin(TEXT_LABELS)), F.lit(False)).alias("has_text"))
    kept = good.where("ok").drop("ok").join(has_text.where("has_text").select(*page), page, "left_semi").withColumn("fallback", F.lit(False))
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").cast("double").alias("x1"), F.col("height").cast("double").alias("y1"))
    full = has_text.where("not has_text").select(
        *page, F.lit(0).alias("block"), F.lit("Text").alias("label"), whole.alias("box"), F.lit(1.0).alias("confidence"), "width", "height", F.lit(True).alias("fallback")
    )
    return kept.select(*full.columns).unionByName(full)


def assign_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, page, line_no, block): the block that covers most of each line, the first of equals, if it covers more than half.

    Lines without a box go to the page's first block. A page's blocks are gathered into one array per page, so the lines join
    once and no line is multiplied.
    """
    page = ["doc", "page"]
    per_page = by_page(blocks, "box").withColumnRenamed("rows", "blocks")
    joined = lines.where(T.strip(F.col("text")) != "").join(per_page, page, "left")
    return joined.select(*page, "line_no", block_of(F.col("blocks"), F.col("box")).alias("block"))


def block_of(blocks: Column, box: Column) -> Column:
    """The number of the block of a page's (sorted by number) to which a line of that box belongs."""
    share = lambda b: F.when(area(box) > 0, overlap(box, b["box"]) / area(box)).otherwise(F.lit(0.0))
    start = F.struct(F.lit(0.0).cast("double").alias("share"), F.lit(None).cast("int").alias("block"))
    better = lambda acc, b: T.let(share(b), lambda s: F.when(s > acc["share"], F.struct(s.alias("share"), b["block"].cast("int").alias("block"))).otherwise(acc))
    best = lambda acc: F.when(acc["share"] > MIN_OVERLAP, acc["block"])
    return F.when(box.isNull(), F.get(blocks, F.lit(0))["block"].cast("int")).otherwise(F.aggregate(blocks, start, better, best))


def same_block(columns: int) -> float:
    """The overlap beyond which two blocks are one; pages of several columns bear less."""
    return SAME_BLOCK_COLUMNS if columns > 1 else SAME_BLOCK


def by_page(blocks: DataFrame, *others: str) -> DataFrame:
    """(doc, page, rows): a page's blocks with all their columns (or block and ``others``), sorted by number."""
    columns = others or [c for c in blocks.columns if c not in ("doc", "page", "block")]
    return blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("rows"))


def suppress_duplicates(blocks: DataFrame, threshold: float = SAME_BLOCK) -> DataFrame:
    """The blocks that greedy suppression keeps: by falling confidence, none that overlaps a kept one too much."""
    per_page = by_page(blocks, "confidence", *[c for c in blocks.columns if c not in ("doc", "page", "block", "confidence")])
    row = per_page.schema["rows"].dataType.elementType.simpleString()
    # Rows come by number; the place of equal confidences follows it.
    ranked = F.transform(F.array_sort(F.transform("rows", lambda r, i: F.struct((-r["confidence"]).alias("c"), i.alias("i"), r.alias("r")))), lambda x: x["r"])
    kept = F.aggregate(ranked, F.array().cast(f"array<{row}>"), lambda acc, b: F.when(F.exists(acc, lambda k: iou(b["box"], k["box"]) > threshold), acc).otherwise(F.concat(acc, F.array(b))))
    return per_page.select("doc", "page", F.inline(kept)).select(*blocks.columns)


def cut_order(boxes: list[tuple[float, float, float, float]], columns: int = 1) -> list[int]:
    """Reading order by recursive cuts: columns first, then bands, else from top to bottom.

    A box on a cut line counts once, and a cut that puts all boxes on one side is none, so the recursion ends.
    """
    slack = 15 if columns > 1 else 0
    x0, y0, x1, y1 = zip(*boxes, strict=True) if boxes else ((),) * 4

    def vertical(group: list[int]) -> tuple[list[int], list[int], list[int]] | None:
        sides = [(x0[i], x1[i]) for i in group]
        left, right = min(a for a, _ in sides), max(b for _, b in sides)
        margin = (right - left) * 0.15
        for x in sorted({v for side in sides for v in side if left + margin < v < right - margin}):
            for a, b in sides:
                if a + slack < x < b - slack:
                    break
            else:
                before = [i for i in group if x1[i] <= x]
                after = [i for i in group if x0[i] >= x and x1[i] > x]
                if before and after:
                    cut = {*before, *after}
                    return [i for i in group if i not in cut], before, after
        return None

    def horizontal(group: list[int]) -> tuple[list[int], list[int]] | None:
        sides = [(y0[i], y1[i]) for i in group]
        for y in sorted({v for side in sides for v in side}):
            for a, b in sides:
                if a < y < b:
                    break
            else:
                above, below = [i for i in group if y1[i] <= y], [i for i in group if not y1[i] <= y]
                if above and below:
                    return above, below
        return None

    def read(group: list[int]) -> list[int]:
        if len(group) < 2:
            return group
        by_top = lambda part: sorted(part, key=lambda i: boxes[i][1])
        if cut := vertical(group):
            across, before, after = cut
            return by_top(across) + read(by_top(before)) + read(by_top(after))
        if cut := horizontal(group):
            return read(cut[0]) + read(cut[1])
        return sorted(group, key=lambda i: (boxes[i][1], boxes[i][0]))

    return read(list(range(len(boxes))))


def _reading_ranks(pages: pa.Array, columns: pa.Array) -> pa.Array:
    offsets = pages.offsets.to_numpy()
    ends = (offsets - offsets[0]).tolist()
    flat = list(zip(*[x.to_pylist() for x in pages.flatten().flatten()], strict=True))
    ranks = np.zeros(len(flat), np.int32)
    for start, end, n in zip(ends, ends[1:], columns.to_pylist(), strict=False):
        if end - start > 1:
            for rank, i in enumerate(cut_order(flat[start:end], n)):
                ranks[start + i] = rank
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ranks))


def reading_ranks(boxes: Column, columns: Column) -> Column:
    """For each box of a page, its place in reading order, from 0; no page is null."""
    return F.arrow_udf(_reading_ranks, "array<int>")(boxes, columns.cast("int"))


def reading_order(blocks: DataFrame, columns: Column | None = None) -> DataFrame:
    """``blocks`` (doc, page, block, box) with ``rank``, the place in reading order."""
    others = [c for c in blocks.columns if c not in ("doc", "page", "block")]
    ranked = by_page(blocks, *others).withColumn("ranks", reading_ranks(F.transform("rows", lambda r: r["box"]), columns if columns is not None else F.lit(1)))
    flat = ranked.select("doc", "page", F.explode(F.arrays_zip("rows", "ranks")).alias("z"))
    return flat.select("doc", "page", "z.rows.*", F.col("z.ranks").alias("rank"))


def reconstruct(lines: DataFrame, blocks: DataFrame, columns: int = 1) -> DataFrame:
    """(doc, page, text): block texts and stray lines in the reading order of so many columns.

    Footers, page labels in headers and the contents of pictures go; a fallback page is its lines. Lines and blocks meet once, by page.
    """
    page = ["doc", "page"]
    said = lines.where(T.strip(F.col("text")) != "")
    of_page = said.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("line_no", T.strip(F.col("text")).alias("t"), "box", F.trim("text").alias("stray")))).alias("said"))
    both = of_page.join(by_page(blocks, "box", "label").withColumnRenamed("rows", "blocks"), page, "left")
    placed = F.transform("said", lambda s: F.struct(s.alias("line"), block_of(F.col("blocks"), s["box"]).alias("block")))

    def chunk(b: Column, lines: Column) -> Column:
        own = F.filter(lines, lambda s: s["block"] == b["block"])
        text = F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda s: s["line"]["t"]), "\n"))
        return T.let(text, lambda t: F.struct(b["block"].cast("long").alias("block"), b["box"].alias("box"), t.alias("text"), b["label"].alias("label")))

    def shown(x: Column) -> Column:
        return x["text"].isNotNull() & (~x["label"].isin([*SKIP_LABELS, *STRUCTURAL_LABELS]) | (x["label"] == "PageHeader") & ~T.is_page_label(x["text"]))

    def stray(s: Column) -> Column:
        # A stray line without a box, on a page without blocks, stands where its number puts it.
        number, row = s["line"]["line_no"], s["line"]["line_no"].cast("double")
        at_number = F.struct(F.lit(0.0).alias("x0"), row.alias("y0"), F.lit(1.0).alias("x1"), (row + 0.5).alias("y1"))
        return F.struct((number + 1_000_000).cast("long").alias("block"), F.coalesce(s["line"]["box"], at_number).alias("box"), s["line"]["stray"].alias("text"))

    def pieces(lines: Column) -> Column:
        chunks = F.filter(F.transform(F.coalesce("blocks", F.array()), lambda b: chunk(b, lines)), shown)
        bare = F.transform(chunks, lambda x: F.struct(x["block"].alias("block"), x["box"].alias("box"), x["text"].alias("text")))
        return F.array_sort(F.concat(bare, F.transform(F.filter(lines, lambda s: s["block"].isNull()), stray)))

    rows = both.select(*page, T.let(placed, pieces).alias("rows"))
    ranked = rows.withColumn("ranks", reading_ranks(F.transform("rows", lambda r: r["box"]), F.lit(columns)))
    parts = F.array_sort(F.transform(F.arrays_zip("ranks", "rows"), lambda z: F.struct(z["ranks"].alias("rank"), z["rows"]["text"].alias("text"))))
    text = T.strip(F.array_join(F.transform(parts, lambda r: r["text"]), "\n\n"))
    return ranked.select(*page, F.explode(F.when(F.size("rows") > 0, F.array(text))).alias("text"))  # a page of which nothing is shown is no row


def page_accessors(blocks: DataFrame, columns: int = 1) -> DataFrame:
    """(doc, page, text_blocks, body_text, layout) of blocks (doc, page, block, label, box, confidence, width, height, text, fallback).

    text_blocks: the blocks that carry text, in reading order. body_text: their texts, blank ones left out, with a blank line between them and another
    around a heading. layout: the whole page as JSON, all blocks by number, boxes rounded to pixels. Blocks meet once, by page.
    """
    page, text = ["doc", "page"], T.strip(F.coalesce("text", F.lit("")))
    heading, skipped = F.col("label").isin(HEADER_LABELS), F.col("label").isin(SKIP_LABELS)
    said = F.when(text != "", F.when(heading, F.concat(F.lit("\n"), text, F.lit("\n"))).otherwise(text))
    edges = F.array(*[F.bround(F.col("box")[e], 0).cast("long") for e in ("x0", "y0", "x1", "y1")])
    told = F.struct(
        F.col("block").alias("position"), "label", edges.alias("bbox"), F.bround("confidence", 4).alias("confidence"), heading.alias("is_header"), skipped.alias("is_skip"),
        F.coalesce("text", F.lit("")).alias("ocr_text"),
    )
    rows = blocks.groupBy(*page).agg(
        F.array_sort(F.collect_list(F.struct(told.alias("told"), "box", said.alias("said")))).alias("rows"), F.max("width").alias("width"), F.max("height").alias("height"),
        F.coalesce(F.bool_or("fallback"), F.lit(False)).alias("fallback"),
    )
    shown = rows.withColumn("shown", F.filter("rows", lambda r: ~r["told"]["is_skip"]))
    ranked = shown.withColumn("ranks", reading_ranks(F.transform("shown", lambda r: r["box"]), F.lit(columns)))
    in_order = F.array_sort(F.transform(F.arrays_zip("ranks", "shown"), lambda z: F.struct(z["ranks"].alias("rank"), z["shown"]["told"].alias("told"), z["shown"]["said"].alias("said"))))
    ranked = ranked.select(*page, "width", "height", "fallback", F.transform("rows", lambda r: r["told"]).alias("blocks"), in_order.alias("shown"))
    whole = F.to_json(F.struct(F.col("page").alias("page_num"), F.array("width", "height").alias("image_size"), "fallback", "blocks"))
    body = T.strip(F.array_join(F.array_compact(F.transform("shown", lambda b: b["said"])), "\n\n"))
    carried = F.transform("shown", lambda b: F.struct(b["told"]["position"].alias("block"), b["told"]["label"].alias("label")))
    return ranked.select(*page, carried.alias("text_blocks"), body.alias("body_text"), whole.alias("layout"))


def split_spreads(pages: DataFrame, ratio: float = 1.3) -> DataFrame:
    """Pages wider than ``ratio`` times their height become two halves, and pages are numbered anew: doc, page, x0, x1, height."""
    half = F.floor(F.col("width") / 2).cast("int")
    span = lambda a, b: F.struct(a.cast("int").alias("x0"), b.cast("int").alias("x1"))
    whole = F.array(span(F.lit(0), F.col("width")))
    parts = F.when(F.col("width") > F.col("height") * ratio, F.array(span(F.lit(0), half), span(half, F.col("width")))).otherwise(whole)
    per_doc = pages.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", parts.alias("parts"), "height"))), lambda r: F.transform(r["parts"], lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1"), r["height"].alias("height"))))).alias("rows"))
    return per_doc.select("doc", F.posexplode("rows").alias("at", "r")).select("doc", (F.col("at") + 1).alias("page"), "r.x0", "r.x1", "r.height")


def page_confidence(lines: DataFrame) -> DataFrame:
    """(doc, page, confidence, n_lines): the mean over lines that have one, 0 without any."""
    return lines.groupBy("doc", "page").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.count("*").alias("n_lines"))


def needs_correction(confidence: Column, text: Column, threshold: float = 0.90) -> Column:
    """Low confidence or noise in more than three characters; an unknown confidence is not low."""
    return (F.coalesce(confidence < threshold, F.lit(False)) | T.is_noisy(text)) & (F.char_length(T.strip(text)) > 3)


def needs_review(mean_confidence: Column, n_scores: Column, columns: Column, n_lines: Column) -> Column:
    return (n_scores > 0) & ((mean_confidence < 0.80) | ((columns >= 3) & (n_lines < 10)))


def document_kind(images: Column, text_length: Column) -> Column:
    """What a page file is, from its embedded images and text."""
    return (
        F.when((images > 0) & (text_length < 50), "scan").when((images == 0) & (text_length > 50), "digital").when((images > 0) & (text_length > 50), "hybrid").otherwise("unknown")
    )


def region_extents(blocks: DataFrame) -> DataFrame:
    """(doc, page, x0, y0, x1, y1): the rectangle around all blocks of a page."""
    b = F.col("box")
    return blocks.groupBy("doc", "page").agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def wants_preprocessing(doc_type: Column) -> Column:
    """Only historical scans go through the preprocessing chain."""
    return F.coalesce(doc_type == "historical_scan", F.lit(False))


def quality_rates(pages: DataFrame, profile: ScriptProfile = TAMIL) -> DataFrame:
    """One row over page texts: shares of blank pages, of pages with characters of stray scripts, and the mean share of script characters."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rate = lambda c: F.avg(c.cast("int"))
    return pages.agg(
        rate(T.strip(t) == "").alias("blank_rate"), rate(t.rlike(f"[{profile.stray}]")).alias("stray_rate"), F.avg(T.let(t, lambda x: T.ratio(T.count_script(x, profile), x))).alias("script_ratio"),
    )
