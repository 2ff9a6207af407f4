"""Queries that no SQL expresses, over all rows of the smallest tables, against plain Python that shares nothing with them but fixed values."""

import hashlib
import json
import math
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions import text as T
from palimpsest.functions.scripts import LATIN
from palimpsest.operators import formatting, layout, lines, noise, shaping
from palimpsest.plans import page_queries, pair_queries

SF = "/root/testdata/sf0.001"
LETTER = re.compile("[A-Za-zÀ-ɏ]")


def draw(seed, *key):
    return int(hashlib.md5("|".join(map(str, (seed, *key))).encode()).hexdigest()[:8], 16) / 4294967296.0


def noisy(text, key, rate, seed):
    """Errors at the letters of the lowest draws, from the last to the first, so that places before stay."""
    source = list(text)
    places = [i for i, x in enumerate(source) if LETTER.match(x)]
    if not places:
        return text
    hit = set()
    if len(places) >= 10 and draw(seed, key, "burst") < 0.30:
        width = 15 + math.floor(draw(seed, key, "width") * 11)
        start = math.floor(draw(seed, key, "start") * (max(0, len(places) - width) + 1))
        patch = places[start : start + width]
        hit |= set(sorted(patch, key=lambda i: (draw(seed, key, i, "burst"), i))[: max(2, int(len(patch) * rate * 3))])
    rest = [i for i in places if i not in hit]
    hit |= set(sorted(rest, key=lambda i: (draw(seed, key, i, "plain"), i))[: max(1, int(len(places) * rate))])
    for i in sorted(hit, reverse=True):
        kind, own = draw(seed, key, i, "type"), source[i]
        if kind < 0.75:
            options = pair_queries.LATIN_CONFUSIONS.get(own)
            if options:
                source[i] = options[math.floor(draw(seed, key, i, "which") * len(options))]
        elif kind < 0.87:
            if i + 1 < len(source):
                source[i], source[i + 1] = source[i + 1], own
        elif kind < 0.95:
            del source[i]
        else:
            source.insert(i, own)
    return "".join(source)


def tagged(text, key, seed):
    source = list(text)
    places = [i for i, x in enumerate(source) if LETTER.match(x)]
    if not places:
        return text
    count = 1 + math.floor(draw(seed, key, "tags") * min(3, max(1, len(places) // 50)))
    for i in sorted(sorted(places, key=lambda i: (draw(seed, key, i, "tag"), i))[:count], reverse=True):
        tag = noise.LEAK_TAGS[math.floor(draw(seed, key, i, "name") * 3)]
        # The next place may hold what an earlier tag, further right, made of it; a pair of letters is wrapped only where both are bare.
        more = draw(seed, key, i, "two") < 0.3 and i + 1 < len(source) and len(source[i + 1]) == 1 and LETTER.match(source[i + 1])
        inner = "".join(source[i : i + 1 + bool(more)])
        source[i : i + 1 + bool(more)] = [f"<{tag}>{inner}</{tag}>"]
    return "".join(source)


@pytest.fixture(scope="module")
def turns(spark):
    return pair_queries.turns(spark, SF).collect()


def test_noise_register(spark, turns):
    got = {r.key: r.text for r in catalog.QUERIES["noise_register"](spark, SF).collect()}
    assert got == {r.key: None if r.text is None or noise.ERROR_RATES.get(r.source) is None and LETTER.search(r.text) else noisy(r.text, r.key, noise.ERROR_RATES.get(r.source, 0), 42) for r in turns}
    assert sum(got[r.key] != r.text for r in turns) > len(turns) / 2


def test_inject_tags(spark, turns):
    got = {r.key: r.text for r in catalog.QUERIES["inject_tags"](spark, SF).collect()}
    assert got == {r.key: tagged(r.text, r.key, 42) for r in turns}


def test_training_pairs(spark):
    pieces = pair_queries.turns(spark, SF).select("key", "source", F.posexplode(shaping.pack(F.col("text"))).alias("n", "text")).collect()
    want = {}
    for r in pieces:
        key, out = f"{r.key}-{r.n}", r.text
        for s in range(4200, 4205):
            if out == r.text:
                out = noisy(r.text, key, noise.ERROR_RATES.get(r.source, 0.05), s)
        want[key] = tagged(out, key, 42) if draw(42, key, "inject") < noise.INJECT_RATES.get(r.source, 0.07) else out
    got = {r.key: (r.input, r.target) for r in pair_queries.made_pairs(spark, SF).select("key", "input", "target").collect()}
    assert {k: v[0] for k, v in got.items()} == want and {k: v[1] for k, v in got.items()} == {f"{r.key}-{r.n}": r.text for r in pieces}
    kept = {r.key: r.input for r in catalog.QUERIES["training_pairs"](spark, SF).select("key", "input").collect()}
    assert kept and all(want[k] == v for k, v in kept.items())


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
    return row[-1]


def test_error_rates(spark):
    clean = pair_queries.turns(spark, SF).where("text <> ''")
    form = lambda t: unicodedata.normalize("NFC", t)
    both = [(r.key, form(r.p), form(r.r)) for r in clean.select("key", noise.corrupt(F.col("text"), F.col("key")).alias("p"), F.col("text").alias("r")).collect()]
    scored = spark.createDataFrame(both, "key string, p string, r string").select("key", T.metric_text(F.col("p")).alias("p"), T.metric_text(F.col("r")).alias("r")).collect()
    got = {r.key: (r.cer, r.wer) for r in catalog.QUERIES["cer_wer"](spark, SF).collect()}
    assert len(got) == len(scored) > 50
    for r in scored:
        words = r.r.split()
        want = (distance(r.p, r.r) / len(r.r) if r.r else None, distance(r.p.split(), words) / len(words) if words else None)
        assert got[r.key] == want, r.key


# ---------------------------------------------------------------- pages


def ordered(boxes, slack=0):
    """Reading order by trying every edge as a cut: the first upright cut within the middle 70 %, else the first level one, else top to bottom."""
    if len(boxes) < 2:
        return [n for n, _ in boxes]
    left, right = min(b[0] for _, b in boxes), max(b[2] for _, b in boxes)
    for x in sorted({e for _, b in boxes for e in (b[0], b[2])}):
        crossed = [n for n, b in boxes if b[0] + slack < x < b[2] - slack]
        before, after = [(n, b) for n, b in boxes if b[2] <= x], [(n, b) for n, b in boxes if b[2] > x and b[0] >= x]
        if left + 0.15 * (right - left) < x < right - 0.15 * (right - left) and not crossed and before and after:
            across = [(n, b) for n, b in boxes if b[0] < x < b[2]]
            top = lambda part: sorted(part, key=lambda p: p[1][1])
            return [n for n, _ in top(across)] + ordered(top(before), slack) + ordered(top(after), slack)
    for y in sorted({e for _, b in boxes for e in (b[1], b[3])}):
        above, below = [p for p in boxes if p[1][3] <= y], [p for p in boxes if p[1][3] > y]
        if above and below and all(p[1][1] >= y for p in below):
            return ordered(above, slack) + ordered(below, slack)
    return [n for n, _ in sorted(boxes, key=lambda p: (p[1][1], p[1][0]))]


def test_reading_order(spark):
    pages = defaultdict(list)
    for r in page_queries.blocks(spark, SF).select("doc", "page", "block", "box.*").collect():
        pages[r.doc, r.page].append((r.block, (r.x0, r.y0, r.x1, r.y1)))
    got = {(r.doc, r.page, r.block): r["rank"] for r in catalog.QUERIES["reading_order"](spark, SF).collect()}
    want = {(*page, block): k for page, boxes in pages.items() for k, block in enumerate(ordered(sorted(boxes)))}
    assert got == want and len(pages) > 500
    two = {(r.doc, r.page, r.block): r["rank"] for r in layout.reading_order(page_queries.blocks(spark, SF), F.lit(2)).select("doc", "page", "block", "rank").collect()}
    assert two == {(*page, block): k for page, boxes in pages.items() for k, block in enumerate(ordered(sorted(boxes), 15))}


def test_page_accessors(spark):
    pages = defaultdict(list)
    for r in page_queries.read_blocks(spark, SF).select("doc", "page", "block", "label", "box.*", "confidence", "text").collect():
        pages[r.doc, r.page].append(r)
    got = catalog.QUERIES["page_accessors"](spark, SF).collect()
    assert {(r.doc, r.page) for r in got} == set(pages)
    even = lambda x: int(round(x))  # noqa: E731  to the even one of two
    for r in got:
        rows = sorted(pages[r.doc, r.page], key=lambda b: b.block)
        by_number = {b.block: b for b in rows}
        order = ordered([(b.block, (b.x0, b.y0, b.x1, b.y1)) for b in rows if b.label != "Picture"])
        assert [(b.block, b.label) for b in r.text_blocks] == [(n, by_number[n].label) for n in order]
        said = [(by_number[n].text.strip(), by_number[n].label) for n in order]
        assert r.body_text == "\n\n".join(f"\n{t}\n" if x in ("SectionHeader", "PageHeader") else t for t, x in said if t).strip()
        assert json.loads(r.layout) == {"page_num": r.page, "image_size": [600, 800], "fallback": False, "blocks": [
            {"position": b.block, "label": b.label, "bbox": [even(b.x0), even(b.y0), even(b.x1), even(b.y1)], "confidence": round(b.confidence, 4), "is_header": b.label in ("SectionHeader", "PageHeader"), "is_skip": b.label == "Picture", "ocr_text": b.text} for b in rows
        ]}


def test_reconstruct_page(spark):
    blocks, of_page = defaultdict(list), defaultdict(list)
    for r in page_queries.blocks(spark, SF).select("doc", "page", "block", "label", "box.*").collect():
        blocks[r.doc, r.page].append((r.block, (r.x0, r.y0, r.x1, r.y1), r.label))
    for r in page_queries.ocr_lines(spark, SF).collect():
        of_page[r.doc, r.page].append(r)

    def share(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        size = max(0, a[2] - a[0]) * max(0, a[3] - a[1])
        return max(0, w) * max(0, h) / size if size else 0

    want = {}
    for page, rows in of_page.items():
        found, texts = sorted(blocks[page]), {}
        for r in sorted(rows, key=lambda r: r.line_no):
            if not r.text.strip():
                continue
            box = r.box and (r.box.x0, r.box.y0, r.box.x1, r.box.y1)
            best = max(found, key=lambda b: (share(box, b[1]), -b[0])) if box and found else None
            if not box and found:
                best = found[0]
            elif best and share(box, best[1]) <= 0.5:
                best = None
            if best:
                texts.setdefault((best[0], best[1], best[2]), []).append(r.text.strip())
            else:
                texts[1_000_000 + r.line_no, box or (0.0, float(r.line_no), 1.0, r.line_no + 0.5), None] = [r.text.strip()]
        shown = {k: "\n".join(v) for k, v in texts.items() if k[2] not in ("Picture", "Figure", "Table", "Equation", "PageFooter")}
        names = {k[0]: v for k, v in shown.items()}
        if names:  # no line of these tables is a page label
            want[page] = "\n\n".join(names[n] for n in ordered(sorted((k[0], k[1]) for k in shown))).strip()
    got = {(r.doc, r.page): r.text for r in catalog.QUERIES["reconstruct_page"](spark, SF).collect()}
    assert got == want and len(got) > 500


def test_format_document(spark):
    """The parts that have SQL of their own (artifacts, merging, blank runs) are taken as they are; what stands between them is done again."""
    source = page_queries.pages(spark, SF)
    rows = source.select("doc", "page", "text", T.strip_artifacts(F.col("text")).alias("plain")).collect()
    digits = re.compile(r"^\W*(?:\d+|[ivxlcdm]+)\W*$", re.I)
    numeral = {x: y for x, y in spark.createDataFrame([(x,) for x in {line.strip() for r in rows for line in (r.text or "").split("\n") + r.plain.split("\n")}], "x string").select("x", T.is_numeral_line(F.col("x"))).collect()}
    assert any(numeral.values()) or not any(digits.match(x) for x in numeral)
    pages, heads, numbers = defaultdict(dict), {}, {}
    for r in rows:
        lines_ = r.plain.split("\n")
        kept = [x for k, x in enumerate(lines_) if not ((k < 3 or k >= len(lines_) - 3) and numeral[x.strip()])]
        filled = [x.strip() for x in r.text.split("\n") if x.strip()]
        scan = filled[:5] + filled[-5:][::-1] if len(filled) > 5 else filled
        numbers[r.doc, r.page] = next((x for x in scan if numeral[x]), "")
        pages[r.doc][r.page] = "\n".join(kept)
    for doc, of in pages.items():
        seen = defaultdict(int)
        for text in of.values():
            filled = [x.strip() for x in text.split("\n") if x.strip()]
            for x in {*filled[:3], *filled[-3:]}:
                seen[x] += 1
        heads[doc] = {x for x, n in seen.items() if len(of) >= 3 and n >= max(2, int(len(of) * 0.35)) and len(x) < 50 and not (len(x) > 30 and re.search("[஀-௿]", x))} | {doc}
    stripped = []
    for doc, of in pages.items():
        for page, text in of.items():
            lines_ = text.split("\n")
            filled = [k for k, x in enumerate(lines_) if x.strip()]
            edge = {*filled[:4], *filled[-4:]}
            stripped.append((doc, page, text if page == 1 else "\n".join(x for k, x in enumerate(lines_) if not (k in edge and x.strip() in heads[doc]))))
    merged = {(r.doc, r.page): r.body for r in spark.createDataFrame(stripped, "doc string, page long, text string").select("doc", "page", T.strip(lines.merge_short_lines(F.col("text"))).alias("body")).collect()}
    line, whole = "=" * 60, []
    for doc, of in pages.items():
        sections = [f"\n{line}\nPAGE {page}{'  [' + numbers[doc, page] + ']' if numbers[doc, page] else ''}\n{line}\n{merged[doc, page]}" for page in sorted(of) if merged[doc, page]]
        whole.append((doc, f"{line}\nTamil OCR Output — {doc}\nPages processed: {len(of)}\n{line}\n" + "\n".join(sections)))
    want = {r.doc: r.text for r in spark.createDataFrame(whole, "doc string, text string").select("doc", lines.collapse_blank_lines(F.col("text")).alias("text")).collect()}
    assert {r.doc: r.text for r in formatting.format_document(source).collect()} == want == {r.doc: r.text for r in catalog.QUERIES["format_document"](spark, SF).collect()} and want


def test_letters_are_the_profiles():
    assert re.fullmatch(r"\[A-Za-z.*\]", LETTER.pattern) and LATIN.letters == r"A-Za-z\x{00C0}-\x{024F}"
