"""Recognisers, correctors and reviewers are models: opaque functions behind one registry, run Arrow-batched."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import stores
from .layout import SKIP_LABELS, crop, needs_correction, wants_preprocessing
from .sampling import ranked

LINES = "doc string, page int, line_no int, text string, box struct<x0:double,y0:double,x1:double,y1:double>, confidence double, error string"

#: Text to image bytes, and image bytes and a seed to worse ones, by name.
_renderers: dict[str, tuple[Callable[[str], bytes], Callable[[bytes, int], bytes]]] = {}
_engines: dict[str, tuple[Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], int]] = {}


def register(name: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], pages_per_call: int = 1) -> None:
    """load: makes the engine, once per worker; the engine maps up to ``pages_per_call`` pages (doc, page, content) to rows of LINES."""
    if pages_per_call < 1:
        raise ValueError("an engine takes one page a call at least")
    _engines[name] = load, pages_per_call


def register_renderer(name: str, render: Callable[[str], bytes], degrade: Callable[[bytes, int], bytes]) -> None:
    _renderers[name] = render, degrade


def renderer(name: str) -> tuple[Callable[[str], bytes], Callable[[bytes, int], bytes]]:
    if name not in _renderers:
        raise ValueError(f"no renderer named {name!r}; there are {sorted(_renderers)}")
    return _renderers[name]


def create(name: str) -> tuple[Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], int]:
    if name not in _engines:
        raise ValueError(f"no engine named {name!r}; there are {sorted(_engines)}")
    return _engines[name]


def _failed(page: pd.DataFrame, error: Exception) -> pd.DataFrame:
    row = {"doc": page.doc.iloc[0], "page": page.page.iloc[0], "line_no": 0, "text": None, "box": None, "confidence": None, "error": f"[OCR ERROR: {error}]"}
    return pd.DataFrame([row])


def _silent(pages: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame | None:
    """A row without a line number for each page of which the engine says nothing."""
    seen = set(zip(found["doc"], found["page"], strict=True)) if len(found) else set()
    rows = [{"doc": d, "page": n, "line_no": None, "text": None, "box": None, "confidence": None, "error": None} for d, n in zip(pages["doc"], pages["page"], strict=True) if (d, n) not in seen]
    return pd.DataFrame(rows).astype({"line_no": "Int32"}) if rows else None


def _read(engine: Callable[[pd.DataFrame], pd.DataFrame], pages: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """What the engine makes of the pages in one call; a call that fails is made again on each half, until the bad page fails alone."""
    try:
        found = engine(pages.reset_index(drop=True)).assign(error=None)
        parts = [p for p in (found, _silent(pages, found)) if p is not None and len(p)]
    except Exception as e:  # a page's failure is its own; it is reported in its row
        if len(pages) == 1:
            yield _failed(pages, e)
        else:
            half = len(pages) // 2
            yield from _read(engine, pages.iloc[:half])
            yield from _read(engine, pages.iloc[half:])
    else:
        yield from parts


def recognise(pages: DataFrame, name: str, profile: ResourceProfile | None = None) -> DataFrame:
    """The lines of all pages, read in batches of the engine's size; a page that fails is one row with ``error`` and no text.

    profile: what the engine's stage asks of its executors, see :func:`.processes.residency`.
    """
    return read_pages(pages, name, profile).where("line_no is not null")


def recognised_once(pages: DataFrame, name: str, store: str, profile: ResourceProfile | None = None) -> DataFrame:
    """The same lines, and for a page without any a row without ``line_no``; a page that the engine has read into ``store`` before is not read again."""
    return stores.keyed(f"{store.rstrip('/')}/{name}", pages, ["doc", "page"], lambda todo: read_pages(todo, name, profile))


def read_pages(pages: DataFrame, name: str, profile: ResourceProfile | None = None) -> DataFrame:
    load, size = create(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, left = load(), None
        for batch in batches:
            left = batch if left is None or left.empty else pd.concat([left, batch])
            for k in range(0, len(left) - size + 1, size):
                yield from _read(engine, left.iloc[k : k + size])
            left = left.iloc[len(left) // size * size :]
        if left is not None and len(left):
            yield from _read(engine, left)

    return pages.mapInPandas(run, LINES, profile=profile)


def _contents(frame: DataFrame, change: Callable[[dict], bytes | None]) -> DataFrame:
    """``frame`` with its ``content`` changed by a function of the row; what it fails on stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: dict) -> bytes | None:
            try:
                return change(row)
            except Exception:
                return row["content"]  # a page that cannot be changed is read as it is

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # images are large
                part = batch.slice(lo, 64)
                at = part.schema.get_field_index("content")
                yield part.set_column(at, part.schema.field(at), pa.array([one(r) for r in part.to_pylist()], part.schema.field(at).type))

    return frame.mapInArrow(run, frame.schema)


def prepared(pages: DataFrame, routes: DataFrame, chain: Callable[[bytes], bytes]) -> DataFrame:
    """``pages`` (doc, page, content) in which those of documents that are historical scans, by ``routes`` (doc, doc_type), went through ``chain``; a page it fails on stays."""
    typed = pages.join(routes.select("doc", "doc_type"), "doc", "left")
    want = wants_preprocessing(F.col("doc_type"))
    plain = typed.where(~want).select(*pages.columns)
    return _contents(typed.where(want).select(*pages.columns), lambda row: chain(row["content"])).unionByName(plain)


def read_blocks(pages: DataFrame, blocks: DataFrame, cut: Callable[[bytes, tuple[int, int, int, int]], bytes], name: str, profile: ResourceProfile | None = None) -> DataFrame:
    """The lines of each block's part of its page, which ``cut`` takes out of the image; boxes and numbers are the page's.

    Blocks that carry no text are not read; a page without blocks is read whole. Lines are numbered within their block, a million numbers a block.
    """
    shown = blocks.where(~F.col("label").isin(SKIP_LABELS)).select("doc", "page", "block", crop(F.col("box"), F.col("width"), F.col("height")).alias("part"))
    skipped = blocks.select("doc", "page").distinct().withColumn("known", F.lit(True))
    parts = pages.join(shown, ["doc", "page"], "left").join(skipped, ["doc", "page"], "left").where("part is not null or known is null")
    cuts = _contents(
        parts.select("doc", "page", "block", "part", "content"),
        lambda row: cut(row["content"], tuple(int(row["part"][e]) for e in ("x0", "y0", "x1", "y1"))) if row["part"] else row["content"],
    )
    named = cuts.select(F.to_json(F.struct("doc", "page", "block", "part")).alias("doc"), F.lit(1).alias("page"), "content")
    found = read_pages(named, name, profile)
    of = F.from_json("doc", parts.select("doc", "page", "block", "part").schema)
    found = found.select(of.alias("of"), "line_no", "text", "box", "confidence", "error")
    moved = lambda axis, edge: F.col("box")[edge] + F.coalesce(F.col("of.part")[axis], F.lit(0)).cast("double")
    box = F.when(F.col("box").isNotNull(), F.struct(moved("x0", "x0").alias("x0"), moved("y0", "y0").alias("y0"), moved("x0", "x1").alias("x1"), moved("y0", "y1").alias("y1")))
    number = (F.coalesce("of.block", F.lit(0)) * 1_000_000 + F.col("line_no")).cast("int")
    return found.select("of.doc", F.col("of.page").cast("int").alias("page"), number.alias("line_no"), "text", box.alias("box"), "confidence", "error")


def correct(lines: DataFrame, model: Callable[[str], str], threshold: float = 0.90, profile: ResourceProfile | None = None) -> DataFrame:
    """Only lines that need it go through the model; the plan is split before it, for no filter passes a Python function.

    profile: what the model's stage asks of its executors, see :func:`.processes.residency`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(t: str | None) -> str | None:
            try:
                return t if t is None else model(t) if t.strip() else ""
            except Exception:
                return t  # a model's failure leaves the line as it was

        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([one(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    need = F.coalesce(needs_correction(F.col("confidence"), F.col("text"), threshold), F.lit(False))
    fixed = lines.where(need).mapInArrow(run, lines.schema, profile=profile)
    fixed = fixed.withColumn("text", T.strip_model_tags(F.col("text"))).withColumn("is_corrected", F.lit(True))
    return fixed.unionByName(lines.where(~need).withColumn("is_corrected", F.lit(False)))


def correct_pages(pages: DataFrame, model: Callable[[str], str], least: int = 3) -> DataFrame:
    """``pages`` with each line of their texts corrected by itself; lines under ``least`` characters, and lines the model fails on, stay."""

    def one(line: str) -> str:
        if len(line.strip()) < least:
            return line
        try:
            return model(line)
        except Exception:
            return line  # a model's failure leaves the line as it was

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "\n".join(map(one, t.split("\n"))), na_action="ignore")

    return pages.withColumn("text", apply("text"))


def corrected_once(lines: DataFrame, model: Callable[[str], str], store: str, threshold: float = 0.90, profile: ResourceProfile | None = None) -> DataFrame:
    """:func:`correct`, each page's lines once for a ``store``: another model wants another store."""
    return stores.keyed(f"{store.rstrip('/')}/corrected", lines, ["doc", "page"], lambda todo: correct(todo, model, threshold, profile))


def corrected_pages(lines: DataFrame) -> DataFrame:
    """(doc, page, lm_corrected): whether any line of the page was corrected."""
    return lines.groupBy("doc", "page").agg(F.coalesce(F.bool_or("is_corrected"), F.lit(False)).alias("lm_corrected"))


def read_back(texts: DataFrame, render: Callable[[str], bytes], degrade: Callable[[bytes, int], bytes], engine: str, seed: int = 42) -> DataFrame:
    """(key, input): each text (key, text) drawn as an image, degraded, and read by an engine; null where that failed."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = []
            for key, text in zip(batch.key, batch.text, strict=True):
                try:
                    images.append(degrade(render(text), zlib.crc32(f"{seed}|{key}".encode())))
                except Exception:
                    images.append(None)  # what cannot be drawn is not read
            yield pd.DataFrame({"doc": batch.key.astype(str), "page": 1, "content": images})

    pages = texts.select(F.col("key").cast("string").alias("key"), "text").mapInPandas(draw, "doc string, page int, content binary").where("content is not null")
    read = recognise(pages, engine).where("error is null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
    found = read.select(F.col("doc").alias("key"), T.strip(F.array_join(F.transform("rows", lambda r: r["text"]), " ")).alias("input"))
    return texts.select(F.col("key").cast("string").alias("key")).join(found, "key", "left")


#: Texts of a step at least; attempts that a wanted pair may cost.
STEP, ATTEMPTS = 64, 25


def round_trip(
    texts: DataFrame, render: Callable[[str], bytes], degrade: Callable[[bytes, int], bytes], engine: str, n: int, least_edits: int = 2, seed: int = 42, done: DataFrame | None = None,
    store: str | None = None, step: int = STEP, attempts: int | None = None,
) -> DataFrame:
    """(key, input, target, source): n of the texts (key, text) drawn as images, degraded, and read by an engine.

    Texts go in seeded order, step by step: a step takes as many as pairs are missing, ``step`` at least, so an engine is called for no more
    than one step beyond the last pair. Each step's outcome, failures too, is a table of its own below ``store``; a run that was stopped goes on behind its
    last whole step and reads no key of an earlier one again. It ends with n pairs, or as an error when the texts or the attempts (25 a pair) are
    spent. Texts that are blank or ``done`` already are left out; pairs of fewer edits, and what fails, count as attempts.
    """
    spark = texts.sparkSession
    store = (store or stores.new_folder(spark, "round-trip")).rstrip("/")
    limit = n * ATTEMPTS if attempts is None else attempts

    def ordered() -> DataFrame:
        left = texts if done is None else texts.join(done.select("key").distinct(), "key", "left_anti")
        plain = left.select(F.col("key").cast("string").alias("key"), T.strip(F.col("text")).alias("text")).where("text <> ''").dropDuplicates(["key"])
        return ranked(plain, seed, "key").repartitionByRange("rank").sortWithinPartitions("rank")  # so a step reads its own row groups

    order = stores.once(f"{store}/order", ordered, spark)
    steps = stores.numbered(spark, f"{store}/steps")
    total, tried, good = order.count(), 0, 0
    if steps:
        tried, good = tuple(stores.read_steps(spark, f"{store}/steps", steps).agg(F.max("rank"), F.count_if("differs")).first())
    while good < n and tried < min(total, limit):
        size = min(max(n - good, step), min(total, limit) - tried)
        rows = order.where(F.col("rank").between(tried + 1, tried + size))
        read = read_back(rows.select("key", "text"), render, degrade, engine, seed).join(rows, "key")
        differs = F.coalesce((F.col("input") != "") & T.edits_at_least(F.col("input"), F.col("text"), least_edits), F.lit(False))
        steps.append(steps[-1] + 1 if steps else 0)
        read.select("key", "rank", "input", "text", differs.alias("differs")).write.mode("overwrite").parquet(f"{store}/steps/step={steps[-1]}")
        tried += size
        good += stores.read_steps(spark, f"{store}/steps", steps[-1:]).where("differs").count()
    if good < n:
        raise ValueError(f"{good} of {n} pairs after {tried} attempts")
    made = stores.read_steps(spark, f"{store}/steps", steps).where("differs")
    if good > n:  # the last steps hold a few too many: those of the highest ranks go
        made = made.join(made.orderBy(F.desc("rank")).limit(good - n).select("rank"), "rank", "left_anti")
    return made.select("key", "input", F.col("text").alias("target"), F.lit(f"roundtrip_{engine}").alias("source"))
