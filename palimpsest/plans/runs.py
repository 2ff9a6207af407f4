"""Whole runs made of operators: pages to documents, with or without reviewing models, and corpora to training sets."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..functions.scripts import TAMIL, ScriptProfile
from ..operators import corpus, formatting, layout, lines, metrics, noise, pairs, processes, recognition, sampling, shaping
from ..sources import listings, readers, stores, writers

Model = Callable[[str], str]


def _call(model: Model, default: str):
    """A model as an Arrow-batched function; a call that fails gives the default."""

    def apply(prompts: pd.Series) -> pd.Series:
        def one(p):
            try:
                return model(p)
            except Exception:
                return default  # a model's failure must not lose the document

        return prompts.map(one, na_action="ignore")

    return lambda c: F.pandas_udf(apply, "string")(c)


def page_results(recognised: DataFrame, blocks: DataFrame, profile: ScriptProfile = TAMIL, columns: int = 1) -> DataFrame:
    """(doc, page, confidence, n_lines, fallback, text) from recognised lines and layout blocks of pages of so many columns; texts are cleaned line by line."""
    usable = layout.usable_blocks(blocks)
    kept = layout.suppress_duplicates(usable, layout.same_block(columns))
    text = layout.reconstruct(recognised, kept, columns).withColumn("text", T.post_clean(F.col("text"), profile))
    fallback = usable.groupBy("doc", "page").agg(F.bool_or("fallback").alias("fallback"))
    scored = layout.page_confidence(recognised).withColumn("confidence", F.bround("confidence", 4))
    return scored.join(fallback, ["doc", "page"], "left").join(text, ["doc", "page"], "left").select(
        "doc", "page", "confidence", "n_lines", F.coalesce("fallback", F.lit(True)).alias("fallback"), F.coalesce("text", F.lit("")).alias("text")
    )


def read_once(pages: DataFrame, engine: str, store: str | None = None) -> DataFrame:
    """The lines of ``pages``, in a store, so that whatever reads them twice calls the engine once a page; the same store, given again, calls it for new pages only."""
    spark = pages.sparkSession
    return recognition.recognised_once(pages, engine, store or stores.new_folder(spark, "recognised"), processes.residency(spark))


def batch_run(
    pages: DataFrame, engine: str, blocks: DataFrame, corrector: Model | None = None, profile: ScriptProfile = TAMIL, columns: int = 1, store: str | None = None,
    routes: DataFrame | None = None, preprocess: Callable[[bytes], bytes] | None = None, cut: Callable[[bytes, tuple[int, int, int, int]], bytes] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Page results, with ``engine`` and ``lm_corrected``, and formatted documents of (doc, page, content) pages; models are called once a page, see :func:`read_once`.

    With ``routes`` (doc, doc_type), pages of historical scans go through ``preprocess`` first; with ``cut`` the engine reads each block's part of the image by itself.
    """
    spark = pages.sparkSession
    store = store or stores.new_folder(spark, "recognised")
    if routes is not None and preprocess is not None:
        pages = recognition.prepared(pages, routes, preprocess)
    if cut is None:
        read = read_once(pages, engine, store)
    else:
        usable = layout.usable_blocks(blocks)
        read = stores.keyed(f"{store}/{engine}-blocks", pages, ["doc", "page"], lambda todo: recognition.read_blocks(todo, usable, cut, engine, processes.residency(spark)))
    found = read.where("error is null and line_no is not null")
    found = recognition.corrected_once(found, corrector, f"{store}/{engine}-lines", profile=processes.residency(spark)) if corrector else found.withColumn("is_corrected", F.lit(False))
    results = page_results(found, blocks, profile, columns).join(recognition.corrected_pages(found), ["doc", "page"]).withColumn("engine", F.lit(engine))
    return results, formatting.format_document(results.select("doc", "page", "text"))


def compared_run(pages: DataFrame, engines: tuple[str, str], blocks: DataFrame, profile: ScriptProfile = TAMIL, store: str | None = None) -> DataFrame:
    """The pages of two engines side by side, as :func:`..operators.metrics.compare_engines` gives them."""
    store = store or stores.new_folder(pages.sparkSession, "recognised")
    return metrics.compare_engines(*(page_results(read_once(pages, name, store).where("error is null and line_no is not null"), blocks, profile) for name in engines))


def web_run(
    pages: DataFrame, engine: str, blocks: DataFrame, references: DataFrame | None = None, languages: str = "ta, en", profile: ScriptProfile = TAMIL, store: str | None = None
) -> DataFrame:
    """(doc, text, cer, wer, report) of (path, page, content) pages of up to 100 each: recognised, cleaned, reflowed, scored and reported.

    A page that fails shows its error in the text. references: (doc, reference, origin). Pages are opened and recognised once.
    """
    named = readers.at_most(pages).select(F.element_at(F.split("path", "/"), -1).alias("doc"), "page", "content")
    found = read_once(named, engine, store)
    good = page_results(found.where("error is null and line_no is not null"), blocks, profile).select("doc", "page", lines.reflow(F.col("text")).alias("text"))
    failed = found.where("error is not null").select("doc", "page", "error")
    each = found.select("doc", "page").distinct().join(good, ["doc", "page"], "left").join(failed, ["doc", "page"], "left")
    blocks_ = each.select("doc", "page", writers.page_blocks(F.col("page"), F.col("text"), F.col("error")).alias("block"), "text")
    rows = F.array_sort(F.collect_list(F.struct("page", "block", "text")))
    whole = blocks_.groupBy("doc").agg(rows.alias("rows"), F.count("*").alias("n_pages"))
    title = writers.run_header("Tamil OCR Output", ("Languages", F.lit(languages)), ("Pages processed", F.col("n_pages")))
    texts = whole.select("doc", "n_pages", F.concat(title, F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["block"]), "\n\n")).alias("text"), F.array_join(F.transform("rows", lambda r: F.coalesce(r["text"], F.lit(""))), " ").alias("body"))
    empty = texts.select("doc", F.lit(None).cast("string").alias("reference"), F.lit("no reference available").alias("origin"))
    both = texts.join(empty if references is None else references, "doc", "left").withColumns({"p": T.metric_text(udfs.nfc("body")), "r": T.metric_text(udfs.nfc("reference"))})
    has = F.coalesce(F.col("r") != "", F.lit(False))
    scored = both.withColumns({"cer": F.when(has, metrics.char_error_rate(F.col("p"), F.col("r"))), "wer": F.when(has, metrics.word_error_rate(F.col("p"), F.col("r")))})
    report = metrics.run_report(F.col("doc"), F.col("n_pages"), T.safe_stem(F.col("doc")), F.col("cer"), F.col("wer"), F.coalesce("origin", F.lit("no reference available")), F.lit(languages))
    return scored.select("doc", "text", "cer", "wer", report.alias("report"))


def evaluate(outputs: DataFrame, references: DataFrame) -> DataFrame:
    """(doc, cer, wer, reference_chars, predicted_chars) of formatted outputs (doc, text) against joined reference pages (doc, text)."""
    p = outputs.select("doc", T.prediction_text(F.col("text")).alias("p"))
    r = references.select("doc", T.strip(T.replace(F.col("text"), r"\s+", " ")).alias("r"))
    rates = [metrics.char_error_rate(F.col("p"), F.col("r")).alias("cer"), metrics.word_error_rate(F.col("p"), F.col("r")).alias("wer")]
    return p.join(r, "doc").select("doc", *rates, F.char_length("r").alias("reference_chars"), F.char_length("p").alias("predicted_chars"))


def reviewed_run(results: DataFrame, lines_: DataFrame, router: Model, reviewer: Model, finisher: Model) -> DataFrame:
    """Page results routed, reviewed where the gate asks for it, assembled and finished chunk by chunk, twice.

    A row per document: doc, final_markdown, total_pages, llm_call_count, detected_language, doc_type, qa_decisions (page,
    answer), routing_reason, and ``text``, the same under the output file's head. The router sees each document's
    first page; a page the gate lets through never reaches the reviewer. A reviewer's answer is recorded and
    changes no text.
    """
    first = results.groupBy("doc").agg(F.min_by("text", "page").alias("text"), F.count("*").alias("n_pages"))
    routed = stores.written(first.select("doc", "n_pages", T.routing_decision(_call(router, "")("text")).alias("route")), "routed")
    scores = lines_.groupBy("doc", "page").agg(F.collect_list("confidence").alias("scores"))
    gated = results.join(scores, ["doc", "page"], "left").join(routed, "doc")
    need = layout.needs_review(F.col("confidence"), F.size(F.coalesce("scores", F.array().cast("array<double>"))), F.col("route.estimated_columns"), F.size(T.split_lines(F.col("text"))))
    asked = gated.where(need).withColumn("review", _call(reviewer, "{}")(T.prompt(F.col("text"), F.col("scores"), F.col("route.detected_language"))))
    pages = stores.written(asked.unionByName(gated.where(~need).withColumn("review", F.lit(None).cast("string"))), "reviewed")
    whole = lines.ordered_join(pages.withColumn("t", F.concat(F.lit("PAGE "), F.col("page").cast("string"), F.lit("\n"), F.col("text"))), ["doc"], "page", "t", "\n\n")
    chunks = whole.select("doc", F.posexplode(udfs.chunk_text("text")).alias("chunk_no", "chunk"))
    passed = chunks
    for _ in range(2):  # the second pass works on what the first one gave
        passed = passed.withColumn("chunk", F.coalesce(T.strip(_call(finisher, None)("chunk")), F.col("chunk")))
    body = lines.ordered_join(stores.written(passed, "finished"), ["doc"], "chunk_no", "chunk", "\n\n")
    reviews = pages.groupBy("doc").agg(F.count("review").alias("reviews"), F.array_sort(F.collect_list(F.when(F.col("review").isNotNull(), F.struct("page", F.col("review").alias("answer"))))).alias("qa_decisions"))
    calls = 1 + F.coalesce(F.col("reviews"), F.lit(0)) + 1  # finishing counts once, whatever its chunks and passes
    head = writers.run_header(
        "Document text output", ("Source file", F.col("doc")), ("Detected language", F.col("route.detected_language")), ("Document type", F.col("route.doc_type")),
        ("Total pages", F.col("n_pages")), ("LLM calls made", F.col("llm_call_count")),
    )
    rows = body.join(routed, "doc").join(reviews, "doc", "left").withColumn("llm_call_count", calls)
    return rows.select(
        "doc", F.col("text").alias("final_markdown"), F.col("n_pages").alias("total_pages"), "llm_call_count", "route.detected_language", "route.doc_type", "qa_decisions", "route.routing_reason",
        F.concat(head, F.lit("\n"), F.col("text")).alias("text"),
    )


def plain_run(results: DataFrame, language: str = "ta") -> DataFrame:
    """The same columns without any reviewing model: pages under their numbers."""
    whole = lines.ordered_join(results.withColumn("t", F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n"), F.col("text"))), ["doc"], "page", "t", "\n\n")
    counts = results.groupBy("doc").agg(F.count("*").alias("total_pages"))
    return whole.join(counts, "doc").select(
        "doc", F.col("text").alias("final_markdown"), "total_pages", F.lit(0).cast("long").alias("llm_call_count"), F.lit(language).alias("detected_language"), F.lit("historical_scan").alias("doc_type"),
        F.array().cast("array<struct<page:int,answer:string>>").alias("qa_decisions"), F.lit("").alias("routing_reason"), "text",
    )


def run_document(results: DataFrame, lines_: DataFrame | None = None, models: tuple[Model, Model, Model] | None = None, language: str = "ta") -> dict:
    """One document's result with the seconds it took: recognition, agents, in all. Without models pages are joined as they are."""
    began = time.monotonic()
    results = results.persist()
    n = results.count()
    read = time.monotonic()
    found = plain_run(results, language) if models is None else reviewed_run(results, lines_, *models)
    row = found.drop("doc", "text").first() if n else None
    results.unpersist()
    ended = time.monotonic()
    out = row.asDict(recursive=True) if row else {"final_markdown": "", "total_pages": 0, "llm_call_count": 0, "detected_language": language, "doc_type": "historical_scan", "qa_decisions": [], "routing_reason": ""}
    return out | {"elapsed_ocr": read - began, "elapsed_agents": ended - read, "elapsed_total": ended - began}


def acquire_all(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], folder: str) -> DataFrame:
    """(source, path, rows, error): each source's table below ``folder``, made if it is not there yet; one that fails is a row with its error, the others go on."""
    out = []
    for name, make in sources.items():
        path = f"{folder.rstrip('/')}/{name}"
        try:
            out.append((name, path, readers.once(spark, path, make).count(), None))
        except Exception as e:  # one source's failure is its own
            out.append((name, path, None, str(e).splitlines()[0] if str(e) else type(e).__name__))
    return spark.createDataFrame(out, "source string, path string, rows long, error string")


def clean_all(web: DataFrame, verse: DataFrame, printed: DataFrame, profile: ScriptProfile = TAMIL) -> tuple[DataFrame, DataFrame]:
    """The combined corpus of three line tables (doc_id, line_no, line) and its validation row."""
    cleaned = [("web", corpus.clean_web(web, profile)), ("verse", corpus.clean_verse(verse, profile)), ("print", corpus.clean_print(printed, profile))]
    combined = corpus.combine(cleaned, "doc_id", "line_no")
    return combined, corpus.validate(combined)


def build_training_set(modern: DataFrame, classical: DataFrame, premodern: DataFrame, total: int = 75_000, seed: int = 42, letters: str = TAMIL.letters, table: dict[str, str] | None = None, error_rate: float | None = None) -> DataFrame:
    """(key, input, target, source) from line tables (source, line_no, line): joined, shaped, balanced, corrupted, gated by bytes."""
    joined = shaping.join_stanzas(classical).select("source", F.concat_ws("-", F.col("segment").cast("string"), F.col("piece").cast("string")).alias("at"), "line")
    plain = [df.select("source", F.col("line_no").cast("string").alias("at"), "line") for df in (modern, premodern)]
    shaped = [
        df.select(F.posexplode(shaping.pack(F.col("line"))).alias("n", "line"), "source", "at").select(F.concat_ws("-", "source", "at", F.col("n").cast("string")).alias("key"), "line")
        for df in (plain[0], joined, plain[1])
    ]
    mixed = sampling.balance(*shaped, total, seed, "key").withColumn("key", F.concat_ws("#", "key", F.col("copy").cast("string")))
    made = mixed.select("key", noise.training_pairs(F.col("line"), F.col("key"), F.col("register"), seed, letters, table, error_rate).alias("input"), F.col("line").alias("target"), F.col("register").alias("source"))
    return made.where(T.fits(F.col("input")) & T.fits(F.col("target")))


def round_trip_pairs(
    chosen: DataFrame, name: str, engine: str, n: int, least_edits: int = 2, seed: int = 42, done: DataFrame | None = None, store: str | None = None, attempts: int | None = None
) -> DataFrame:
    """n pairs read back from images of the targets of ``chosen`` (key, target); with a ``store`` a run that was stopped goes on."""
    render, degrade = recognition.renderer(name)
    return recognition.round_trip(chosen.select("key", F.col("target").alias("text")), render, degrade, engine, n, least_edits, seed, done, store, attempts=attempts)


def crawl(spark: SparkSession, source: str, call: listings.Interface, roots: list[str], seen: DataFrame | None = None, most: int | None = None, profile: ScriptProfile = TAMIL, **options: str) -> DataFrame:
    """(title, line_no, line): the categories ``roots`` of a wiki listed, their pages fetched once each, and their lines cleaned.

    source: the name under which ``call`` is registered (see :mod:`..sources.listings`). seen: titles that are left out before anything is fetched.
    """
    titles = listings.crawled(spark, source, roots, **options)
    fresh = titles if seen is None else titles.join(seen.select("title"), "title", "left_anti")
    fetched = stores.written(listings.page_texts(fresh, call, profile), "fetched")  # each title is asked for once
    pages = fetched.where("error is null").select("title", corpus.page_text(F.col("extract"), F.col("wikitext"), profile).alias("text")).where("text is not null")
    return corpus.crawl_lines(pages, "title", "text", profile, most=most)


def pack_training_set(made: DataFrame, extra: DataFrame | None, n: int, val_ratio: float = 0.1, seed: int = 42, least_edits: int = 2) -> DataFrame:
    """n sampled pairs and the extra pairs that differ enough, shuffled by seed, with ``split``."""
    if n < 1 or not 0 < val_ratio < 1 or least_edits < 0:
        raise ValueError("n must be positive, val_ratio between 0 and 1, least_edits not negative")
    chosen = sampling.take(made, n, seed, "key", strict=True).drop("shuffle_key")
    if extra is not None:
        chosen = chosen.unionByName(pairs.usable(extra, least_edits))
    return sampling.train_val_split(chosen, val_ratio, seed, "key")
