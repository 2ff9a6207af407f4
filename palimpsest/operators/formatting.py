"""The document formatter: page tables (doc, page from 1, text) to one clean text per document.

One shuffle by document is intrinsic: which lines are running headers depends on all pages of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import collapse_blank_lines, merge_short_lines

DIVIDER = "=" * 60


def _filled(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n", -1), T.strip), lambda x: x != "")


def strip_page_numbers(c: Column) -> Column:
    """Number lines among the first and last three lines of a page go."""
    lines = F.split(c, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~(((i < 3) | (i >= F.size(lines) - 3)) & T.is_numeral_line(x)))
    return F.array_join(kept, "\n")


def page_metadata(c: Column) -> tuple[Column, Column]:
    """The first page number and the first short script line, looked for from the top and then from the bottom."""
    lines = _filled(c)
    n = F.size(lines)
    scan = F.when(n > 5, F.concat(F.slice(lines, 1, 5), F.reverse(F.slice(lines, F.greatest(n - 4, F.lit(1)), F.lit(5))))).otherwise(lines)
    number = F.coalesce(F.get(F.filter(scan, T.is_numeral_line), 0), F.lit(""))
    first = F.coalesce(F.array_position(F.transform(scan, T.is_numeral_line), True), F.lit(0))
    header = F.filter(scan, lambda x, i: (i + 1 != first) & (F.char_length(x) < 50) & T.has_script(x))
    return number, F.coalesce(F.get(header, 0), F.lit(""))


def running_headers(pages: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(doc, line, pages): short lines at the edges of many pages of a document."""
    lines = _filled(F.col("text"))
    edges = F.array_union(F.slice(lines, 1, 3), F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)))
    seen = pages.select("doc", F.explode(edges).alias("line")).groupBy("doc", "line").agg(F.count("*").alias("pages"))
    total = pages.groupBy("doc").agg(F.count("*").alias("n")).where("n >= 3")
    long_text = (F.char_length("line") > 30) & T.has_script(F.col("line"))
    return (
        seen.join(total, "doc")
        .where((F.col("pages") >= F.greatest(F.lit(2), (F.col("n") * threshold).cast("int"))) & (F.char_length("line") < 50) & ~long_text)
        .select("doc", "line", "pages")
    )


def strip_headers(pages: DataFrame, headers: DataFrame, also: Column | None = None) -> DataFrame:
    """Header lines among the first and last four filled lines go, but on a document's first page."""
    # A document's headers are few: each is on a third of its pages.
    per_doc = headers.groupBy("doc").agg(F.collect_set("line").alias("headers"))
    known = F.coalesce("headers", F.array().cast("array<string>"))
    if also is not None:
        known = F.array_union(known, F.array(also))
    lines = F.split("text", "\n", -1)
    filled = F.filter(F.transform(lines, lambda x, i: F.when(T.strip(x) != "", i)), lambda i: i.isNotNull())
    edge = F.array_union(F.slice(filled, 1, 4), F.slice(filled, F.greatest(F.size(filled) - 3, F.lit(1)), F.lit(4)))
    kept = F.filter(lines, lambda x, i: ~(F.array_contains(edge, i) & F.array_contains(known, T.strip(x))))
    return pages.join(per_doc, "doc", "left").withColumn("text", F.when(F.col("page") == 1, F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("headers")


def format_document(pages: DataFrame) -> DataFrame:
    """(doc, text): artifacts, page numbers and running headers go, short lines merge, pages are marked."""
    number, _ = page_metadata(F.col("text"))
    clean = pages.withColumn("text", T.strip_artifacts(F.col("text"))).withColumn("number", number).withColumn("text", strip_page_numbers(F.col("text")))
    clean = strip_headers(clean, running_headers(clean), also=F.col("doc"))
    body = T.strip(merge_short_lines(F.col("text")))
    label = F.concat(F.lit("PAGE "), F.col("page").cast("string"), F.when(F.col("number") != "", F.concat(F.lit("  ["), F.col("number"), F.lit("]"))).otherwise(""))
    section = F.when(body != "", F.concat_ws("\n", F.lit(""), F.lit(DIVIDER), label, F.lit(DIVIDER), body))
    parts = clean.select("doc", "page", section.alias("section")).groupBy("doc").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("page", "section")))).alias("parts")
    )
    head = F.concat_ws("\n", F.lit(DIVIDER), F.concat(F.lit("Tamil OCR Output — "), F.col("doc")), F.concat(F.lit("Pages processed: "), F.col("n").cast("string")), F.lit(DIVIDER))
    whole = F.concat_ws("\n", head, F.array_join(F.transform("parts", lambda p: p["section"]), "\n"))
    return parts.select("doc", collapse_blank_lines(whole).alias("text"))
