"""Sinks: JSON results, formatted texts, corpus lines, pairs and splits, all through Spark's own writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def page_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def texts(docs: DataFrame, path: str, key: str = "doc") -> None:
    """One text per document, in a folder of its own."""
    docs.select(key, F.col("text").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def corpus(lines: DataFrame, path: str, *order: str) -> None:
    """Lines in the given order within each file."""
    lines.sortWithinPartitions(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def pairs(df: DataFrame, path: str, append: bool = False) -> None:
    df.select("input", "target", "source").write.mode("append" if append else "overwrite").json(path)


def splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def run_header(title: str, *facts: tuple[str, Column]) -> Column:
    """The head of an output file: title, divider, one line a fact, divider."""
    lines = [F.concat(F.lit(f"{name:<17}: "), value.cast("string")) for name, value in facts]
    return F.concat_ws("\n", F.lit(title), F.lit("=" * 60), *lines, F.lit("=" * 60), F.lit(""))


def page_blocks(page: Column, text: Column, error: Column) -> Column:
    """A page's block of an output file; a page that failed shows its error."""
    return F.concat_ws("\n", F.lit("=" * 60), F.concat(F.lit("PAGE "), page.cast("string")), F.lit("=" * 60), F.coalesce(error, text, F.lit("")))


def comparison(compared: DataFrame, path: str) -> None:
    """The pages of two engines side by side, one JSON object per document: document, total_pages, pages."""
    side = lambda n: F.struct(*[F.col(f"{n}_{c}").alias(c) for c in ("confidence", "n_lines", "chars")])
    pages = F.array_sort(F.collect_list(F.struct("page", side("a").alias("a"), side("b").alias("b"))))
    compared.groupBy(F.col("doc").alias("document")).agg(F.count("*").alias("total_pages"), pages.alias("pages")).write.mode("overwrite").json(path)


def stats(row: DataFrame, path: str) -> None:
    """A table of one row, such as statistics, as one JSON object."""
    row.coalesce(1).write.mode("overwrite").json(path)


def page_images(pages: DataFrame, put: Callable[[str, bytes], None]) -> DataFrame:
    """Hands each page (path, page, content) to ``put`` under the name stem_page_NNNN.png; gives the names that were put."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.name, batch.content, strict=True):
                put(name, content)
            yield batch[["name"]]

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.\w+$", "")
    named = pages.select(F.concat(T.safe_stem(T.strip(stem)), F.format_string("_page_%04d.png", "page")).alias("name"), "content")
    return named.mapInPandas(run, "name string")
