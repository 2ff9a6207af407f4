"""Error rates of predicted against reference texts, engine comparison and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import edits, nfc


def char_error_rate(predicted: Column, reference: Column) -> Column:
    return F.when(F.char_length(reference) > 0, edits(predicted, reference) / F.char_length(reference))


def word_error_rate(predicted: Column, reference: Column) -> Column:
    n = F.size(T.words(reference))
    return F.when(n > 0, T.word_edits(predicted, reference) / n)


def score(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(key, cer, wer) where both sides have the key; texts are brought to normal form C and normalised first."""
    p = predictions.select(key, T.metric_text(nfc("text")).alias("predicted"))
    r = references.select(key, T.metric_text(nfc("text")).alias("reference"))
    return p.join(r, key).select(key, char_error_rate(F.col("predicted"), F.col("reference")).alias("cer"), word_error_rate(F.col("predicted"), F.col("reference")).alias("wer"))


def compare_engines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Page results (doc, page, confidence, n_lines, text) of two engines side by side; only pages that both have."""
    side = lambda df, n: df.select("doc", "page", *[F.col(c).alias(f"{n}_{c}") for c in ("confidence", "n_lines")], F.char_length("text").alias(f"{n}_chars"))
    return side(a, "a").join(side(b, "b"), ["doc", "page"])


def best_engine(compared: DataFrame) -> DataFrame:
    """One row: pages won by each side (ties to a) and the winner."""
    won = F.coalesce("a_confidence", F.lit(0.0)) >= F.coalesce("b_confidence", F.lit(0.0))
    return compared.agg(F.count_if(won).alias("a_wins"), F.count_if(~won).alias("b_wins")).withColumn("winner", F.when(F.col("a_wins") >= F.col("b_wins"), "a").otherwise("b"))


def reference_text(file: Column, pasted: Column, embedded: Column) -> tuple[Column, Column]:
    """The first text that is not blank of a file, pasted text and embedded text, and where it came from."""
    f, p, e = (F.when(T.strip(c) != "", T.strip(c)) for c in (file, pasted, embedded))
    source = (
        F.when(f.isNotNull(), "user-provided reference file").when(p.isNotNull(), "user-provided reference text")
        .when(e.isNotNull(), "embedded PDF text (best-effort)").otherwise("no reference available")
    )
    return F.coalesce(f, p, e), source


def run_report(name: Column, pages: Column, output: Column, cer: Column, wer: Column, source: Column, languages: Column) -> Column:
    """The run's Markdown report."""
    percent = lambda c: F.when(c.isNull(), "N/A").otherwise(F.format_string("%.2f%%", c * 100))
    row = lambda label, c: F.concat(F.lit(f"| **{label}** | "), c, F.lit(" |"))
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    return F.concat_ws(
        "\n", F.lit("### 📊 Run Report\n\n| Property | Value |\n|---|---|"), row("File", tick(name)), row("Pages processed", pages.cast("string")), row("Languages", languages),
        row("Output", tick(output)), row("Reference", source), row("CER", percent(cer)), row("WER", percent(wer)),
        F.lit("\n> **CER** measures character-level accuracy. **WER** measures word-level accuracy. Lower is better.\n"),
    )
