"""Noisy and clean pairs (input, target, source): statistics, audits, resuming and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import edits as edits_of
from ..functions.scripts import TAMIL, ScriptProfile
from .sampling import take, train_val_split

PAIR = "input string, target string, source string"


def stats(pairs: DataFrame, *order: str, edits_of_first: int | None = None) -> DataFrame:
    """One row of lengths of the targets, fits, tagged inputs and mean edits of all pairs, or of the first so many in the given order."""
    chars, size = F.char_length("target"), F.octet_length("target")
    has_tag = F.col("input").rlike("</?(mark|sub|sup)>")
    whole = pairs.agg(
        F.count("*").alias("total_pairs"), F.min(chars).alias("chars_min"), F.max(chars).alias("chars_max"), F.round(F.avg(chars), 1).alias("chars_mean"), F.median(chars).alias("chars_median"),
        F.min(size).alias("bytes_min"), F.max(size).alias("bytes_max"), F.round(F.avg(size), 1).alias("bytes_mean"), F.median(size).alias("bytes_median"),
        F.count_if(size <= 512).alias("fits_512"), F.count_if(size <= 1024).alias("fits_1024"), F.count_if(has_tag).alias("tagged"),
        F.round(100 * F.count_if(has_tag) / F.count("*"), 1).alias("tagged_pct"),
    )
    edited = pairs if edits_of_first is None else pairs.orderBy(*order).limit(edits_of_first)
    edits = edited.agg(F.round(F.avg(edits_of(T.strip_leak_tags(F.col("input")), F.col("target"))), 1).alias("avg_edits"))
    return whole.crossJoin(edits)  # one row each


def register_mix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source").agg(F.count("*").alias("pairs"))


def audit(pairs: DataFrame, profile: ScriptProfile = TAMIL) -> DataFrame:
    """One row: pairs with tags in input or target, and without script in the input."""
    tag = "<[^>]+>"
    return pairs.agg(
        F.count("*").alias("total"), F.count_if(F.col("input").rlike(tag)).alias("html_input"), F.count_if(F.col("target").rlike(tag)).alias("html_target"),
        F.count_if(~T.has_script(F.col("input"), profile)).alias("no_script"),
    )


def unfinished(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets not yet completed, each once."""
    return targets.join(done.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def usable(pairs: DataFrame, least_edits: int = 1, most_bytes: int = 1024) -> DataFrame:
    """Pairs that differ by enough edits and whose sides fit."""
    a, b = F.col("input"), F.col("target")
    return pairs.where((a != b) & T.edits_at_least(a, b, least_edits) & T.fits(a, most_bytes) & T.fits(b, most_bytes))


def pack(pairs: DataFrame, n: int, val_ratio: float, seed: int, *key: str) -> DataFrame:
    """n sampled pairs with ``split``."""
    return train_val_split(take(pairs, n, seed, *key).drop("shuffle_key"), val_ratio, seed + 1, *key)
