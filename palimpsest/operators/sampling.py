"""Seeded sampling whose draws are hashes of a seed and a key: the same on any partitioning and in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stores


def draw(seed: int | Column, *key: Column | str) -> Column:
    """A number from 0 up to 1 for each key."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed, *key)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def order_key(seed: int, *key: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *key))


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    return df.withColumn("shuffle_key", order_key(seed, *key)).orderBy("shuffle_key", *key)


#: Rows that an ordered limit may bring to one task; more are taken by their ranks.
TOP = 10_000


def take(df: DataFrame, n: int, seed: int, *key: str, strict: bool = False) -> DataFrame:
    """n rows without replacement; if there are fewer, all, or with ``strict`` an error before anything runs."""
    if strict and (have := df.count()) < n:
        raise ValueError(f"{n} rows are wanted, there are {have}")
    if n > TOP:
        return ranked(df, seed, *key).where(F.col("rank") <= n).withColumn("shuffle_key", order_key(seed, *key)).drop("rank")
    return df.withColumn("shuffle_key", order_key(seed, *key)).orderBy("shuffle_key", *key).limit(n)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by ``order``, which must tell rows apart: an ordered limit for few, for many a range partitioning.

    The many are written, range partitioned and sorted, with their places inside their partition; the sizes of the partitions (a row each)
    say how many come before it.
    """
    if n <= TOP:
        return df.orderBy(*order).limit(n)
    within = F.col("place_").bitwiseAND((1 << 33) - 1)
    dealt = stores.written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id()), "ordered")
    sizes = sorted(dealt.groupBy(F.shiftright("place_", 33).alias("part")).count().collect())
    before, keep = 0, []
    for part, size in sizes:
        if before < n:
            keep.append((part, min(size, n - before)))
        before += size
    if not keep:
        return dealt.limit(0).drop("place_")
    wanted = F.broadcast(df.sparkSession.createDataFrame(keep, "part_ long, most_ long"))  # as many rows as partitions
    return dealt.withColumn("part_", F.shiftright("place_", 33)).join(wanted, "part_").where(within < F.col("most_")).drop("place_", "part_", "most_")


def with_replacement(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows drawn with replacement, each draw a row with its number ``copy``: draw k takes the row whose rank it hashes to."""
    rows = ranked(df, seed, *key)
    total = df.agg(F.count("*").alias("total"))
    draws = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "copy").crossJoin(F.broadcast(total))  # one row
    drawn = draws.where("total > 0").select("copy", (F.floor(draw(seed, F.col("copy").cast("string"), F.lit("draw")) * F.col("total")) + 1).cast("long").alias("rank"))
    return rows.join(drawn, "rank").drop("rank")


def resampled(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows with ``copy``: a sample if there are enough, else drawn with replacement."""
    if df.count() >= n:
        return take(df, n, seed, *key).drop("shuffle_key").withColumn("copy", F.lit(1).cast("long"))
    return with_replacement(df, n, seed, *key)


def remaining(df: DataFrame, chosen: DataFrame, *key: str) -> DataFrame:
    """The rows whose key was not chosen."""
    return df.join(chosen.select(*key).distinct(), list(key), "left_anti")


def ranked(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """``rank``: the place of each row in the seeded order, without gathering the rows, or a number of buckets that grows with them, in one task.

    Rows are ranked within the 16.7 million buckets of the six leading hex digits of their shuffle key; before a bucket come the buckets
    of the same three digits, added up within them, and the 4096 groups of three digits before. Rows are dealt by bucket once, for ranking and joining.
    """
    keyed = df.withColumn("shuffle_key", order_key(seed, *key)).withColumn("bucket", F.substring("shuffle_key", 1, 6))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("group", F.substring("bucket", 1, 3))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("rows"))
    before = groups.select("group", (F.sum("rows").over(Window.orderBy("group")) - F.col("rows")).alias("before"))  # 4096 rows at most
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")
    starts = sizes.withColumn("inside", inside).join(F.broadcast(before), "group").select("bucket", (F.col("before") + F.col("inside")).alias("start"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("shuffle_key", *key))
    return keyed.withColumn("within", within).join(starts, "bucket").withColumn("rank", (F.col("start") + F.col("within")).cast("long")).drop("bucket", "within", "start", "shuffle_key")


def train_val_split(df: DataFrame, ratio: float, seed: int, *key: str) -> DataFrame:
    """split: the first max(1, round(n * ratio)) rows of the seeded order are validation."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    n = df.agg(F.count("*").alias("total"))
    n_val = F.greatest(F.lit(1), F.bround(F.col("total") * ratio, 0))
    return ranked(df, seed, *key).crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("rank") <= n_val, "validation").otherwise("train")).drop("rank", "total")


def repeat_to(df: DataFrame, target: int, seed: int, *key: str) -> DataFrame:
    """Oversampling: whole repeats and a seeded remainder, or the first ``target`` rows if there are more."""
    n = df.agg(F.count("*").alias("total"))
    times = F.greatest(F.lit(1), F.floor(F.lit(target) / F.col("total"))).cast("int")
    extra = F.greatest(F.lit(0), F.lit(target) - times * F.col("total"))
    copies = times + (F.col("rank") <= extra).cast("int")
    rows = ranked(df, seed, *key).crossJoin(F.broadcast(n)).withColumn("copies", copies)
    return rows.where(F.col("rank") <= target).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("rank", "total", "copies")


#: Shares of the registers, cut to whole rows.
MODERN, CLASSICAL, PREMODERN = 0.40, 0.33, 0.27


def register_targets(total: int) -> tuple[int, int, int]:
    return int(total * MODERN), int(total * CLASSICAL), int(total * PREMODERN)


def balance(modern: DataFrame, classical: DataFrame, premodern: DataFrame, total: int, seed: int, *key: str) -> DataFrame:
    """The three registers brought to their shares, with ``copy`` and ``register``.

    Without pre-modern rows their share is given away: half to modern rows not yet chosen, if there are more than
    that, and half to classical rows drawn with replacement (numbered on after the copies there are).
    """
    want_m, want_c, want_p = register_targets(total)
    modern_rows, classical_rows = take(modern, want_m, seed, *key).drop("shuffle_key").withColumn("copy", F.lit(1)), repeat_to(classical, want_c, seed, *key)
    parts = [("modern", modern_rows), ("classical", classical_rows)]
    if not premodern.isEmpty():
        parts.append(("premodern", repeat_to(premodern, want_p, seed, *key)))
    else:
        more = want_p // 2
        if modern.count() > want_m + more:
            left = ranked(modern, seed, *key).where(F.col("rank").between(want_m + 1, want_m + more)).drop("rank")  # the order that was taken from
            parts.append(("modern", left.withColumn("copy", F.lit(1))))
        drawn = with_replacement(classical, want_p - more, seed + 1, *key)
        parts.append(("classical", drawn.withColumn("copy", (F.col("copy") + want_c).cast("int"))))
    out = None
    for name, df in parts:
        df = df.withColumn("register", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
