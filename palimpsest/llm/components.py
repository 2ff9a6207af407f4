"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Large-star hangs every larger neighbour of a node on the smallest node of its neighbourhood; small-star does the
same with a node and its smaller neighbours. Alternated until nothing changes, every node hangs on the smallest of
its component. Each round is one job over the edges and ends in a table in the shared folder; hubs are never
gathered, their minima are pre-aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _hung(edges: DataFrame, mins: DataFrame) -> DataFrame:
    """edges (u, v) with the minimum m of u's neighbourhood; hubs are left to the skew join."""
    return edges.join(mins, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    mins = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _hung(both.where("v > u"), mins).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    mins = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _hung(down, mins).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(mins.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, component): every node that has an edge to another, and the smallest node it reaches."""
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        after = materialize(small_star(large_star(now)), "edges")
        discard(now)
        before, state, now = state, _state(after), after
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
