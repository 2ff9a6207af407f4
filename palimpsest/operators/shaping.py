"""Length shaping of lines: stanzas are joined up to a readable length, long lines packed into pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEAST, MOST = 20, 340
JOIN_LEAST, JOIN_MOST = 80, 150


def join_stanzas(lines: DataFrame) -> DataFrame:
    """(source, segment, piece, line) of (source, line_no, line): short neighbours joined.

    A line of 80 characters leaves the buffer empty, so segments between such lines are independent and the fold runs
    per segment, in parallel; only a source's last segment drops a tail under 20 characters.
    """
    order = Window.partitionBy("source").orderBy("line_no")
    long_line = (F.char_length("line") >= JOIN_LEAST).cast("int")
    segmented = lines.withColumn("segment", F.coalesce(F.sum(long_line).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = segmented.groupBy("source").agg(F.max("segment").alias("last"))
    grouped = segmented.groupBy("source", "segment").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))

    def step(acc, row):
        line, buffer = row["line"], acc["buffer"]
        grown = F.when(buffer == "", line).otherwise(F.concat(buffer, F.lit(" "), line))
        add = lambda *items: F.concat(acc["done"], F.filter(F.array(*items), lambda x: x != ""))
        state = lambda done, rest: F.struct(done.alias("done"), rest.alias("buffer"))
        return (
            F.when(F.char_length(line) >= JOIN_LEAST, state(add(buffer, line), F.lit("")))
            .when((F.char_length(grown) > JOIN_MOST) & (buffer != ""), state(add(buffer), line))
            .when(F.char_length(grown) >= JOIN_LEAST, state(add(grown), F.lit("")))
            .otherwise(state(acc["done"], grown))
        )

    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buffer"))
    folded = grouped.join(last, "source").withColumn("f", F.aggregate("rows", empty, step))
    tail_kept = (F.col("f.buffer") != "") & ((F.col("segment") < F.col("last")) | (F.char_length("f.buffer") >= LEAST))
    pieces = F.when(tail_kept, F.concat("f.done", F.array("f.buffer"))).otherwise(F.col("f.done"))
    return folded.select("source", "segment", F.posexplode(pieces).alias("piece", "line"))


def pack(c: Column) -> Column:
    """The pieces of a line: under 20 characters none, up to 340 itself, else sentences packed up to 340 and hard cuts."""
    parts = F.split(c, r"(?<=[.!?।])\s+", -1)

    def step(acc, part):
        now = acc["now"]
        joined = T.strip(F.concat(now, F.lit(" "), part))
        fits = F.char_length(now) + F.char_length(part) + 1 <= MOST
        flushed = F.concat(acc["done"], F.filter(F.array(now), lambda x: x != ""))
        return F.when(fits, F.struct(acc["done"].alias("done"), F.when(now == "", part).otherwise(joined).alias("now"))).otherwise(
            F.struct(flushed.alias("done"), part.alias("now"))
        )

    folded = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")), step, lambda a: F.concat(a["done"], F.filter(F.array(a["now"]), lambda x: x != "")))
    hard = F.flatten(
        F.transform(folded, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(s) - 1) / MOST).cast("int")), lambda i: F.substring(s, i * MOST + 1, F.lit(MOST))))
    )
    cut = F.filter(hard, lambda x: F.char_length(x) >= LEAST)
    none = F.array().cast("array<string>")
    return F.when(F.char_length(c) < LEAST, none).when(F.char_length(c) <= MOST, F.array(c)).otherwise(cut)
