"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots, bytes and rows are summed per slot, and a versioned map says
which shard owns each slot. Rebalancing edits the map: it moves single slots from the fullest shard to the
emptiest until no move makes them more even. Only the slots' sums (as many rows as slots, a fixed bound) reach the
driver. The map is a table; given a ``store``, the newest version there is loaded, edited and written as the next one.

Rows of equal id and text are interchangeable: they are counted first, and each of them is hashed with its number among its
equals, so that no id, no text and no repeated row fills a slot or a task. Rows of equal text and different ids are rows like any
others; equal texts are not kept together, for the law is about bytes alone.

Null texts have size 1 and CRC 0; very long ones are one record of their size; a null doc_id hashes like any value; ties of size and
checksum are broken by the number. An empty table gives an empty result and an unedited map. Further columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Virtual slots, fixed for the life of a store, far more than there will be shards; parts of a slot that are numbered apart.
SLOTS, PARTS = 4096, 16


def first_map(slots: int, shards: int) -> list[int]:
    """Version 0: slots dealt round robin."""
    return [s % shards for s in range(slots)]


def rebalance(owner: list[int], load: dict[int, int], shards: int) -> list[int]:
    """An edited copy of the map under which the shards' loads are near equal.

    Each edit moves the slot whose load comes nearest to half the gap between the fullest and the emptiest shard;
    it stops when no slot of the fullest shard narrows that gap. Ties go to the smallest slot.
    """
    owner = list(owner)
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    total = [0] * shards
    for slot, shard in enumerate(owner):
        if load.get(slot, 0):
            held[shard][slot] = load[slot]
            total[shard] += load[slot]
    full = [(-t, s) for s, t in enumerate(total)]
    empty = [(t, s) for s, t in enumerate(total)]
    heapq.heapify(full)
    heapq.heapify(empty)
    while True:
        while -full[0][0] != total[full[0][1]]:
            heapq.heappop(full)
        while empty[0][0] != total[empty[0][1]]:
            heapq.heappop(empty)
        source, target = full[0][1], empty[0][1]
        gap = total[source] - total[target]
        movable = [(abs(gap - 2 * w), slot) for slot, w in held[source].items() if w < gap]
        if not movable:
            return owner
        slot = min(movable)[1]
        weight = held[source].pop(slot)
        held[target][slot] = weight
        owner[slot] = target
        for shard, change in ((source, -weight), (target, weight)):
            total[shard] += change
            heapq.heappush(full, (-total[shard], shard))
            heapq.heappush(empty, (total[shard], shard))


MAP = "version int, virtual_slot int, shard int, bytes long, rows long"


def load_map(spark: SparkSession, store: str) -> tuple[int, list[int]] | None:
    """Version and owners of the newest map in ``store``; nothing if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    known = spark.read.schema(MAP).parquet(store)
    newest = known.where(F.col("version") == known.agg(F.max("version")).first()[0]).select("version", "virtual_slot", "shard").collect()  # a row a slot
    owner = {r["virtual_slot"]: r["shard"] for r in newest}
    return (newest[0]["version"], [owner[s] for s in range(len(owner))]) if newest else None


def _map(spark: SparkSession, version: int, owner: list[int], loads: dict[int, int], counts: dict[int, int]) -> DataFrame:
    return spark.createDataFrame([(version, s, o, loads.get(s, 0), counts.get(s, 0)) for s, o in enumerate(owner)], MAP).coalesce(1)


def place(docs: DataFrame, shards: int = 8, slots: int = SLOTS, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The records with their virtual slot, shard and place within the shard, and the versions of the slot map.

    With ``store`` its newest map is the one that is edited, and the edited map is added to it; without, version 0 deals slots round robin.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    records = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    kinds = records.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    # The equals of a kind are dealt over as many pieces as there are slots, if they are so many.
    pieces = F.least(F.col("n"), F.lit(slots)).cast("int")
    share = (F.floor(F.col("n") / pieces) + (F.col("piece") < F.col("n") % pieces).cast("long")).alias("n")
    hashed = F.when(F.col("n") == 1, F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", "piece"))
    dealt = materialize(
        kinds.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select(
            "doc_id", "size", "text_crc32", "piece", share, F.pmod(hashed, F.lit(slots)).cast("int").alias("virtual_slot"), F.pmod(F.shiftright(hashed, 32), F.lit(PARTS)).cast("int").alias("part")
        ),
        "records",
    )
    sums = dealt.groupBy("virtual_slot", "part").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")).collect()  # SLOTS * PARTS rows at most
    loads: dict[int, int] = {}
    counts: dict[int, int] = {}
    for r in sums:
        loads[r["virtual_slot"]] = loads.get(r["virtual_slot"], 0) + r["bytes"]
        counts[r["virtual_slot"]] = counts.get(r["virtual_slot"], 0) + r["rows"]
    found = load_map(spark, store) if store else None
    version, before = found or (0, first_map(slots, shards))
    if len(before) != slots or max(before) >= shards:
        raise ValueError(f"the stored map has {len(before)} slots and shards up to {max(before)}")
    owner = rebalance(before, loads, shards)
    old, new = _map(spark, version, before, loads, counts), _map(spark, version + 1, owner, loads, counts)
    if store:
        (new if found else old.unionByName(new)).write.mode("append").parquet(store)
    filled, starts = [0] * shards, []
    for r in sorted(sums, key=lambda r: (r["virtual_slot"], r["part"])):
        shard = owner[r["virtual_slot"]]
        starts.append((r["virtual_slot"], r["part"], shard, filled[shard]))
        filled[shard] += r["rows"]
    first = materialize(spark.createDataFrame(starts, "virtual_slot int, part int, shard int, first_place long").coalesce(1), "places")
    order = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32", "piece")
    placed = (
        dealt.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
        .join(F.broadcast(first), ["virtual_slot", "part"])  # SLOTS * PARTS rows at most
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("slot", F.col("first_place") + F.col("before") + F.col("copy"))
    )
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot"), old.unionByName(new)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` over shards 0 to 7 with near equal bytes; ``slot`` is the place within the shard."""
    placed, _ = place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
