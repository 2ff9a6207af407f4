"""Streams: progress events, incremental corpora and exactly-once appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVENT = "type string, status string, log string, output_path string, output_filename string, report string, message string"


class Progress(StreamingQueryListener):
    """Hands each batch's progress to a function as (rows, rows per second); what went wrong comes as a message."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event):
        self.tell({"type": "progress", "status": "started"})

    def onQueryProgress(self, event):
        p = event.progress
        self.tell({"type": "progress", "status": "running", "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell({"type": "error", "message": event.exception} if event.exception else {"type": "done"})


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Progress events from JSON lines; unreadable lines are errors."""
    e = F.from_json(value, EVENT)
    bad = e["type"].isNull()
    return lines.select(F.when(bad, "error").otherwise(e["type"]).alias("type"), F.when(bad, F.col(value)).otherwise(F.coalesce(e["message"], e["status"])).alias("message"))


def new_files(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Folders by which the keys of an append are dealt.
PARTS = 64


def append_once(stream: DataFrame, key: str, path: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame], parts: int = PARTS):
    """Clean what has arrived, append each key once ever, and stop; a later run goes on where this one ended.

    A batch is written to a folder of its own (``batch``), dealt by its keys' hashes (``part``), without the keys of the batches before it, of
    which only the parts that it touches are read. So no state is kept, and a batch that is run again after a failure replaces what it left.
    """

    def write(rows: DataFrame, number: int) -> None:
        new = clean(rows).dropDuplicates([key]).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).persist()
        try:
            earlier = earlier_keys(rows.sparkSession, path, key, number, [r.part for r in new.select("part").distinct().collect()])  # ``parts`` numbers at most
            fresh = new if earlier is None else new.join(earlier, ["part", key], "left_anti")
            fresh.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def earlier_keys(spark: SparkSession, path: str, key: str, number: int, parts: list[int]) -> DataFrame | None:
    """(part, key) of the batches before ``number`` in the given parts; none if nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    before = [n for n in names if n.startswith("batch=") and int(n.removeprefix("batch=")) < number]
    held = [n for n in before if any(s.getPath().getName().startswith("part=") for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")))]
    if not held:
        return None
    return spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in held]).where(F.col("part").isin(parts)).select(F.col("part").cast("int").alias("part"), key)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per type and window, with a watermark; on a table, the same as a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"))
