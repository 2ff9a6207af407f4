"""The end of a document in a stream of its pages: done when all of them are there, an error when time is up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "doc string, type string, pages int, total int, message string"
#: How long a document waits for its next page.
WAIT = "10 minutes"


class Pages(StatefulProcessor):
    """One document: its pages so far, how many there must be, and whether that has been told.

    Each page moves the document's timer to ``wait`` after the latest of them. When the timer fires before all pages are there, the
    document is an error; in any case its state goes then. Until then, pages of a document that is done, and pages that come twice, say nothing.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "page int", "there boolean")
        self.about = handle.getValueState("about", "pages int, total int, told boolean, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pages, total, told, until = self.about.get() if self.about.exists() else (0, 0, False, 0)
        before = until
        for batch in rows:
            total = max(total, int(batch["n_pages"].max()))
            until = max(until, int(batch["ts"].max().timestamp() * 1000) + self.wait_ms)
            for page in batch["page"]:
                if not self.seen.containsKey((int(page),)):
                    self.seen.updateValue((int(page),), (True,))
                    pages += 1
        if until != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        if not told:
            told = pages >= total
            yield _event(key[0], "done" if told else "progress", pages, total, f"{pages} of {total} pages")
        self.about.update((pages, total, told, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pages, total, told, _ = self.about.get()
        self.about.clear()
        self.seen.clear()
        if not told:
            yield _event(key[0], "error", pages, total, f"only {pages} of {total} pages came in time")

    def close(self) -> None:
        pass


def _event(doc: str, kind: str, pages: int, total: int, message: str) -> pd.DataFrame:
    return pd.DataFrame([{"doc": doc, "type": kind, "pages": pages, "total": total, "message": message}])


def document_events(pages: DataFrame, wait: str = WAIT) -> DataFrame:
    """(doc, type, pages, total, message) of a stream of pages (doc, page, n_pages, ts): a ``progress`` a batch, then one ``done`` or ``error``.

    Time is the pages' own: with a watermark of ``wait`` a page that comes later than that is left out, and a document's timer fires
    when the stream's time has passed it. Needs the RocksDB state store, as all keyed state with timers does.
    """
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    keyed = pages.select("doc", F.col("page").cast("int").alias("page"), F.col("n_pages").cast("int").alias("n_pages"), "ts").withWatermark("ts", wait).groupBy("doc")
    return keyed.transformWithStateInPandas(Pages(ms), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def as_progress(events: DataFrame) -> DataFrame:
    """The events as the JSON lines that :func:`.streams.parse_events` reads."""
    status = F.when(F.col("type") == "done", "done").otherwise(F.col("message"))
    return events.select(F.to_json(F.struct("type", status.alias("status"), "message", F.col("doc").alias("output_filename"))).alias("value"))
