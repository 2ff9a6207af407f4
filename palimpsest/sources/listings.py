"""Listings of a paged web interface as a table and as a stream.

An interface is a function of parameters that answers with ``{"query": {items: [...]}, "continue": {...}}``; ``continue``, if there,
holds what the next request must add. :func:`register` makes a data source of it:

    register(spark, "wiki", call)
    spark.read.format("wiki").option("roots", '["Category:A", "Category:B"]').option("items", "categorymembers").load()
    spark.readStream.format("wiki")...load()

Read as a table, each root is a partition, so roots are listed by as many tasks, and a task that dies lists its roots again. Read as a
stream, the offset is the continuation of each root: a micro-batch takes the next page of every root that is not at its end, and a query that
is stopped goes on at its tokens.

Options: ``roots`` (JSON list), ``root`` (the parameter that names one, ``cmtitle``), ``items`` (the key of the items), ``params`` (JSON, further
parameters), ``limit`` (items of a root, none: all), ``tries`` (requests for one page, 3), ``wait`` (seconds before the second request, doubled each
time, 1). A page that fails ``tries`` times fails the task, or in a stream waits for the next micro-batch; with ``onFailure`` = ``end`` it ends
its root's listing with what came before, as an interface does that answers nothing.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.scripts import TAMIL, ScriptProfile

Interface = Callable[[dict], dict]
LISTED = "root string, place long, item string"


class Listing:
    """One listing's parameters and how its pages are asked for."""

    def __init__(self, call: Interface, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}
        self.call, self.roots, self.root, self.items = call, json.loads(get.get("roots", "[]")), get.get("root", "cmtitle"), get.get("items", "categorymembers")
        self.params, self.limit = json.loads(get.get("params", "{}")), int(get["limit"]) if "limit" in get else None
        self.tries, self.wait, self.ends = int(get.get("tries", 3)), float(get.get("wait", 1)), get.get("onfailure", "error") == "end"
        if not self.roots or len(set(self.roots)) < len(self.roots):
            raise ValueError("roots must be a JSON list of different names")

    def page(self, root: str, token: dict | None) -> tuple[list[dict], dict | None]:
        """The items of a page and the continuation, if there is one."""
        for attempt in range(self.tries):
            try:
                answer = self.call({**self.params, self.root: root, **(token or {})})
                return answer.get("query", {}).get(self.items, []), answer.get("continue")
            except Exception:
                if attempt + 1 == self.tries:
                    if self.ends:
                        return [], None
                    raise
                time.sleep(self.wait * 2**attempt)
        return [], None

    def rows(self, root: str) -> Iterator[tuple[str, int, str]]:
        """All items of a root, up to the limit; no page is asked for that the limit does not need."""
        token, seen = None, 0
        while self.limit is None or seen < self.limit:
            found, token = self.page(root, token)
            for item in found if self.limit is None else found[: self.limit - seen]:
                yield root, seen, json.dumps(item, ensure_ascii=False)
                seen += 1
            if not token:
                return


class RootPartition(InputPartition):
    def __init__(self, root: str):
        super().__init__(root)


class ListingReader(DataSourceReader):
    def __init__(self, listing: Listing):
        self.listing = listing

    def partitions(self) -> list[InputPartition]:
        return [RootPartition(root) for root in self.listing.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.listing.rows(partition.value)


class ListingStream(SimpleDataSourceStreamReader):
    """Offsets hold for each root: ``next``, what its next request adds (null at the start), ``seen``, the items so far, and ``over``."""

    def __init__(self, listing: Listing):
        self.listing = listing

    def initialOffset(self) -> dict:
        return {root: {"next": None, "seen": 0, "over": False} for root in self.listing.roots}

    def _page(self, root: str, at: dict) -> tuple[list[tuple], dict]:
        found, token = self.listing.page(root, at["next"])
        if self.listing.limit is not None:
            found = found[: self.listing.limit - at["seen"]]
        seen = at["seen"] + len(found)
        rows = [(root, at["seen"] + k, json.dumps(item, ensure_ascii=False)) for k, item in enumerate(found)]
        return rows, {"next": token, "seen": seen, "over": not token or seen == self.listing.limit}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end, rows = dict(start), []
        for root, at in start.items():
            if not at["over"]:
                try:
                    found, end[root] = self._page(root, at)
                    rows += found
                except Exception:
                    continue  # the page is asked for again in the next micro-batch
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same pages again: a root that moved is asked from its token on until it has seen as many items."""
        for root, at in start.items():
            while at["seen"] < end[root]["seen"]:
                rows, at = self._page(root, at)
                yield from rows
                if at["over"]:
                    break


def register(spark: SparkSession, name: str, call: Interface) -> None:
    """Make ``call`` the data source ``name``; it goes to the workers with the source."""

    class Listed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LISTED

        def reader(self, schema) -> DataSourceReader:
            return ListingReader(Listing(call, self.options))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return ListingStream(Listing(call, self.options))

    spark.dataSource.register(Listed)


def listed(spark: SparkSession, name: str, roots: list[str], stream: bool = False, **options: str) -> DataFrame:
    """The listing of ``roots`` by the source ``name``."""
    reader = (spark.readStream if stream else spark.read).format(name).option("roots", json.dumps(roots, ensure_ascii=False))
    return reader.options(**options).load()


def members(listing: DataFrame) -> DataFrame:
    """(category, title, kind) for :func:`.readers.crawl_titles` from items with ``title`` and ``type`` (or the name space 14 of categories)."""
    item = F.from_json("item", "title string, type string, ns int")
    kind = F.when((item["type"] == "subcat") | (item["type"].isNull() & (item["ns"] == 14)), "subcat").when(item["type"].isNull() | (item["type"] == "page"), "page").otherwise(item["type"])
    return listing.select(F.col("root").alias("category"), item["title"].alias("title"), kind.alias("kind")).where("title is not null")


def crawled(spark: SparkSession, name: str, roots: list[str], **options: str) -> DataFrame:
    """Titles to fetch, each once: the roots' pages and, listed in a second read, those of their subcategories one level down.

    The subcategories' names are the second read's partitions, so they pass the driver, as the files of any source do.
    """
    first = members(listed(spark, name, roots, **options))
    below = sorted({r.title for r in first.where("kind = 'subcat'").select("title").distinct().toLocalIterator()} - set(roots))
    every = first.unionByName(members(listed(spark, name, below, **options))) if below else first
    return every.where("kind = 'page'").select("title").distinct()


def page_texts(titles: DataFrame, call: Interface, profile: ScriptProfile = TAMIL, least: int = 100, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(title, extract, wikitext, error): the texts of each title from the interface; a title that fails is a row with its error.

    The wiki text is asked for only where the extract has fewer than ``least`` letters; :func:`..operators.corpus.page_text` chooses.
    """
    letter = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), profile.letters) + "]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(**params: str) -> list[dict]:
            for attempt in range(tries):
                try:
                    return list(call({"action": "query", **params}).get("query", {}).get("pages", {}).values())
                except Exception:
                    if attempt + 1 == tries:
                        raise
                    time.sleep(wait * 2**attempt)
            return []

        def texts(title: str) -> tuple[str | None, str | None, str | None]:
            try:
                extract = next((p["extract"] for p in ask(titles=title, prop="extracts", explaintext="1") if p.get("extract")), None)
                if len(letter.findall(extract or "")) >= least:
                    return extract, None, None
                found = ask(titles=title, prop="revisions", rvprop="content", rvslots="main", rvlimit="1")
                return extract, next((r["slots"]["main"]["*"] for p in found for r in p.get("revisions", [])), None), None
            except Exception as e:  # one title's failure is reported in its row
                return None, None, str(e)

        for batch in batches:
            yield pd.DataFrame([(t, *texts(t)) for t in batch.title], columns=["title", "extract", "wikitext", "error"], dtype=object)

    return titles.select("title").mapInPandas(run, "title string, extract string, wikitext string, error string")
