"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 consecutive words of the benchmark items (an item of fewer words is one window).
Texts and patterns are arrays of word hashes. For each pattern length a table gives, for every block of two
words, how far the search may shift: blocks that stand in no pattern shift it past themselves. Many cursors run
through the text in lockstep, each over its own stretch. Where the shift is nought, the hash of the last block
selects the patterns that end so, the hash of the first block rules most of them out, and the rest are compared
byte by byte.

Words are the runs of bytes other than those below ``0``, between ``9`` and ``a`` and above ``z`` up to 0x7F,
after lower-casing A-Z; every byte of a non-ASCII character is a word byte. Null texts have no words, and an item
without words has no window. Items with a null item_id still count as hits but are not named. Repeated items and
repeated documents give the results of one; a word that several items hit is hit once, and equal windows belong to all their items. Very long
texts are searched whole. Empty tables give no hits or no rows. The benchmark is read and broadcast in blocks of
checked size, one at a time; the hits of several blocks are united per document.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import BASE, LOWER, column_bytes, mix, slices, word_bounds, word_hashes
from .shared import materialize

WINDOW = 10
#: Benchmark text bytes searched for in one pass over the documents, and so broadcast at once.
BLOCK_BYTES = 16 << 20
#: Words of text that one cursor runs through, and the size of the shift tables.
STRETCH, TABLE_BITS = 512, 18

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def normal_words(text: str | None) -> list[bytes]:
    body = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_bounds(WORD[body], np.array([0, len(body)]))
    raw = body.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * BASE + b)


class PatternSet:
    """All patterns of one length in words, with their shift, suffix and prefix tables."""

    def __init__(self, length: int, owners: dict[bytes, list[int]]):
        self.length, self.block = length, min(2, length)
        self.texts = list(owners)
        self.items = [np.array(sorted(set(owners[t])), np.int64) for t in self.texts]
        body = np.frombuffer(b"".join(t + b" " for t in self.texts), np.uint8)
        starts, ends, _ = word_bounds(WORD[body], np.array([0, len(body)]))
        words = word_hashes(body, starts, ends).reshape(-1, length)
        blocks = _pair(words[:, :-1], words[:, 1:]) if self.block == 2 else words
        most = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, most, np.int16)
        for j in range(blocks.shape[1]):
            np.minimum.at(self.shift, self._slot(blocks[:, j]), blocks.shape[1] - 1 - j)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.order, self.suffix, self.prefix = order, blocks[order, -1], blocks[order, 0]
        self.bytes = [np.frombuffer(t + b" ", np.uint8) for t in self.texts]

    @staticmethod
    def _slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (of the first word) and patterns whose last and first blocks agree."""
        none = np.empty(0, np.int64)
        n = len(words)
        if n < self.length:
            return none, none
        blocks = _pair(words[:-1], words[1:]) if self.block == 2 else words
        first = self.length - self.block  # the block that ends the first window
        at = np.arange(first, len(blocks), STRETCH)
        stop = np.minimum(at + STRETCH, len(blocks))
        found = []
        slots = self._slot(blocks)
        while len(at):
            step = self.shift[slots[at]]
            ends_here = at[step == 0]
            if len(ends_here):
                found.append(ends_here)
            at = at + np.maximum(step, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        if not found:
            return none, none
        ends = np.concatenate(found)
        lo = np.searchsorted(self.suffix, blocks[ends], "left")
        count = np.searchsorted(self.suffix, blocks[ends], "right") - lo
        places, patterns = [], []
        for part in np.array_split(np.arange(len(ends)), max(1, int(count.sum()) >> 20)):
            c = count[part]
            k = np.repeat(lo[part] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
            place = np.repeat(ends[part] - first, c)
            same = self.prefix[k] == blocks[place]
            places.append(place[same])
            patterns.append(self.order[k[same]])
        return np.concatenate(places), np.concatenate(patterns)


class Searcher:
    def __init__(self, items: list[tuple[int | None, str | None]]):
        """items: (number of the item within the block, text)."""
        by_length: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for number, text in items:
            words = normal_words(text)
            length = min(WINDOW, len(words))
            for i in range(len(words) - length + 1 if length else 0):
                by_length[length][b" ".join(words[i : i + length])].append(number)
        self.sets = [PatternSet(length, owners) for length, owners in sorted(by_length.items())]

    def search(self, body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For one slice of texts: words before each document, which words are hit, and (document, item) that occur."""
        body = LOWER[body]
        is_word = WORD[body]
        starts, ends, firsts = word_bounds(is_word, offs)
        hit = np.zeros(len(starts) + 1, np.int64)
        docs, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(starts):
            words = word_hashes(body, starts, ends)
            doc_of = np.searchsorted(firsts, np.arange(len(starts)), "right") - 1
            lengths = ends - starts
            begin = np.concatenate(([0], np.cumsum(lengths + 1)))  # of each word when words are joined by single spaces
            joined = None
            for s in self.sets:
                place, pattern = s.candidates(words)
                within = doc_of[place] == doc_of[place + s.length - 1]
                place, pattern = place[within], pattern[within]
                if not len(place):
                    continue
                if joined is None:
                    joined = np.full(begin[-1], 32, np.uint8)
                    joined[np.arange(lengths.sum()) + np.repeat(np.arange(len(starts)), lengths)] = body[is_word]
                order = np.argsort(pattern, kind="stable")
                place, pattern = place[order], pattern[order]
                cuts = np.flatnonzero(np.diff(pattern)) + 1
                for group in np.split(np.arange(len(place)), cuts):
                    number = int(pattern[group[0]])
                    wanted, at = s.bytes[number], place[group]
                    at = at[begin[at + s.length] - begin[at] == len(wanted)]
                    for some in np.array_split(at, max(1, len(at) * len(wanted) >> 22)):
                        some = some[(joined[begin[some][:, None] + np.arange(len(wanted))] == wanted).all(axis=1)]
                        if len(some):
                            np.add.at(hit, some, 1)
                            np.add.at(hit, some + s.length, -1)
                            which = np.unique(doc_of[some])
                            docs.append(np.repeat(which, len(s.items[number])))
                            items.append(np.tile(s.items[number], len(which)))
        return firsts, np.cumsum(hit[:-1]) > 0, np.concatenate(docs), np.concatenate(items)


Block = list[tuple[int | None, str]]


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks of about BLOCK_BYTES of text, read one at a time: a stated query set."""
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1  # half full on average, as hashes fill them
    dealt = known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r[0], r[1]) for r in dealt.where(F.col("block") == k).select("item_id", "text").collect()]


_built: list = [None, None]


def _searcher(block: Block) -> Searcher:
    """The tables of a block, built once in a worker process."""
    if _built[0] is not block:
        _built[:] = block, Searcher([(i, text) for i, (_, text) in enumerate(block)])
    return _built[1]


RUNS = "array<struct<start:int,end:int>>"


def _scan(docs: DataFrame, block: Block, runs: bool) -> DataFrame:
    """One pass over the documents for one block of items; runs: give the hit runs, too."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    fields = "doc_id long, n_words long, n_hit long, items array<long>" + (f", runs {RUNS}" if runs else "")

    def run(batches):
        searcher = _searcher(shared.value)
        ids = np.array([-1 if item is None else item for item, _ in shared.value], np.int64)
        named = np.array([item is not None for item, _ in shared.value], bool)
        for batch in batches:
            body, offs = column_bytes(batch.column("text"))
            for lo, hi, part, po in slices(body, offs):
                firsts, hit, docs_hit, items_hit = searcher.search(part, po)
                per_doc: dict[int, set[int]] = defaultdict(set)
                for d, i in zip(docs_hit.tolist(), items_hit.tolist(), strict=True):
                    if named[i]:
                        per_doc[d].add(int(ids[i]))
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[firsts[1:]] - total[firsts[:-1]]
                columns = {
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                    "n_words": pa.array(np.diff(firsts), pa.int64()),
                    "n_hit": pa.array(n_hit, pa.int64()),
                    "items": pa.array([sorted(per_doc.get(d, ())) for d in range(hi - lo)], pa.list_(pa.int64())),
                }
                if runs:
                    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                    columns["runs"] = pa.array([_runs(hit[firsts[d] : firsts[d + 1]]) if n_hit[d] else [] for d in range(hi - lo)], pa.list_(span))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, fields)


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    """The hit runs."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
    return [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)]


def _covered(runs: Column) -> Column:
    """Words in any of the runs: a fold over them in order."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    step = lambda acc, r: F.struct((acc["total"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], acc["end"]))).alias("total"), F.greatest(acc["end"], r["end"]).alias("end"))
    return F.aggregate(F.array_sort(runs), start, step)["total"].cast("long")


def find_overlaps(docs: DataFrame, items: DataFrame, tag: str = "decontaminate") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted array of the item ids that occur)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = _blocks(items)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(docs, first, runs=False)
    # More benchmark than one broadcast holds: each block makes its own pass, ends in a table, and a document's hits are united.
    keyed = materialize(docs.withColumn("row", F.monotonically_increasing_id()), tag)
    rows = keyed.select(F.col("row").alias("doc_id"), "text")
    parts = [materialize(_scan(rows, block, runs=True), tag) for block in itertools.chain((first, second), blocks)]
    merged = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("runs")).alias("runs"),  # one entry per block
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select(F.col("doc_id").alias("row"), "n_words", _covered(F.col("runs")).alias("n_hit"), "items").join(keyed.select("row", "doc_id"), "row").select("doc_id", "n_words", "n_hit", "items")


def report(overlaps: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return overlaps.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their columns."""
    out = docs
    for k, block in enumerate(_blocks(items)):
        out = _drop(materialize(out, "clean") if k else out, block)
    return out


def _drop(docs: DataFrame, block: Block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        searcher = _searcher(shared.value)
        for batch in batches:
            body, offs = column_bytes(batch.column("text"))
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, part, po in slices(body, offs):
                _, _, docs_hit, _ = searcher.search(part, po)
                keep[lo + docs_hit] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` against every window of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, least(10, len(ws)) AS n, unnest([array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') for i in range(1, len(ws) - least(10, len(ws)) + 2)]) AS win FROM b WHERE len(ws) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
l AS (SELECT DISTINCT n FROM p),
o AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest([array_to_string(ws[i : i + n - 1], ' ') for i in range(1, len(ws) - n + 2)]) AS win FROM d, l WHERE len(ws) >= n),
m AS (SELECT DISTINCT o.doc_id, o.i, o.n, p.item_id FROM o JOIN p ON o.n = p.n AND o.win = p.win),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
