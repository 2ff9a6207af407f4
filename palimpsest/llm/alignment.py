"""Alignment of two tokenizers' tokens by an event sweep, and corpus counts of the pairs that it links.

Both tokenizers encode each text; every token's end is an event at its byte offset. Events travel in blocks: the ids of up to BLOCK
consecutive tokens of one side with the offset at which the first begins, from which the table of token lengths gives all ends. The events of
both sides are united, repartitioned by document and sorted by offset inside partitions, and a machine streams through them. It holds what
has come since the last offset at which both sides end, running totals and a running digest, so its state is one open group and one block
and not the document. Each shared end closes a group; all pairs of a group are links. It emits the distinct pairs of each document with
their numbers, in parts where a document is longer than what is taken at a time.

A pair's count is the number of documents (rows) that hold it; pairs of documents that came in parts are made distinct first. Counts and each
A id's highest are joined back to the documents' pairs: broadcast by Spark only where the written table is under its threshold.

A is a byte-level BPE: ``byte_bpe`` reads the ranks of a JSON vocabulary whose merges stand in the order of their ids (checked) for the
tiktoken library, which gives the ids that the JSON's own library gives and is four times as fast; B is a sentencepiece model. Texts longer than
PIECE_CHARS are cut where no token of either can cross, so that memory follows the piece.

Texts that are null or empty, or that either side does not give back byte for byte with a space before them, have no tokens: zeros and an
empty digest column. Each row is a document: repeated rows and rows without doc_id count and are answered one by one. A group of very many tokens is
linked by its distinct ids, so its pairs are never written out one by one. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import materialize

#: Tokens of an event block, tokens swept at a time, documents encoded at a time, pairs from which a group is linked by its distinct ids.
BLOCK, SWEPT, ENCODED, WIDE = 4096, 1 << 19, 256, 4096
#: Characters of a text that are encoded at a time, at least.
PIECE_CHARS = 1 << 16
EVENTS = "row long, doc_id long, start long, side int, ids binary"
#: Bits of a byte offset beside the number of the document within what is swept at a time.
OFFSET_BITS = 40
_CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Side A: ids and token bytes of a byte-level BPE vocabulary (the content of a JSON file)."""

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        model = json.loads(content)["model"]
        letters, vocabulary = byte_letters(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in pairs]
        known = {*made, *(vocabulary[c] for c in letters)}
        if made != sorted(made) or len(known) != len(pairs) + 256:
            raise ValueError("the merges do not stand in the order of their ids, so ids are no ranks")
        tokens = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if i in known}
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={})
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of a space and each text."""
        out = []
        for text in texts:
            parts = [self.encoding.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p in bpe.pieces(f" {text}", PIECE_CHARS)]
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        return out


class Pieces:
    """Side B: ids and token bytes of a sentencepiece model (the content of its file), which puts a space before each text itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)  # no token goes on behind a space that follows another character

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self._parts(t) for t in texts]
        ids = iter(self.model.encode([p for ps in parts for p in ps], num_threads=1))
        return [np.array(next(ids), np.int64) if len(ps) == 1 else np.concatenate([np.array(next(ids), np.int64) for _ in ps]) for ps in parts]

    def _parts(self, text: str) -> list[str]:
        """Cut at spaces, which the model puts back before each part."""
        out, at = [], 0
        while self.cuts and len(text) - at > PIECE_CHARS and (cut := _CUT.search(text, at + PIECE_CHARS)):
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]


class Pair:
    """Both sides in a worker, made once from what was broadcast."""

    def __init__(self, a: bytes, pattern: str, b: bytes):
        self.a, self.b = ByteBpe(a, pattern), Pieces(b)
        self.sizes = len(self.a.tokens), len(self.b.tokens)
        self.lengths = [np.array([len(t) for t in side.tokens], np.int64) for side in (self.a, self.b)]
        names = [[str(i).encode() for i in range(n)] for n in self.sizes]
        # What stands for a token in a digest: an A id before another or before its group's B ids, a B id before another or before the next group.
        self.said = [[np.array([n + end for n in names[k]], object) for end in ends] for k, ends in enumerate(((b",", b"|"), (b",", b";")))]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        out = []
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True):
            whole = b" " + text.encode()
            # A's tokens are parts of the text in order, so their length says whether all of it is there; B may have changed characters.
            same = int(self.lengths[0][a].sum()) == len(whole) and b"".join(map(self.b.tokens.__getitem__, b.tolist())) == whole
            out.append((a, b) if same else None)
        return out


_pairs: dict[int, Pair] = {}


def _pair(shared) -> Pair:
    key = hash(shared.value)
    if key not in _pairs:
        _pairs[key] = Pair(*shared.value)
    return _pairs[key]


def width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _events(pair: Pair, rows: list[int], doc_ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    out: list[tuple] = []
    encoded = iter(pair.encode([t for t in texts if t]))
    for row, doc_id, text in zip(rows, doc_ids, texts, strict=True):
        sides = next(encoded) if text else None
        if sides is None:
            out.append((row, doc_id, 0, 0, b""))
            continue
        for side, ids in enumerate(sides):
            starts = np.cumsum(pair.lengths[side][ids]) - pair.lengths[side][ids]
            small = ids.astype(width(pair.sizes[side]))
            out += [(row, doc_id, int(starts[k]), side, small[k : k + BLOCK].tobytes()) for k in range(0, len(ids), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["row", "doc_id", "start", "side", "ids"])


class Sweep:
    """The machine of one partition: takes event blocks in order of document and offset, emits totals, digests and pairs."""

    def __init__(self, pair: Pair):
        self.pair, self.open, self.digest = pair, [], None  # blocks of the open group; (row, doc_id, digest so far) of the last document

    def take(self, blocks: list[tuple]) -> Iterator[tuple]:
        """Rows (row, doc_id, n_a, n_b, n_groups, n_links, digest or None, whole, pairs, times) of what the blocks close."""
        going = self.digest[0] if self.digest else None
        blocks = self.open + blocks
        rows = np.array([b[0] for b in blocks], np.int64)
        doc = np.cumsum(np.r_[False, rows[1:] != rows[:-1]])
        ids, ends = zip(*(self._side(blocks, doc, side) for side in (0, 1)), strict=True)
        at = np.searchsorted(ends[1], ends[0])
        shared = np.flatnonzero(ends[1][np.minimum(at, len(ends[1]) - 1)] == ends[0]) if len(ends[1]) else np.empty(0, np.int64)
        last = [shared + 1, at[shared] + 1]  # ends of the groups on both sides
        first = [np.r_[0, e[:-1]].astype(np.int64) for e in last]
        owner = ends[0][shared] >> OFFSET_BITS
        sizes = [e - f for e, f in zip(last, first, strict=True)]
        n_docs = int(doc[-1]) + 1
        bounds = np.searchsorted(owner, np.arange(n_docs + 1))  # groups of each document
        said = self._said(ids, first, last, sizes)
        where, pairs, times = self._links(ids, first, last, sizes, owner)
        cuts = np.searchsorted(where, np.arange(n_docs + 1))
        sums = [np.r_[0, np.cumsum(x)] for x in (sizes[0], sizes[1], sizes[0] * sizes[1])]
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for d in range(n_docs):
            row, doc_id = blocks[heads[d]][:2]
            lo, hi = bounds[d], bounds[d + 1]
            if self.digest and self.digest[0] != row:
                yield from self.end()
            begun = self.digest is not None
            if not begun:
                self.digest = (row, doc_id, hashlib.sha256(), [False])
            if hi > lo:
                text = b"".join(said[(last[0][lo - 1] + last[1][lo - 1]) if lo else 0 : last[0][hi - 1] + last[1][hi - 1]].tolist())[:-1]
                self.digest[2].update(b";" + text if self.digest[3][0] else text)
                self.digest[3][0] = True
            n_a, n_b, n_links = (int(s[hi] - s[lo]) for s in sums)
            whole = d < n_docs - 1 and row != going
            yield row, doc_id, n_a, n_b, int(hi - lo), n_links, None, whole, pairs[cuts[d] : cuts[d + 1]], times[cuts[d] : cuts[d + 1]]
        self.open = self._left(blocks, doc, ids, ends, last)

    def _side(self, blocks: list[tuple], doc: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a side, and of each the document's number and the end as one integer."""
        mine = [k for k, b in enumerate(blocks) if b[3] == side and len(b[4])]
        if not mine:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        parts = [np.frombuffer(blocks[k][4], width(self.pair.sizes[side])) for k in mine]
        ids, counts = np.concatenate(parts).astype(np.int64), np.array([len(p) for p in parts])
        ends = np.cumsum(self.pair.lengths[side][ids])
        before = np.r_[0, ends[np.cumsum(counts)[:-1] - 1]]
        base = (doc[mine] << OFFSET_BITS) + np.array([blocks[k][2] for k in mine], np.int64) - before
        return ids, ends + np.repeat(base, counts)

    def _said(self, ids, first, last, sizes) -> np.ndarray:
        """The tokens of all closed groups as they stand in a digest: a group's A ids, then its B ids."""
        n = [int(e[-1]) if len(e) else 0 for e in last]
        out = np.empty(sum(n), object)
        shift = first[1], last[0]  # B tokens before a group; A tokens up to its end
        for side in (0, 1):
            group = np.repeat(np.arange(len(sizes[side])), sizes[side])
            ending = np.zeros(n[side], bool)
            ending[last[side] - 1] = True
            mine = ids[side][: n[side]]
            out[np.arange(n[side]) + shift[side][group]] = np.where(ending, self.pair.said[side][1][mine], self.pair.said[side][0][mine])
        return out

    def _links(self, ids, first, last, sizes, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each document with their numbers: document's number, pair, times."""
        n_b, bits = self.pair.sizes[1], self.bits
        links = sizes[0] * sizes[1]
        wide = links >= WIDE
        keys, times = [], []
        narrow = np.flatnonzero(~wide)
        # Each A token of a narrow group is repeated once for each B token of it.
        reps = np.repeat(sizes[1][narrow], sizes[0][narrow])
        if len(reps):
            mine = np.repeat(~wide, sizes[0])
            a = np.repeat(ids[0][: len(mine)][mine], reps)
            begin = np.repeat(np.repeat(first[1][narrow], sizes[0][narrow]), reps)
            within = np.arange(len(a)) - np.repeat(np.cumsum(reps) - reps, reps)
            b = ids[1][begin + within]
            key = (np.repeat(np.repeat(owner[narrow], sizes[0][narrow]), reps) << bits) | (a * n_b + b)
            key, count = np.unique(key, return_counts=True)
            keys.append(key)
            times.append(count)
        for g in np.flatnonzero(wide):
            (a, n), (b, m) = (np.unique(ids[s][first[s][g] : last[s][g]], return_counts=True) for s in (0, 1))
            keys.append(((owner[g] << bits) | (a[:, None] * n_b + b)).ravel())
            times.append((n[:, None] * m).ravel())
        if not keys:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        key, count = keys[0], times[0]
        if len(keys) > 1:
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, place, np.concatenate(times))
        return key >> bits, key & ((1 << bits) - 1), count

    @property
    def bits(self) -> int:
        return (self.pair.sizes[0] * self.pair.sizes[1] - 1).bit_length()

    def _left(self, blocks, doc, ids, ends, last) -> list[tuple]:
        """What belongs to no closed group yet, as blocks: always the last document's."""
        row, doc_id = blocks[-1][:2]
        out = []
        for side in (0, 1):
            n = int(last[side][-1]) if len(last[side]) else 0
            if n < len(ids[side]):
                start = int((ends[side][n] & ((1 << OFFSET_BITS) - 1)) - self.pair.lengths[side][ids[side][n]])
                out.append((row, doc_id, start, side, ids[side][n:].astype(width(self.pair.sizes[side])).tobytes()))
        return out

    def end(self) -> Iterator[tuple]:
        """The digest of the document that is over; it is empty where there was no group."""
        if self.digest:
            row, doc_id, digest, (any_,) = self.digest
            yield row, doc_id, 0, 0, 0, 0, digest.hexdigest() if any_ else "", True, np.empty(0, np.int64), np.empty(0, np.int64)
        self.digest = None


def _runs(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The batch's event blocks, about SWEPT tokens at a time."""
    rows, doc_ids, starts, sides = (batch.column(c).to_pylist() for c in ("row", "doc_id", "start", "side"))
    out, size = [], 0
    for k, ids in enumerate(batch.column("ids")):
        block = ids.as_py()
        out.append((rows[k], doc_ids[k], starts[k], sides[k], block))
        size += len(block) // 2
        if size >= SWEPT:
            yield out
            out, size = [], 0
    if out:
        yield out


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: a row per row of ``docs`` (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the linked id pairs
    of the corpus (a_id, b_id, count, best). ``docs`` is read once and must give the same rows in the same partitions when read again."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((bpe.load_ranks(a_path), pattern, bpe.load_ranks(b_path)))  # sizes are checked there
    pair = Pair(*shared.value)
    n_b, small = pair.sizes[1], pair.sizes[0] * pair.sizes[1] <= 1 << 31

    def tokenise(batches):
        pair = _pair(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, ENCODED):
                part = batch.slice(lo, ENCODED)
                yield _events(pair, *(part.column(c).to_pylist() for c in ("row", "doc_id", "text")))

    types = pa.list_(pa.int32() if small else pa.int64()), pa.list_(pa.int64())
    fields = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, whole boolean, pairs array<{'int' if small else 'long'}>, times array<long>"
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def emitted(rows: list[tuple]) -> pa.RecordBatch:
        *columns, pairs, times = zip(*rows, strict=True)
        kinds = [pa.int64()] * 6 + [pa.string(), pa.bool_()]
        lists = []
        for values, kind in zip((pairs, times), types, strict=True):
            offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(kind.value_type.to_pandas_dtype()))))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + lists, names)

    def sweep(batches):
        machine = Sweep(_pair(shared))
        for batch in batches:
            for blocks in _runs(batch):
                if rows := list(machine.take(blocks)):
                    yield emitted(rows)
        if rows := list(machine.end()):
            yield emitted(rows)

    events = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(tokenise, EVENTS)
    found = materialize(events.repartition("row").sortWithinPartitions("row", "start", "side").mapInArrow(sweep, fields), "links")

    # A document that came whole has each pair once; those that came in parts are made distinct first.
    whole = found.where("whole").select(F.explode("pairs").alias("pair"))
    parts = found.where("not whole").select("row", F.explode("pairs").alias("pair")).distinct().select("pair")
    counts = whole.groupBy("pair").agg(F.count("*").alias("n")).unionByName(parts.groupBy("pair").agg(F.count("*").alias("n"))).groupBy("pair").agg(F.sum("n").alias("count"))
    a_id, b_id = F.floor(F.col("pair") / n_b).cast("int"), (F.col("pair") % n_b).cast("int")
    ranked = counts.select("pair", "count", a_id.alias("a_id"), b_id.alias("b_id")).withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a_id")))  # at most B's vocabulary
    pairs = materialize(ranked, "pair-counts")

    links = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    worth = links.join(pairs.select("pair", "count", "best"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    totals = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], F.max("groups_sha256").alias("groups_sha256"))
    out = totals.join(worth, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    return out, pairs.select("a_id", "b_id", "count", "best")


def vocabularies() -> tuple[str, str, str]:
    """Path and pattern of the public English byte-level vocabulary, path of the public sentencepiece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` by both tokenizers: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabularies())[0]
