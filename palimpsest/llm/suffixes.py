"""Exact substring deduplication with a distributed sparse suffix array.

Every byte covered by a string of LENGTH (400) bytes that also starts anywhere else is removed, whole texts, all copies.

1. *Anchors.* Each 400-byte string is owned by one anchor, the position in it whose 201 following bytes have the
   smallest hash; equal strings have equal anchors at equal offsets. About one position in a hundred is an anchor,
   and only anchors are suffixes of the sparse array. An anchor carries a hash of those 201 bytes and one of its
   whole context, the bytes that any string it owns can reach (at most 199 before it and 400 from it).
2. *Filter.* Anchors whose 201 bytes stand nowhere else own no repeated string. Anchors whose whole context stands
   elsewhere too own repeated strings only. What is left lies at the edges of repeats. Map tasks first
   remove what repeats among their own documents, so a passage in very many documents stays a few rows.
3. *Suffix array.* The contexts at the edges (and one of each repeated context beside them) are range-partitioned by
   sampled splitters on the suffix's leading bytes. Each bucket sorts its suffixes by multikey quicksort, sorts the
   reversed left contexts likewise, and reads equal strings off both LCP arrays: two strings at the same offset are
   equal if neither LCP between them falls short. This compares bytes, not hashes.
4. *Boundaries.* A splitter bounds the LCP of anything below it with anything above. Strings that a bucket's
   splitters cannot tell from the next bucket's are exchanged, one per bucket, as 128-bit digests and counted.

Functions that take a ``length`` do the same with strings of that many bytes; the figures above are those of 400.

Defined cases: a null text is empty; texts under 400 bytes lose nothing; very long texts are processed whole; rows of equal doc_id and text are separate
occurrences and get equal results; a null doc_id is carried through; an empty table gives an empty result. Further
columns are kept by :func:`drop_repeats`, whatever they are called.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import column_bytes, mix, powers, slices
from .shared import discard, materialize

LENGTH = 400
#: A repeated passage of more than WORDS words is long, and has PASSAGE_BYTES bytes at least: a letter a word and spaces between.
WORDS = 50
PASSAGE_BYTES = 2 * (WORDS + 1) - 1
#: Bytes of text among which a map task removes repeats first, and bytes of contexts in a bucket.
CHUNK_BYTES, BUCKET_BYTES = 32 << 20, 4 << 20
#: Suffixes sampled for the splitters: a fixed bound on what reaches the driver.
SAMPLE = 4096

PLAIN, BYPASS, DONE, MULTI, DIVERSE = 0, 1, 2, 4, 8
ANCHOR = "k long, f long, doc long, th long, place long"
_NO_ID = -(1 << 63)


def _identity() -> list[Column]:
    """What tells a row from others unless they are equal in id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("th")]


def width_of(length: int) -> int:
    """Grams in a string of ``length`` bytes; they have length - width + 1 bytes, and the smallest one's place is the anchor."""
    return length // 2


def pack(at, before, after, state):
    """Anchor position, distances from it to the first and last start it owns, state bits."""
    return (at << 20) | (before << 12) | (after << 4) | state


def unpack(place):
    return place >> 20, (place >> 12) & 255, (place >> 4) & 255, place & 15


def sliding_owner(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the smallest value among ``width``, the leftmost of equals (values' upper halves count)."""
    low = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    reach = 1  # low holds the smallest of so many
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(values) - width + 1], low[width - reach :])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(body: np.ndarray, offs: np.ndarray, length: int = LENGTH):
    """Document, position within it, distances to the owned starts, gram hash and context hash of each anchor."""
    none = np.empty(0, np.int64)
    width = width_of(length)
    gram = length - width + 1
    if len(body) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(body) - gram + 1])
    owner = sliding_owner(grams, width)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(owner)]
    starts = np.flatnonzero(np.arange(len(owner)) + length <= offs[doc + 1])
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    own, d = owner[starts], doc[starts]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (d[1:] != d[:-1]))))
    first, last = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
    at, d = own[new], d[new]
    lo, hi = np.maximum(offs[d], at - width + 1), np.minimum(offs[d + 1], at + length)
    context = mix((sums[hi] - sums[lo]) * down[lo] + mix((at - lo).astype(np.uint64) * np.uint64(1021) + (hi - at).astype(np.uint64)))
    return d, at - offs[d], at - first, at - last, grams[at], context


def _anchor_rows(batches, length: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        if not held:
            return
        doc, th, at, before, after, k, f = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((f, k))
        k, f = k[order], f[order]
        new_k = np.concatenate(([True], k[1:] != k[:-1]))
        new_f = new_k | np.concatenate(([True], f[1:] != f[:-1]))
        head = np.flatnonzero(new_f)
        copies = np.diff(np.concatenate((head, [len(k)])))
        group = np.cumsum(new_k) - 1
        kinds = np.bincount(group[head])  # different contexts of each gram
        state = np.full(len(k), DONE)
        state[head] = np.where(copies > 1, MULTI, PLAIN) | np.where(kinds[group[head]] > 1, DIVERSE, 0) | np.where(new_k[head], 0, BYPASS)
        k = np.where(state == DONE, mix(f + order.astype(np.uint64)), k)
        f = np.where(state == DONE, k, f)
        yield pa.RecordBatch.from_pydict(
            {
                "k": pa.array(k.view(np.int64)), "f": pa.array(f.view(np.int64)), "doc": pa.array(doc[order]), "th": pa.array(th[order]),
                "place": pa.array(pack(at[order], before[order], after[order], state)),
            }
        )

    for batch in batches:
        body, offs = column_bytes(batch.column("text"))
        docs, ths = batch.column("doc").to_numpy(), batch.column("th").to_numpy()
        for lo, hi, part, po in slices(body, offs):
            d, at, before, after, k, f = anchors(part, po, length)
            if len(d):
                held.append((docs[lo + d], ths[lo + d], at, before, after, k, f))
            size += len(part)
            if size >= CHUNK_BYTES * length // LENGTH:  # shorter strings have more anchors
                yield from flush()
                held, size = [], 0
    yield from flush()


def _runs(batches, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The batches of sorted rows as arrays that never cut a run of equal ``names``."""
    held: list[dict[str, np.ndarray]] = []

    def joined(parts):
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        key = [rows[n] for n in names]
        same_as_last = np.logical_and.reduce([k == k[-1] for k in key])
        tail = int(np.flatnonzero(~same_as_last)[-1]) + 1 if not same_as_last.all() else 0
        if tail or (held and any(held[-1][n][-1] != rows[n][0] for n in names)):
            head = {c: v[:tail] for c, v in rows.items()}
            if held and tail:
                yield joined([*held, head])
            elif held:
                yield joined(held)
            elif tail:
                yield head
            held = []
        held.append({c: v[tail:] for c, v in rows.items()})
    if held:
        yield joined(held)


def _batch(rows: dict[str, np.ndarray], keep: np.ndarray | slice = slice(None)) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(v[keep]) for c, v in rows.items()})


def _gram_filter(batches) -> Iterator[pa.RecordBatch]:
    """Sorted by gram: anchors of grams that stand once go; those of grams with several contexts are marked."""
    for rows in _runs(batches, ["k"]):
        state = rows["place"] & 15
        judged = (state & 3) == PLAIN
        yield _batch(rows, ~judged)
        rows = {c: v[judged] for c, v in rows.items()}
        k, f, state = rows["k"], rows["f"], state[judged]
        if not len(k):
            continue
        new = np.concatenate(([True], k[1:] != k[:-1]))
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.concatenate((head, [len(k)])))
        marks = np.bitwise_or.reduceat(state, head)
        diverse = (np.minimum.reduceat(f, head) != np.maximum.reduceat(f, head)) | (marks & DIVERSE > 0)
        shared = (size > 1) | (marks & (MULTI | DIVERSE) > 0)
        rows["place"] = rows["place"] | np.where(diverse[group], DIVERSE, 0)
        yield _batch(rows, shared[group])


REPEATED, SHOWN, EDGE = 0, 1, 2


def _context_filter(batches) -> Iterator[pa.RecordBatch]:
    """Sorted by gram and context: what repeats whole, what must be shown to the edges beside it, and the edges."""
    for rows in _runs(batches, ["k", "f"]):
        k, f, state = rows["k"], rows["f"], rows["place"] & 15
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])))
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.concatenate((head, [len(k)])))
        again = (size > 1) | (np.bitwise_or.reduceat(state, head) & (MULTI | DONE) > 0)
        kind = np.where(again[group], np.where(new & (state & DIVERSE > 0), SHOWN, REPEATED), EDGE)
        rows["place"] = (rows["place"] >> 4 << 4) | kind
        yield _batch({c: rows[c] for c in ("doc", "th", "place")})


def _item_rows(batches, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offs = column_bytes(batch.column("text"))
        raw = body.tobytes()
        places = batch.column("places")
        values, po = places.flatten().to_numpy(), np.asarray(places.offsets) - places.offsets[0].as_py()
        row = np.repeat(np.arange(batch.num_rows), np.diff(po))
        at, before, after, kind = unpack(values)
        lo, hi = np.maximum(0, at - width_of(length) + 1), np.minimum(np.diff(offs)[row], at + length)
        base = offs[row]
        contexts = [raw[s:e] for s, e in zip((base + lo).tolist(), (base + hi).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "doc": batch.column("doc").take(pa.array(row)), "th": batch.column("th").take(pa.array(row)), "place": pa.array(values),
                "cut": pa.array((at - lo).astype(np.int32)), "context": pa.array(contexts, pa.binary()),
            }
        )


ITEM = "doc long, th long, place long, cut int, context binary"


def multikey_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings and the LCP of each with the one before it (0 for the first).

    Multikey quicksort with characters of eight bytes: each round splits every run that is still equal by its next
    character into less, equal and greater, all runs of a round in one vectorised pass.
    """
    n, most = len(strings), max(map(len, strings), default=0)
    rounds = most // 8 + 1
    lengths = np.fromiter(map(len, strings), np.int64, n)
    grid = np.frombuffer(b"".join(s.ljust(rounds * 8, b"\0") for s in strings), ">u8").reshape(n, rounds)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    run = np.zeros(n, np.int64)  # the run of each place in the order
    live = np.arange(n) if n > 1 else np.empty(0, np.int64)
    for depth in range(rounds + 1):
        if not len(live):
            break
        # The last round tells strings apart that differ in trailing zero bytes only.
        key = (grid[order[live], depth] if depth < rounds else lengths[order[live]]).astype(np.uint64)
        by = np.lexsort((key, run[live]))
        order[live], key, r = order[live[by]], key[by], run[live]
        differs = np.flatnonzero((r[1:] == r[:-1]) & (key[1:] != key[:-1])) + 1
        x = key[differs] ^ key[differs - 1]
        lead = np.zeros(len(x), np.int64)  # equal leading bytes
        for byte in range(1, 8):
            lead += x < np.uint64(1) << np.uint64(64 - 8 * byte)
        lcp[live[differs]] = 8 * depth + lead if depth < rounds else most
        begins = np.concatenate(([True], r[1:] != r[:-1]))
        begins[differs] = True
        group = np.cumsum(begins) - 1
        run[live] = live[begins][group]
        size = np.bincount(group)[group]
        if depth == rounds:
            lcp[live[~begins]] = most
        live = live[size > 1]
    if n:
        lcp[1:] = np.minimum(lcp[1:], np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return order, lcp


def _common(string: bytes, others: list[bytes]) -> np.ndarray:
    """LCP of ``string`` with each of the others."""
    width = max(len(string), max(map(len, others), default=0), 1)
    a = np.frombuffer(string.ljust(width, b"\0"), np.uint8)
    grid = np.frombuffer(b"".join(o.ljust(width, b"\0") for o in others), np.uint8).reshape(-1, width)
    differs = grid != a
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return np.minimum(lcp, np.minimum(len(string), np.fromiter(map(len, others), np.int64, len(others))))


def bucket_repeats(contexts: list[bytes], cuts: np.ndarray, near: np.ndarray, far: np.ndarray, low: bytes | None, high: bytes | None, length: int = LENGTH):
    """Repeated strings among the contexts of one bucket.

    near, far: the smallest and largest distance from an owned start to the anchor; low, high: the splitters' suffixes.
    Gives (item, distance) of repeats, and of strings to exchange across the boundaries as (item, distance, repeated).
    """
    n = len(contexts)
    right = [c[k:] for c, k in zip(contexts, cuts.tolist(), strict=True)]
    left = [c[:k][::-1] for c, k in zip(contexts, cuts.tolist(), strict=True)]
    order_r, lcp_r = multikey_sort(right)
    order_l, lcp_l = multikey_sort(left)
    reach = np.zeros(n, np.int64)
    for s in (low, high):
        if s is not None:
            reach = np.maximum(reach, _common(s, right))
    found, told = [], []
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(near.min()), int(far.max()) + 1) if n else ():
        here = np.flatnonzero((near <= d) & (d <= far))
        if not len(here):
            continue
        class_r[order_r] = np.cumsum(lcp_r < length - d)
        class_l[order_l] = np.cumsum(lcp_l < d) if d else 0
        _, first, which, count = np.unique(class_r[here] * (n + 1) + class_l[here], return_index=True, return_inverse=True, return_counts=True)
        repeated = count[which] > 1
        found.append((here[repeated], np.full(repeated.sum(), d)))
        shown = first[reach[here[first]] >= length - d]
        told.append((here[shown], np.full(len(shown), d), repeated[shown]))
    joined = lambda parts, k: tuple(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(k))
    return joined(found, 2), joined(told, 3)


FOUND = "doc long, th long, first int, last int, digest binary, again boolean"


def _bucket_rows(splitters: list[tuple[bytes, bytes]], length: int):
    def one(part: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = part.column("bucket")[0].as_py()
        contexts = part.column("context").to_pylist()
        at, before, after, kind = unpack(part.column("place").to_numpy())
        low = splitters[bucket - 1][0] if bucket else None
        high = splitters[bucket][0] if bucket < len(splitters) else None
        cuts = part.column("cut").to_numpy().astype(np.int64)
        (item, d), (t_item, t_d, t_again) = bucket_repeats(contexts, cuts, after, before, low, high, length)
        doc, th = part.column("doc").to_numpy(), part.column("th").to_numpy()
        mine = kind[item] == EDGE
        item, start = item[mine], (at[item] - d)[mine]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1))) if len(item) else np.empty(0, bool)
        head = np.flatnonzero(new)
        last = start[np.concatenate((head[1:], [len(start)])) - 1] if len(head) else start
        yield _found(doc[item[head]], th[item[head]], start[head], last, [None] * len(head), [True] * len(head))
        s = cuts[t_item] - t_d
        digests = [hashlib.blake2b(contexts[i][a : a + length], digest_size=16).digest() for i, a in zip(t_item.tolist(), s.tolist(), strict=True)]
        start = at[t_item] - t_d
        again = t_again.astype(bool) | (kind[t_item] != EDGE)
        yield _found(doc[t_item], th[t_item], start, start, digests, again.tolist())

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column("bucket")[0].as_py() != bucket[lo]:
                    yield from one(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from one(pa.Table.from_batches(held).combine_chunks())

    return run


def _found(doc, th, first, last, digests, again) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "doc": pa.array(doc), "th": pa.array(th), "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32)),
            "digest": pa.array(digests, pa.binary()), "again": pa.array(again, pa.bool_()),
        }
    )


def _splitters(items: DataFrame, count: int, size: int) -> list[tuple[bytes, bytes]]:
    """Composite keys (suffix, reversed left context) that cut the items into buckets, from a sample of fixed size."""
    buckets = -(-size // BUCKET_BYTES)
    if buckets < 2:
        return []
    rows = items.select("cut", "context").sample(fraction=min(1.0, SAMPLE / count), seed=7).limit(2 * SAMPLE).collect()
    keys = sorted({(bytes(r.context[r.cut :]), bytes(r.context[: r.cut][::-1])) for r in rows})
    return sorted({keys[i * len(keys) // buckets] for i in range(1, buckets)}) if keys else []


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, th, starts): first and last of the runs of starts of repeated strings, for each identity that has any."""
    texts = docs.select(*_identity(), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(lambda batches: _anchor_rows(batches, length), ANCHOR)
    by_gram = F.when(F.col("place").bitwiseAND(3) == PLAIN, F.col("k")).otherwise(F.col("f"))
    # Two tables, so that the first shuffle's files, the largest there are, are gone before the second.
    shared = materialize(rows.withColumn("by", by_gram).repartition("by").drop("by").sortWithinPartitions("k").mapInArrow(_gram_filter, ANCHOR), "grams")
    judged = materialize(shared.repartition("k", "f").sortWithinPartitions("k", "f").mapInArrow(_context_filter, "doc long, th long, place long"), "anchors")
    discard(shared)
    kind = F.col("place").bitwiseAND(15)
    shown = judged.where(kind != REPEATED).groupBy("doc", "th").agg(F.collect_set("place").alias("places"))
    once = texts.join(shown, ["doc", "th"])
    items = materialize(once.mapInArrow(lambda batches: _item_rows(batches, length), ITEM), "suffixes")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("context")), F.lit(0))).first()
    splitters = _splitters(items, count, size)
    cuts = docs.sparkSession.sparkContext.broadcast(splitters)

    def assign(batches):
        for batch in batches:
            bucket = [bisect.bisect_right(cuts.value, (c[k:], c[:k][::-1])) for c, k in zip(batch.column("context").to_pylist(), batch.column("cut").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], [*batch.schema.names, "bucket"])

    def sort(batches):
        yield from _bucket_rows(cuts.value, length)(batches)

    dealt = items.mapInArrow(assign, ITEM + ", bucket int").repartition("bucket").sortWithinPartitions("bucket")
    found = materialize(dealt.mapInArrow(sort, FOUND), "repeats")
    here = found.where("digest is null").select("doc", "th", "first", "last")
    told = found.where("digest is not null")
    across = told.groupBy("digest").agg(F.count("*").alias("n"), F.bool_or("again").alias("any")).where("n > 1").select("digest")
    there = told.where("not again").join(across, "digest").select("doc", "th", "first", "last")
    at = F.shiftright("place", 20)
    whole = judged.where(kind != EDGE).select(
        "doc", "th",
        (at - F.shiftright("place", 12).bitwiseAND(255)).cast("int").alias("first"),
        (at - F.shiftright("place", 4).bitwiseAND(255)).cast("int").alias("last"),
    )
    starts = materialize(whole.unionByName(here).unionByName(there).groupBy("doc", "th").agg(F.collect_set(F.struct("first", "last")).alias("starts")), "starts")
    discard(judged, items, found)
    return starts


def _runs_of(row: np.ndarray, first: np.ndarray, last: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """Ranges of rows with those put together that begin up to ``gap`` after the end of others: row, first and last, sorted."""
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    far = np.maximum.accumulate(row << 40 | last)  # the furthest end in the row so far
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (first[1:] > (far[:-1] & ((1 << 40) - 1)) + gap))) if len(row) else np.empty(0, bool)
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(row)]))[: len(head)] - 1
    return row[head], first[head], far[tail] & ((1 << 40) - 1)


def _starts(column: pa.Array) -> tuple[np.ndarray, ...]:
    """The runs of starts of a batch's rows: row, first, last."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
    return row, *(flat.field(n).to_numpy().astype(np.int64) for n in ("first", "last"))


def covered(row: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Maximal byte ranges of the rows covered by the strings that start in the runs: row, begin, end."""
    row, first, last = _runs_of(row, first, last, length)
    return row, first, last + length


_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def long_passages(body: np.ndarray, offs: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts whose strings have more than WORDS words together (those cut at the ends count) or LENGTH bytes."""
    row, first, last = _runs_of(row, first, last, 1)
    long = last + length - first >= LENGTH
    if not long.all():
        ink = ~_BLANK[body]
        words = np.concatenate(([0, 0], np.cumsum(ink[1:] & ~ink[:-1])))  # words that begin after the first byte and before each
        s, e = offs[row] + first, offs[row] + last + length
        long |= ink[s] + words[e] - words[s + 1] > WORDS
    return row[long], first[long], last[long]


def _kept(body: np.ndarray, offs: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """What the ranges leave of the rows."""
    change = np.zeros(len(body) + 1, np.int8)
    change[offs[row] + begin] += 1
    change[offs[row] + end] -= 1
    stay = np.cumsum(change[:-1], dtype=np.int8) == 0
    sizes = np.diff(offs)
    np.subtract.at(sizes, row, end - begin)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(body[stay])])


def _fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _marked(docs: DataFrame, *lengths: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with a column for each length that holds the runs of starts of its repeated strings, and the columns' names."""
    doc, th = (_fresh(n, docs.columns) for n in ("doc", "th"))
    out, names = docs.withColumns(dict(zip((doc, th), _identity(), strict=True))), []
    for length in lengths:
        names.append(_fresh(f"starts{length}", docs.columns))
        found = repeats(docs, length)
        out = out.join(found.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("starts").alias(names[-1])), [doc, th], "left")
    return out.drop(doc, th), names


def _pieces(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


SPANS = "array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (bytes that stay), n_bytes, spans (removed ranges, in bytes).

    With ``passages``, also the ranges of repeated passages of more than WORDS words, which may have fewer than LENGTH bytes and stay in ``kept``.
    """

    def ranges(n: int, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        offs = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(offs, pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["start", "end"]))

    def run(batches):
        for batch in batches:
            body, offs = column_bytes(batch.column("text"))
            cut = covered(*_starts(batch.column("starts400")))
            columns = {"doc_id": batch.column("doc_id"), "kept": _kept(body, offs, *cut), "n_bytes": pa.array(np.diff(offs), pa.int64()), "spans": ranges(batch.num_rows, *cut)}
            if passages:
                long = long_passages(body, offs, *_starts(batch.column("starts101")), PASSAGE_BYTES)
                columns["passages"] = ranges(batch.num_rows, *covered(*long, PASSAGE_BYTES))
            yield pa.RecordBatch.from_pydict(columns)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked, names = _marked(narrow, LENGTH, *[PASSAGE_BYTES] * passages)
    columns = [F.col(n).alias(c) for n, c in zip(names, ("starts400", "starts101"), strict=False)]
    return marked.select("doc_id", "text", *columns).mapInArrow(run, f"doc_id long, kept binary, n_bytes long, spans {SPANS}" + f", passages {SPANS}" * passages)


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with its columns, the text without its repeated strings; a character cut in two goes whole.

    With ``length`` under LENGTH, those of :func:`long_passages` go.
    """
    names = docs.columns
    marked, (starts_,) = _marked(docs, length)

    def run(batches):
        for batch in batches:
            texts, runs = batch.column("text").to_pylist(), _starts(batch.column(starts_))
            row, begin, end = covered(*(long_passages(*column_bytes(batch.column("text")), *runs, length) if length < LENGTH else runs), length)
            of = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for k in np.unique(row).tolist():
                part = slice(of[k], of[k + 1])
                texts[k] = _pieces(texts[k].encode(), list(zip(begin[part].tolist(), end[part].tolist(), strict=True))).decode("utf-8", "ignore")
            columns = [pa.array(texts, batch.column("text").type) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.select(*[F.col(f"`{n}`") for n in names], starts_).mapInArrow(run, docs.schema)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents`` without the bytes of 400-byte strings that stand twice or more.

    n_passages and n_passage_bytes tell of repeated passages of more than 50 words, whatever their bytes; those under 400 bytes are not removed.
    """
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passages=True)
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", size("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"), size("passages").alias("n_passage_bytes"),
    )
