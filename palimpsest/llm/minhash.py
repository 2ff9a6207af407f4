"""MinHash near-duplicate detection over five-word shingles.

A document's set is its distinct shingles of five words (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; with
fewer words, the whole sequence is the one shingle). Documents whose sets have a Jaccard similarity of 0.75 or
more are linked; components of links are the duplicate groups.

128 universal hash minima per document, cut into 32 bands of four, bring similar documents into common buckets: a
pair at exactly 0.75 shares none with probability (1 - 0.75**4)**32, about 5e-6. A bucket's members are not all
paired with each other: each is paired with the bucket's smallest and with its neighbour. Signatures verify those
pairs, and full sets confirm them. Buckets whose members then still lie in several components are searched again: what
lies outside a bucket's largest component is compared, in blocks of bounded size, with all that lies in other components: first the
best pair of each component, which joins nearly all that belong together, then every pair that is left. Full sets
confirm those too; so no link between groups is lost to the choice of leaders.

Defined cases: documents without text or words have empty sets, are linked with nothing and are kept. Rows
without a doc_id have no component and are kept. Rows that share a doc_id are one document that has the links of
all its rows. Equal sets are linked without a check. Very long texts are taken whole, a slice of their own; a similarity of exactly 0.75 links, and
of documents that tie for a bucket's leader or a component's name the smallest doc_id is taken. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import LOWER, SPACED, column_bytes, mix, shingle_hashes, slices, word_bounds, word_hashes
from .components import components
from .shared import materialize

HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
SHINGLE = 5
#: A link needs 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Equal minima that a pair needs to be looked at in full; at 0.75 the mean is 96 and the deviation 4.9.
AGREE = 70
#: Documents among which a map task removes common bucket keys before they are shuffled.
CHUNK = 1 << 15

_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, np.uint64)
BAND_SALT = _rng.integers(1, 1 << 63, BANDS, np.uint64)


def shingle_sets(body: np.ndarray, offs: np.ndarray):
    """The sorted distinct shingle hashes of each document of a slice."""
    body = LOWER[body]
    starts, ends, firsts = word_bounds(SPACED[body], offs)
    words = word_hashes(body, starts, ends)
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        yield np.unique(shingle_hashes(words[lo:hi], SHINGLE))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash (a * x + b, upper half) over a set."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[i : i + 2048, None] * MULTIPLY + ADD).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id: 128-bit digest of the set, signature) per row; the last two are null for empty sets."""

    def run(batches):
        for batch in batches:
            body, offs = column_bytes(batch.column("text"))
            for lo, hi, part, po in slices(body, offs):
                counts, ids, sigs = [], [], []
                for s in shingle_sets(part, po):
                    counts.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(minima(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_shingles": pa.array(counts, pa.int64()), "set_id": pa.array(ids, pa.binary()), "signature": pa.array(sigs, pa.binary())}
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, set_id binary, signature binary"
    )


def _stack(column: pa.Array) -> np.ndarray:
    body, _ = column_bytes(column)
    return body.view("<u4").reshape(-1, HASHES)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """The bucket key of each band of each signature."""
    rows = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.tile(BAND_SALT, (len(sigs), 1))
    for j in range(ROWS):
        key = mix(key ^ rows[:, :, j] * np.uint64(0x9E3779B97F4A7C15))
    return key


KEYED = "key long, doc_id long, leader long, same boolean"


def _leaders(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and id, and for each place in that order the place where its key begins."""
    order = np.lexsort((ids, keys))
    k = keys[order]
    begins = np.concatenate(([True], k[1:] != k[:-1]))
    return order, np.maximum.accumulate(np.where(begins, np.arange(len(k)), 0))


def _keyed(sigs: DataFrame) -> DataFrame:
    """Bucket keys of documents, each key once per chunk; what shares a key within the chunk comes out paired already."""

    def chunk(parts: list[pa.RecordBatch]):
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ids = batch.column("doc_id").to_numpy()
        exact = column_bytes(batch.column("set_id"))[0].view(np.uint64).reshape(-1, 2)
        # Equal sets first: one of each goes on to the bands.
        order = np.lexsort((ids, exact[:, 1], exact[:, 0]))
        begins = np.concatenate(([True], (exact[order[1:]] != exact[order[:-1]]).any(axis=1)))
        first = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        yield from _rows(mix(ids[order[~begins]].astype(np.uint64)), ids[order[~begins]], ids[first[~begins]], True)
        reps = order[begins]
        yield from _rows(mix(exact[reps, 0] ^ np.uint64(1)), ids[reps], None, True)
        keys = band_keys(_stack(batch.column("signature").take(pa.array(reps)))).ravel()
        owners = np.repeat(ids[reps], BANDS)
        order, lead = _leaders(keys, owners)
        own = lead == np.arange(len(lead))
        yield from _rows(keys[order[own]], owners[order[own]], None, False)
        others = np.flatnonzero(~own)
        pairs = np.stack((np.concatenate((owners[order[lead[others]]], owners[order[others - 1]])), np.tile(owners[order[others]], 2)), axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        yield from _rows(mix(pairs[:, 1].astype(np.uint64)), pairs[:, 1], pairs[:, 0], False)

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                n += batch.num_rows
            if n >= CHUNK:
                yield from chunk(parts)
                parts, n = [], 0
        if parts:
            yield from chunk(parts)

    return sigs.where("n_shingles > 0 and doc_id is not null").select("doc_id", "set_id", "signature").mapInArrow(run, KEYED)


def _rows(keys: np.ndarray, ids: np.ndarray, leaders: np.ndarray | None, same: bool):
    if len(keys):
        yield pa.RecordBatch.from_pydict(
            {
                "key": pa.array(keys.view(np.int64)), "doc_id": pa.array(ids.astype(np.int64)),
                "leader": pa.nulls(len(ids), pa.int64()) if leaders is None else pa.array(leaders.astype(np.int64)),
                "same": pa.array(np.full(len(ids), same)),
            }
        )


def _paired(batches):
    """Sorted by key and id: each document with its bucket's first and with the one before it; pairs made before pass through."""
    key = leader = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
        same = batch.column("same").to_numpy(zero_copy_only=False)
        made = batch.column("leader")
        done = made.is_valid().to_numpy(zero_copy_only=False)
        ready = made.fill_null(0).to_numpy()
        yield _pairs(ready[done], ids[done], same[done])
        keys, ids, same = keys[~done], ids[~done], same[~done]
        if not len(keys):
            continue
        begins = np.concatenate(([keys[0] != key], keys[1:] != keys[:-1]))
        place = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
        leads = np.where(place >= 0, ids[place], leader if leader is not None else 0)
        before = np.concatenate(([last if last is not None else 0], ids[:-1]))
        yield _pairs(leads[~begins], ids[~begins], same[~begins])
        yield _pairs(before[~begins], ids[~begins], same[~begins])
        key, leader, last = keys[-1], leads[-1], ids[-1]


def _pairs(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
    keep = a != b
    return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)[keep]), "b": pa.array(np.maximum(a, b)[keep]), "same": pa.array(same[keep])})


def candidates(sigs: DataFrame) -> DataFrame:
    """(a, b, same): pairs of a document and its bucket's leader or its neighbour there; same: their sets are equal."""
    keyed = _keyed(sigs)
    dealt = keyed.repartition("key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(_paired, "a long, b long, same boolean").groupBy("a", "b").agg(F.max("same").alias("same"))


def agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) of which at least AGREE minima are equal."""
    table = sigs.where("n_shingles > 0 and doc_id is not null").dropDuplicates(["doc_id", "set_id"])  # a doc_id may have several texts
    a, b = (table.select(F.col("doc_id").alias(c), F.col("signature").alias(f"s{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            equal = (_stack(batch.column("sa")) == _stack(batch.column("sb"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(equal >= AGREE))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, docs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, with the sizes of intersection and union."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    a, b = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in "ab"]
            found = []
            last: tuple[str, np.ndarray] | None = None
            for i in range(batch.num_rows):
                left, right = batch.column("ta")[i].as_py(), batch.column("tb")[i].as_py()
                if last is None or last[0] != left:  # a leader's pairs mostly come together
                    last = (left, _set(left))
                other = _set(right)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                either = len(last[1]) + len(other) - both
                if both and 100 * both >= percent * either:
                    found.append((ids[0][i], ids[1][i], both, either))
            yield pa.RecordBatch.from_pydict({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(("a", "b", "shared", "total"))})

    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, shared long, total long")


def _set(text: str) -> np.ndarray:
    body = np.frombuffer(text.encode(), np.uint8)
    return next(shingle_sets(body, np.array([0, len(body)])))


#: Documents, and shingles of their sets, in a block: what is compared at once when a bucket lies in several components.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Tasks over which the places of one bucket are dealt when its list of asking blocks is joined to them.
SPREAD = 16
CELL = ["main", "i", "j"]


def _members(sigs: DataFrame, candidates_: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, signature): documents that share a bucket with another, one per set."""
    ids = candidates_.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return (
        sigs.where("n_shingles > 0 and doc_id is not null")
        .join(ids, "doc_id", "left_semi")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        .select("doc_id", "n_shingles", "signature")
    )


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"), "signature"
    )


def _by_cell(compare):
    """A map over rows sorted by cell that hands over one cell at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in CELL], axis=1)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(cell[lo]) != key:
                    yield from compare(pa.Table.from_batches(held).combine_chunks())
                    held = []
                key = tuple(cell[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    return run


def _open(members: DataFrame) -> DataFrame:
    """(key, doc_id, component, n_shingles, main): places in buckets of several components; main: that of most of a bucket's members."""

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_stack(batch.column("signature"))).view(np.int64).ravel()
                owner = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                names = ["doc_id", "component", "n_shingles"]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c).take(owner) for c in names)], ["key", *names])

    placed = members.select("doc_id", "component", "n_shingles", "signature").mapInArrow(keyed, "key long, doc_id long, component long, n_shingles long")
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = (
        shares.groupBy("key")
        .agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"))
        .where("parts > 1 and n > 2")
        .select("key", "main")
    )
    return placed.join(mains, "key")


def _blocks(n: str, shingles: str):
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _cells(members: DataFrame) -> DataFrame:
    """What must be compared once more, in cells (main, i, j) of bounded size.

    In each open bucket the members outside its main component ask all members of other components. Those that ask
    the same main component are cut into blocks i, such that those of one bucket are together; a member that
    is asked goes to each block it shares a bucket with, once, and the members asked by a block are cut into blocks j. So the
    rows follow the documents that are asked and the square of those outside the main component alone.
    """
    places = materialize(_open(members), "places")
    asking = places.where("component <> main").groupBy("main", "doc_id").agg(F.min("key").alias("home"), F.first("n_shingles").alias("n_shingles"))
    homes = asking.groupBy("main", "home").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    whole = homes.groupBy("main").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).select("main", _blocks("n", "shingles").alias("blocks"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    asking = materialize(
        asking.join(homes.select("main", "home", _blocks("n", "shingles").alias("parts")), ["main", "home"])
        .join(whole, "main")
        .select("main", "doc_id", "n_shingles", F.pmod(F.xxhash64("home", part), F.col("blocks")).cast("int").alias("own")),
        "asking",
    )
    # A document that asks is asked by the blocks up to its own.
    owned = places.join(asking.select("main", "doc_id", "own"), ["main", "doc_id"], "left")
    # A bucket that a third of all documents share is dealt over SPREAD tasks, each with the bucket's list of blocks.
    asked_by = owned.where("own is not null").groupBy("key").agg(F.collect_set("own").alias("blocks")).withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    once = owned.withColumn("spread", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int")).join(asked_by, ["key", "spread"]).groupBy("main", "doc_id", "component", "n_shingles", "own").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
    asked = once.select("main", F.explode("blocks").alias("i"), "doc_id", "component", "n_shingles", "own").where("own is null or own >= i")
    parts = asked.groupBy("main", "i").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).select("main", "i", _blocks("n", "shingles").alias("parts"))
    asked = asked.join(parts, ["main", "i"]).select("main", "i", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("j"), "doc_id", F.coalesce("own", F.lit(-1)).alias("own"), F.lit(False).alias("asks"))
    asks = asking.withColumnRenamed("own", "i").join(parts, ["main", "i"]).select("main", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "doc_id", F.col("i").alias("own"), F.lit(True).alias("asks"))
    return asked.unionByName(asks).join(members, "doc_id").repartition(*CELL).sortWithinPartitions(*CELL)


def _apart(part: pa.Table, size: np.ndarray, percent: int = SIMILAR):
    """For each row of the cell that asks: its place and the places of those of other components that it asks, as far as their sizes allow a link."""
    comp, ids, own = (part.column(c).to_numpy() for c in ("component", "doc_id", "own"))
    asks = part.column("asks").to_numpy()
    cols = np.flatnonzero(~asks)
    for r in np.flatnonzero(asks).tolist():
        fits = 100 * np.minimum(size[cols], size[r]) >= percent * np.maximum(size[cols], size[r])
        far = cols[(comp[cols] != comp[r]) & fits & ((own[cols] != own[r]) | (ids[cols] > ids[r]))]
        if len(far):
            yield r, far


def best_pairs(cells: DataFrame) -> DataFrame:
    """(a, b): of each component its best agreeing pair with another component."""

    def compare(part: pa.Table):
        sig, comp, ids = _stack(part.column("signature")), part.column("component").to_numpy(), part.column("doc_id").to_numpy()
        top: dict[int, tuple[int, int, int]] = {}
        for r, far in _apart(part, part.column("n_shingles").to_numpy()):
            agree = (sig[far] == sig[r]).sum(axis=1)
            for k in np.flatnonzero(agree >= AGREE).tolist():
                for c in (comp[r], comp[far[k]]):
                    if agree[k] > top.get(c, (0,))[0]:
                        top[c] = (agree[k], ids[r], ids[far[k]])
        if top:
            pairs = np.array([t[1:] for t in top.values()], np.int64)
            yield pa.RecordBatch.from_pydict(
                {"component": pa.array(list(top), pa.int64()), "agree": pa.array([t[0] for t in top.values()], pa.int64()), "a": pa.array(pairs.min(axis=1)), "b": pa.array(pairs.max(axis=1))}
            )

    found = cells.mapInArrow(_by_cell(compare), "component long, agree long, a long, b long")
    best = found.groupBy("component").agg(F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("pair"))
    return best.select("pair.a", "pair.b").distinct()


def links_across(cells: DataFrame, docs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """(a, b): links between components, one at least for each two components of a cell that have any.

    A first pass finds the members of each cell whose signatures agree with one of another component; their texts are
    fetched, and the cell compares full sets. Pairs never leave it, links do.
    """
    names = [*CELL, "own", "asks", "doc_id", "component", "n_shingles"]

    def agreeing_members(part: pa.Table):
        sig = _stack(part.column("signature"))
        seen = np.zeros(part.num_rows, bool)
        for r, far in _apart(part, part.column("n_shingles").to_numpy(), percent):
            far = far[(sig[far] == sig[r]).sum(axis=1) >= AGREE]
            seen[far] = True
            seen[r] |= len(far) > 0
        if seen.any():
            yield from part.select(names).filter(pa.array(seen)).to_batches()

    def compare(part: pa.Table):
        sets = [_set(t.as_py()) for t in part.column("text")]
        comp, ids = part.column("component").to_numpy(), part.column("doc_id").to_numpy()
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        offs = np.concatenate(([0], np.cumsum(size)))
        words, number = np.unique(np.concatenate(sets), return_inverse=True)
        flag = np.zeros(len(words), np.int64)
        found = []
        for r, far in _apart(part, size, percent):
            flag[number[offs[r] : offs[r + 1]]] = 1
            shared = np.fromiter((flag[number[offs[f] : offs[f + 1]]].sum() for f in far.tolist()), np.int64, len(far))
            flag[number[offs[r] : offs[r + 1]]] = 0
            far = far[100 * shared >= percent * (size[r] + size[far] - shared)]
            _, first = np.unique(comp[far], return_index=True)
            found += [(ids[r], ids[f]) for f in far[first].tolist()]
        if found:
            pairs = np.array(found, np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs.min(axis=1)), "b": pa.array(pairs.max(axis=1))})

    fields = "main long, i int, j int, own int, asks boolean, doc_id long, component long, n_shingles long"
    rows = cells.mapInArrow(_by_cell(agreeing_members), fields)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    # Rows that share a doc_id may hold different texts; each is a row of the cell.
    whole = rows.join(texts, "doc_id").select(*names, "text").repartition(*CELL).sortWithinPartitions(*CELL)
    return whole.mapInArrow(_by_cell(compare), "a long, b long").distinct()


def _joined(labels: DataFrame, new: DataFrame) -> DataFrame:
    """The components when links are added to those there are."""
    if new.isEmpty():
        return labels
    hung = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(hung.unionByName(new))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id (smallest doc_id reached by links), kept."""
    sigs = materialize(signatures(docs), "signatures")
    found = materialize(candidates(sigs), "candidates")
    unequal = found.where("not same").select("a", "b")
    links = materialize(
        similar(agreeing(unequal, sigs), docs).select("a", "b").unionByName(found.where("same").select("a", "b")), "links"
    )
    labels = components(links)
    alone = materialize(_members(sigs, found), "members")
    best = best_pairs(_cells(_labelled(alone, labels))).join(unequal, ["a", "b"], "left_anti")
    labels = _joined(labels, materialize(similar(best, docs).select("a", "b"), "links"))
    labels = _joined(labels, materialize(links_across(_cells(_labelled(alone, labels)), docs), "links"))
    return (
        sigs.select("doc_id", "n_shingles")
        .join(labels, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all whole texts of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS ss FROM w),
k AS (SELECT doc_id, len(ss) AS n, list_sort(ss) AS ss FROM s),
c AS (SELECT min(doc_id) AS rep, n, ss FROM k WHERE n > 0 GROUP BY n, ss),
p AS (SELECT rep, n, unnest(ss) AS g FROM c),
i AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS x
      FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * x >= 75 * (na + nb - x)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS low FROM c UNION SELECT e.b, r.low FROM r JOIN e ON r.node = e.a WHERE r.low < e.b),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(m.low, k.doc_id) AS component_id, coalesce(m.low, k.doc_id) = k.doc_id AS kept
FROM k LEFT JOIN c ON k.n = c.n AND k.ss = c.ss LEFT JOIN m ON m.node = c.rep
"""
