"""Embedding near-dedup by product quantisation: coarse inverted lists, residual codes, exact rerank.

Unit vectors are assigned to coarse lists (k-means on a bounded sample); beyond what so many lists hold, each is parted by the
residuals' own nearest of up to 256 centroids, so that lists stay short as the vectors grow. The residual is coded per subspace by the
nearest of 256 centroids. Every vector is indexed and every vector is a query against the lists nearest to it. Table
look-ups of the query's products with the subspace centroids give its asymmetric distances to all codes of a list; since each code's
own error is stored, the triangle inequality keeps every vector that can be near enough, and exact cosines in double
precision decide. Equal vectors are one indexed vector with a weight, lists are compared in cells of bounded size,
and a cell gives counts and a spanning forest of its links, never the pairs.

A pair found from one side only is counted for both, so links are symmetric.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components or have another length than the
commonest (the smaller on a tie) link with nothing and are kept; vectors of any length are taken whole. Rows without vec_id count as vectors of others'
links; their component is the smallest id they reach, or null. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import column_bytes
from .components import components
from .shared import materialize

COSINE = 0.9
#: Vectors that lists and codes are fitted on, at most; vectors in a list on average; lists probed; subspaces and their centroids.
SAMPLE, LIST, PROBES, SPACES, CODES = 20_000, 200, 16, 16, 256
#: Parts of a coarse list at most, vectors in a part on average beyond that many lists, and parts probed.
PARTS, PART, PART_PROBES = 256, 1000, 32
#: Indexed vectors and queries in a cell.
ITEMS, QUERIES = 2048, 8192


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    n = min(n, len(centres))
    out = np.empty((len(x), n), np.int32)
    half = (centres * centres).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ centres.T
        if n == 1:
            out[i : i + 4096, 0] = d.argmin(axis=1)
        else:
            top = np.argpartition(d, n - 1, axis=1)[:, :n]
            out[i : i + 4096] = np.take_along_axis(top, np.take_along_axis(d, top, axis=1).argsort(axis=1, kind="stable"), axis=1)
    return out


class Quantiser:
    """Coarse lists, their parts and subspace codebooks of unit vectors. A list's number is coarse list * parts + part."""

    def __init__(self, sample: np.ndarray, total: int, seed: int = 10):
        rng = np.random.default_rng(seed)
        lists = int(max(1, min(total // LIST, len(sample) // 8)))
        self.centres = _kmeans(sample, lists, 8, rng) if len(sample) else np.zeros((1, sample.shape[1]), np.float32)
        dim = self.centres.shape[1]
        residual = sample - self.centres[nearest(sample, self.centres, 1)[:, 0]] if len(sample) else np.zeros((1, dim), np.float32)
        parts = int(min(PARTS, -(-total // (len(self.centres) * PART)), max(1, len(sample) // 8)))
        self.sub = _kmeans(residual, parts, 8, rng) if parts > 1 else np.zeros((1, dim), np.float32)
        self.spaces = [s for s in np.array_split(np.arange(dim), min(SPACES, dim)) if len(s)]
        some = residual[: 40 * CODES]
        some = some - self.sub[nearest(some, self.sub, 1)[:, 0]]
        self.books = [_kmeans(some[:, s], CODES, 5, rng) for s in self.spaces]

    def base(self, lists: np.ndarray) -> np.ndarray:
        return self.centres[lists // len(self.sub)] + self.sub[lists % len(self.sub)]

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The lists nearest to each row, its own first."""
        coarse = nearest(x, self.centres.astype(np.float64), PROBES)
        parts = len(self.sub)
        if parts == 1:
            return coarse
        out = np.empty((len(x), min(PART_PROBES, coarse.shape[1] * parts)), np.int32)
        sub = self.sub.astype(np.float64)
        half = (sub * sub).sum(axis=1) / 2
        for i in range(0, len(x), 128):
            near = coarse[i : i + 128]
            left = x[i : i + 128, None, :] - self.centres[near]
            away = ((left * left).sum(axis=2)[:, :, None] / 2 + half - left @ sub.T).reshape(len(near), -1)
            top = np.argpartition(away, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < away.shape[1] else np.tile(np.arange(away.shape[1]), (len(near), 1))
            top = np.take_along_axis(top, np.take_along_axis(away, top, axis=1).argsort(axis=1, kind="stable"), axis=1)
            out[i : i + 128] = np.take_along_axis(near, top // parts, axis=1) * parts + top % parts
        return out

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = x - self.base(lists)
        return np.stack([nearest(residual[:, s], b, 1)[:, 0] for s, b in zip(self.spaces, self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        out = self.base(lists)
        for m, (s, b) in enumerate(zip(self.spaces, self.books, strict=True)):
            out[:, s] += b[codes[:, m]]
        return out


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows, in double precision, of packed float64 vectors; scaled first so that no square over- or underflows."""
    x = column_bytes(column)[0].view(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(df: DataFrame) -> DataFrame:
    """(h, g, rep, weight, vector binary): one row per distinct vector."""

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            flat, offs = column.flatten().to_numpy(), np.asarray(column.offsets)
            offs = offs - offs[0]
            packed = [flat[s:e].tobytes() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "g", "rep", "weight")), pa.array(packed, pa.binary())], ["h", "g", "rep", "weight", "vector"])

    return df.mapInArrow(run, "h long, g long, rep long, weight long, vector binary")


def hashes(v: Column) -> tuple[Column, Column]:
    """Two hashes of different seeds; vectors are equal where both are."""
    return F.xxhash64(v), F.xxhash64(F.lit(1), v)


CELL = "list int, i int, q int, query boolean, cls long, weight long, home int, probes binary, code binary, error float, vector binary"
ROW = "list int, query boolean, cls long, weight long, home int, probes binary, code binary, error float, vector binary"


def _index_rows(shared, dim: int):
    def run(batches):
        quantiser = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = units(batch.column("vector"), dim)
                near = quantiser.probes(x)
                home = near[:, 0]
                code = quantiser.encode(x, home)
                error = np.linalg.norm(x - quantiser.decode(code, home), axis=1).astype(np.float32)
                n, k = near.shape
                probes = pa.array([np.sort(r).tobytes() for r in near], pa.binary())
                own = {c: batch.column(c) for c in ("cls", "weight")}
                fill = {"home": pa.array(home), "probes": probes, "code": pa.array([c.tobytes() for c in code], pa.binary()), "error": pa.array(error), "vector": batch.column("vector")}
                yield pa.RecordBatch.from_pydict({"list": pa.array(home), "query": pa.array(np.zeros(n, bool)), **own, **fill})
                rows = pa.array(np.repeat(np.arange(n), k))
                asked = {"home": fill["home"].take(rows), "probes": pa.nulls(n * k, pa.binary()), "code": pa.nulls(n * k, pa.binary()), "error": pa.nulls(n * k, pa.float32()), "vector": fill["vector"].take(rows)}
                yield pa.RecordBatch.from_pydict({"list": pa.array(near.ravel()), "query": pa.array(np.ones(n * k, bool)), **{c: v.take(rows) for c, v in own.items()}, **asked})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest of each component of the links (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(quantiser: Quantiser, dim: int, part: pa.Table):
    asks = part.column("query").to_numpy()
    items, queries = part.filter(pa.array(~asks)), part.filter(pa.array(asks))
    if not items.num_rows or not queries.num_rows:
        return
    x, q = (units(t.column("vector").combine_chunks(), dim) for t in (items, queries))
    ids, id_q = items.column("cls").to_numpy(), queries.column("cls").to_numpy()
    w, w_q = items.column("weight").to_numpy(), queries.column("weight").to_numpy()
    home, home_q = items.column("home").to_numpy(), queries.column("home").to_numpy()
    code = column_bytes(items.column("code"))[0].reshape(len(ids), -1)
    probes = column_bytes(items.column("probes"))[0].view(np.int32).reshape(len(ids), -1)
    reach = np.sqrt(2 - 2 * COSINE) + items.column("error").to_numpy() + 1e-3
    approx = quantiser.decode(code, home)
    square, base = (approx * approx).sum(axis=1), quantiser.base(home[:1])[0]
    links_x, links_q = np.zeros(len(ids), np.int64), np.zeros(len(id_q), np.int64)
    edges = []
    for lo in range(0, len(q), 512):
        some = q[lo : lo + 512].astype(np.float32)
        near = np.repeat((some @ base)[:, None], len(ids), axis=1)
        for m, (s, b) in enumerate(zip(quantiser.spaces, quantiser.books, strict=True)):
            near += (some[:, s] @ b.T)[:, code[:, m]]
        r, c = np.nonzero(1 + square - 2 * near <= reach * reach)
        r += lo
        other = id_q[r] != ids[c]
        r, c = r[other], c[other]
        cosine = np.concatenate([np.einsum("ij,ij->i", q[r[k : k + 65536]], x[c[k : k + 65536]]) for k in range(0, len(r), 65536)] or [np.empty(0)])
        r, c = r[cosine >= COSINE], c[cosine >= COSINE]
        if not len(r):
            continue
        np.add.at(links_q, r, w[c])
        mutual = (probes[c] == home_q[r][:, None]).any(axis=1)
        np.add.at(links_x, c[~mutual], w_q[r[~mutual]])
        edges.append(_forest(id_q[r], ids[c]))
    for who, n in ((id_q, links_q), (ids, links_x)):
        yield pa.RecordBatch.from_pydict({"a": pa.array(who[n > 0]), "b": pa.nulls(int((n > 0).sum()), pa.int64()), "n": pa.array(n[n > 0])})
    for a, b in edges:
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "n": pa.array(np.zeros(len(a), np.int64))})


def _cell_rows(shared, dim: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in ("list", "i", "q")], axis=1)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(cell[lo]) != key:
                    yield from _compare(shared.value, dim, pa.Table.from_batches(held))
                    held = []
                key = tuple(cell[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _compare(shared.value, dim, pa.Table.from_batches(held))

    return run


def link(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sound = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    size = F.size("v")
    lengths = rows.where(sound).groupBy(size.alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    rows = rows.withColumn("sound", sound & (size == dim))
    h, g = hashes(F.col("v"))
    whole = rows.where("sound").withColumns({"h": h, "g": g})
    distinct = whole.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = materialize(_packed(distinct).withColumn("cls", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    sample = classes.orderBy("h", "g").limit(SAMPLE).select("vector").collect()
    x = np.array([np.frombuffer(r.vector, np.float64) for r in sample]).reshape(len(sample), max(dim, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    quantiser = Quantiser((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) if len(x) else x.astype(np.float32), total)
    shared = spark.sparkContext.broadcast(quantiser)  # lists and codebooks: bounded by SAMPLE
    indexed = materialize(classes.mapInArrow(_index_rows(shared, dim), ROW), "lists")
    counts = indexed.groupBy("list").agg(F.count(F.when(~F.col("query"), 1)).alias("n"), F.count(F.when(F.col("query"), 1)).alias("asked"))
    cuts = F.broadcast(  # a row per list: bounded by SAMPLE and PARTS
        counts.select("list", F.greatest(F.ceil(F.col("n") / ITEMS), F.lit(1)).cast("int").alias("ni"), F.greatest(F.ceil(F.col("asked") / QUERIES), F.lit(1)).cast("int").alias("nq"))
    )
    part = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cells = (
        indexed.join(cuts, "list")
        .withColumn("i", F.explode(F.when(F.col("query"), all_of("ni")).otherwise(F.array(part("ni")))))
        .withColumn("q", F.explode(F.when(F.col("query"), F.array(part("nq"))).otherwise(all_of("nq"))))
        .select(*[c.split()[0] for c in CELL.split(", ")])
    )
    dealt = cells.repartition("list", "i", "q").sortWithinPartitions("list", "i", "q")
    found = materialize(dealt.mapInArrow(_cell_rows(shared, dim), "a long, b long, n long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    labels = components(found.where("b is not null").select("a", "b"))
    known = classes.join(links, "cls", "left").join(labels, F.col("cls") == F.col("node"), "left").select(
        "h", "g", "rep", F.col("weight").alias("weight"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "cls").alias("component")
    )
    known = materialize(known, "classes")
    smallest = known.groupBy("component").agg(F.min("rep").alias("smallest"))
    of_class = known.join(smallest, "component").select("h", "g", "smallest", (F.col("n") + F.col("weight") - 1).alias("n_links"))
    linked = whole.select("vec_id", "h", "g").join(of_class, ["h", "g"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))  # they meet no one, not even in a join
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all rows of ``embeddings``."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT l.b, r.low FROM r JOIN l ON r.node = l.a WHERE r.low < l.b),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.low AS component_id, m.low = v.vec_id AS kept
FROM v JOIN m ON m.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
