"""Quality classifier: random-indexing word vectors pooled per document, a small network and calibrated probabilities.

Tokens are runs of letters (lower-cased, upper-case words apart), digits and punctuation. Each hashed token has a
sparse ternary index vector; its word vector is the sum of the index vectors of its neighbours, counted over the
whole corpus. A document is the mean and the spread of its tokens' word vectors. Two numpy layers are
fitted on a bounded sample of the labelled rows, and a temperature fitted on rows set apart makes the outputs
probabilities.

Defined cases: null and empty texts have the zero vector and get its score; rows without label are not learned from; a
doc_id labelled more than once counts as good if most of its labels are; without labels of both kinds the
score is the share of good labels (1 if there is none). Very long texts are pooled whole, piece by piece; repeated rows and ties give
equal scores; an empty table gives an empty result; further columns are not read, :func:`keep_good` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import LOWER, column_bytes, mix, slices, word_bounds, word_hashes
from .langid import fold
from .shared import materialize
from .tables import counted

#: Hashed vocabulary, vector size, non-zero entries of an index vector, neighbours on either side.
VOCABULARY, SIZE, ENTRIES, NEAR = 1 << 14, 64, 4, 2
#: Labelled rows that the network is fitted on, at most; those with the smallest hash of their id are taken.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 40, 3e-3, 1e-4
THRESHOLD = 0.3
#: Tokens counted at once, and bytes of text whose tokens' vectors are held at once.
TOKENS, PIECE = 1 << 20, 1 << 20

#: 0 space and control, 1 letter, 2 digit, 3 punctuation
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 3
KIND[0x30:0x3A] = 2
KIND[0x41:0x5B] = KIND[0x61:0x7B] = KIND[0x80:] = 1

_rng = np.random.default_rng(55)
DIMS = np.argsort(_rng.random((VOCABULARY, SIZE)), axis=1)[:, :ENTRIES]
SIGNS = np.tile(np.array([1, -1] * (ENTRIES // 2)), (VOCABULARY, 1))


def tokens(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed token of each run, and how many come before each document."""
    kind = KIND[body]
    parts = []
    for k in (1, 2, 3):
        starts, ends, _ = word_bounds(kind == k, offs)
        if not len(starts):
            continue
        if k == 2:
            token = np.full(len(starts), 7, np.uint64)
        else:
            token = word_hashes(LOWER[body], starts, ends)
            if k == 1:
                shout = (body[starts] - np.uint8(65) < 26) & (body[ends - 1] - np.uint8(65) < 26) & (ends - starts > 1)
                token = np.where(shout, mix(token + np.uint64(1)) % np.uint64(64), token)  # shouted words share few tokens
        parts.append((starts, token))
    if not parts:
        return np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    starts = np.concatenate([p[0] for p in parts])
    order = np.argsort(starts, kind="stable")
    token = np.concatenate([p[1] for p in parts])[order]
    return (mix(token) >> np.uint64(64 - 14)).astype(np.int64), np.searchsorted(starts[order], offs)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """VOCABULARY x SIZE unit vectors from neighbour counts over all of ``docs``."""

    def count(batches):
        total = np.zeros(VOCABULARY * SIZE, np.int64)
        held, n = [], 0

        def add():
            nonlocal total
            token, doc = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            for gap in range(1, NEAR + 1):
                near = doc[gap:] == doc[:-gap]
                a, b = token[:-gap][near], token[gap:][near]
                for own, other in ((a, b), (b, a)):
                    for j in range(ENTRIES):
                        at = own * SIZE + DIMS[other, j]
                        total += SIGNS[0, j] * np.bincount(at, minlength=len(total))

        base = 0
        for batch in batches:
            body, offs = column_bytes(batch.column("text"))
            for _, _, part, po in slices(body, offs):
                token, firsts = tokens(part, po)
                held.append((token.astype(np.int32), base + np.repeat(np.arange(len(po) - 1), np.diff(firsts))))
                base += len(po)
                n += len(token)
                if n >= TOKENS:
                    add()
                    held, n = [], 0
        if held:
            add()
        return total

    context = counted(docs.select(F.col("text").cast("string")), VOCABULARY * SIZE, count).reshape(VOCABULARY, SIZE).astype(np.float64)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(body: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each document."""
    n = len(offs) - 1
    out = np.zeros((n, 2 * SIZE))
    token, firsts = tokens(body, offs)
    counts = np.diff(firsts)
    some = np.flatnonzero(counts)
    for lo in range(0, len(some)):
        d = some[lo]
        sums, squares = np.zeros(SIZE), np.zeros(SIZE)
        for i in range(firsts[d], firsts[d + 1], 1 << 15):
            v = vectors[token[i : min(i + (1 << 15), firsts[d + 1])]]
            sums += v.sum(axis=0)
            squares += np.einsum("ij,ij->j", v, v)
        mean = sums / counts[d]
        out[d, :SIZE] = mean
        out[d, SIZE:] = np.sqrt(np.maximum(squares / counts[d] - mean * mean, 0))
    return out.astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, vector binary) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # VOCABULARY x SIZE numbers, a fixed bound

    def run(batches):
        for batch in batches:
            body, offs = column_bytes(batch.column("text"))
            for lo, hi, part, po in slices(body, offs, PIECE):
                v = pooled(part, po, shared.value)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "vector": pa.array([r.tobytes() for r in v], pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, vector binary")


class Network:
    """Two layers and a temperature; probabilities of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        self.share = float(y.mean()) if len(y) else 1.0
        self.weights = None
        if len(np.unique(y)) < 2:
            return
        rng = np.random.default_rng(seed)
        self.middle, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.middle) / self.spread
        apart = np.arange(len(y)) % 5 == 0
        if len(np.unique(y[~apart])) < 2 or len(np.unique(y[apart])) < 2:
            apart = np.zeros(len(y), bool)
        fit_x, fit_y = x[~apart], y[~apart].astype(np.float64)
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(fit_y)), max(1, len(fit_y) // 128)):
                a, t = fit_x[rows], fit_y[rows]
                h = np.tanh(a @ w[0] + w[1])
                g = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - t) / len(rows)
                gh = np.outer(g, w[2]) * (1 - h * h)
                step += 1
                for k, grad in enumerate((a.T @ gh, gh.sum(axis=0), h.T @ g, np.array([g.sum()]))):
                    grad = grad + DECAY * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        self.temperature = self._calibrated(self._logits(x[apart] if apart.any() else x), y[apart] if apart.any() else y)

    def _logits(self, scaled: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(scaled @ w[0] + w[1]) @ w[2] + w[3]

    @staticmethod
    def _calibrated(logits: np.ndarray, y: np.ndarray) -> float:
        """The temperature with the least log loss."""
        loss = lambda t: np.mean(np.logaddexp(0, -(2 * y - 1) * logits / t))
        return float(min(np.geomspace(0.25, 8, 101), key=loss))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        z = self._logits((x - self.middle) / self.spread) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(vectors: DataFrame, labels: DataFrame) -> Network:
    """Fit on up to SAMPLE labelled rows of (doc_id, vector) and (doc_id, quality)."""
    one = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("quality"))
    )
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = vectors.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("vector").alias("vector"), F.first("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(r.vector, np.float32) for r in rows], np.float64).reshape(len(rows), 2 * SIZE)
    return Network(x, np.array([r.quality for r in rows], np.int64))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted; learned from the labels given."""
    vectors = materialize(features(docs, word_vectors(docs)), "vectors")
    shared = docs.sparkSession.sparkContext.broadcast(fit(vectors, labels))

    def run(batches):
        for batch in batches:
            body, _ = column_bytes(batch.column("vector"))
            score = shared.value(body.view(np.float32).reshape(-1, 2 * SIZE).astype(np.float64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    return vectors.mapInArrow(run, "doc_id long, score double, predicted int")


def learned_from(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: CRC modulo 5 is not 0."""
    return labels.where(fold("doc_id", 5) != 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of ``documents``."""
    labels = learned_from(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be good, with their columns; learned from the labels given."""
    vectors = word_vectors(docs)
    chosen = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # SAMPLE ids at most
    network = fit(features(labelled, vectors), labels.join(F.broadcast(chosen), "doc_id", "left_semi"))
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches):
        words, score = shared.value
        for batch in batches:
            body, offs = column_bytes(batch.column("text"))
            for lo, hi, part, po in slices(body, offs, PIECE):
                good = score(pooled(part, po, words).astype(np.float64)) >= THRESHOLD
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
