"""Vectors of one hash, and pairs of passages that are left out."""

import random

from pyspark.sql import functions as F

from palimpsest.llm import passages, vectors


def test_two_vectors_of_one_hash_stay_two(spark, monkeypatch):
    second = vectors.hashes
    monkeypatch.setattr(vectors, "hashes", lambda v: (F.lit(7).cast("long"), second(v)[1]))  # all first hashes collide
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.01, 0.0]), (4, None), (5, [0.0, 0.0]), (None, [0.0, 1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert got == {0: (2, 0, True), 1: (1, 1, True), 2: (2, 0, False), 3: (2, 0, False), 4: (0, 4, True), 5: (0, 5, True), None: (1, 1, False)}


def test_pairs_that_are_left_out_change_no_group(spark):
    """A family of 30 near copies, pairs that share a passage with one of them, and passages of the family's ends: with and without every pair the groups are the same, and what is covered."""
    rng = random.Random(12)
    fresh = iter(range(10**9))
    prose = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    base, rows = prose(260), []
    for d in range(30):
        at = rng.randrange(260)
        rows.append((d, " ".join([*base[:at], f"edit{d}", *base[at + 1 :], *prose(rng.randrange(40))])))
    tail = prose(70)
    for d in range(30, 36):
        rows.append((d, " ".join([*prose(80), *tail, *prose(30)] if d % 2 else [*prose(10), *tail, *base[:60]])))
    rows += [(d, " ".join(prose(120))) for d in range(36, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    member, found, pairs = passages.passages(docs, every_pair=True)
    fewer = passages.passages(docs, every_pair=False)
    cover = []
    for table in (found, fewer[1]):
        words = {}
        for r in table.collect():
            for d, lo, hi in ((r.a, r.a_first, r.a_end), (r.b, r.b_first, r.b_end)):
                words.setdefault(d, set()).update(range(lo, hi))
        cover.append(words)
    assert set(cover[0]) == set(cover[1]) == set(range(36)) and all(len(cover[0][d] ^ cover[1][d]) <= 10 for d in cover[0])
    assert fewer[2].count() < pairs.count()
    got = {r.doc_id: r.group_id for r in passages.repeated_passages(docs).collect()}
    assert got == dict.fromkeys(range(36), 0)  # all hang together by the shared ends
