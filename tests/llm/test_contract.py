"""The registered queries: names, columns, SQL on small tables, and the pipeline's stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "held_out", "lang_pred", "score"], 3: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], 4: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    5: ["doc_id", "held_out", "score", "predicted"], 7: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], 8: ["doc_id", "n_shingles", "component_id", "kept"],
    6: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], 9: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], 10: ["vec_id", "n_links", "component_id", "kept"],
    11: ["doc_id", "n_lines", "n_dropped", "kept_sha256"], 12: ["doc_id", "n_features", "weight", "score", "rank"],
    13: ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


def test_names():
    import __spark_entry__ as entry

    numbers = [int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns(spark, number):
    from palimpsest.llm import catalog

    name = next(n for n in catalog.QUERIES if n.startswith(f"op{number}_"))
    got = catalog.QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[number])] == COLUMNS[number]
    if name in catalog.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(catalog.ORACLE_SQL[name])
        order = [[d[0] for d in want.description].index(c) for c in got.columns]
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    assert before > 100 and {"doc_id", "token_ids"} <= set(docs.columns)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    words = lambda side, n: " ".join(f"{side}{i}{side}" for i in range(n))
    long, letters, short = words("p", 51), " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] for i in range(51)), words("q", 50)
    texts = [f"{words(a, 30)} {p} {words(b, 30)}" for p, a, b in ((long, "a", "b"), (long, "c", "d"), (letters, "e", "f"), (letters, "g", "h"), (short, "i", "j"), (short, "k", "l"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, df, SF).collect()}
    assert [got[k] for k in range(4)] == [words(a, 30) + words(b, 30) for a, b in ("ab", "cd", "ef", "gh")]
    assert got[4] == texts[4] and got[5] == texts[5]


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    words = lambda side: " ".join(f"{side}{i}" for i in range(30))
    rows = [(1, words("a"), "x"), (1, words("a"), "y"), (2, words("a"), "z"), (3, words("b"), "x"), (None, words("c"), "x"), (None, words("c"), "y"), (None, "d", "x"), (4, None, "x"), (4, "e", "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rows", F.lit(1)).repartition(3)
    got = corpus_pipeline.keep_one_of_each(spark, df, SF)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(d), str(t)) for d, t in {(d, t) for d, t, _ in rows} - {(2, words("a"))})
    once = df.where("doc_id in (3, 5)")
    assert corpus_pipeline.keep_one_of_each(spark, once, SF).count() == 2


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on its own input: rejected, copied and leaked documents go, repeats are cut, the rest passes untouched."""
    import hashlib
    import random
    import re

    import corpus_pipeline
    import tiktoken
    from palimpsest.llm import bpe, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    # 1: the classifier's own scores decide.
    good = {r.doc_id for r in stages["quality"](spark, docs, SF).collect()}
    scores = quality.scores(docs, quality.learned_from(spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert good == {r.doc_id for r in scores if r.score >= quality.THRESHOLD}
    # 2: components of all pairs.
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) else set() for d, t in text.items()}
    group = {d: d for d in text}
    ids = sorted(text)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    kept = {r.doc_id for r in stages["near_duplicates"](spark, docs, SF).collect()}
    assert kept == {d for d, g in group.items() if g == d}
    # 3: strings of 101 bytes that stand twice, in runs of more than 50 words or 400 bytes.
    some = spark.createDataFrame([(d, text[d]) for d in ids[:60]], "doc_id long, text string")
    raw, seen = {d: text[d].encode() for d in ids[:60]}, {}
    for t in raw.values():
        for s in range(len(t) - 100):
            seen[t[s : s + 101]] = seen.get(t[s : s + 101], 0) + 1
    for r in stages["repeats"](spark, some, SF).collect():
        t, gone, s = raw[r.doc_id], bytearray(len(raw[r.doc_id])), 0
        again = [seen[t[s : s + 101]] > 1 for s in range(len(t) - 100)]
        while s < len(again):
            e = s
            while e < len(again) and again[e]:
                e += 1
            if e > s and (e - 1 + 101 - s >= 400 or len(t[s : e + 100].split()) > 50):
                gone[s : e + 100] = b"\1" * (e + 100 - s)
            s = max(e, s + 1)
        assert r.text == bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    # 4: windows of ten words.
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + min(10, len(w))]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := word(r.text)) for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    leaked = {d for d, t in text.items() if (w := word(t)) and any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in stages["decontaminate"](spark, docs, SF).collect()} == set(text) - leaked and leaked
    # 5: the tokenizer itself.
    path, pattern = bpe.vocabulary()
    import base64

    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    rows = {r.doc_id: r for r in stages["tokens"](spark, docs, SF).collect()}
    for d in random.Random(1).sample(ids, 60):
        assert list(rows[d].token_ids) == plain.encode_ordinary(text[d]) and rows[d].decoded_sha256 == hashlib.sha256(text[d].encode()).hexdigest()
