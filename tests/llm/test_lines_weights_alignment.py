"""Line dedup, importance resampling and token alignment against brute force: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import alignment, bpe, linededup, resampling
from palimpsest.llm.shared import new_path, settings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHING = "h long, g long, n string, place int, places int, keys string, t1 int, t2 int, times int, row string, pairs int, buckets int, weight int, short int, part int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    """Rows of (doc_id, text) with further columns, all null, whose names the operators use themselves."""
    names = [c.split(" ") for c in CLASHING.split(", ")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(None).cast(t).alias(c) for c, t in names]).repartition(4)


# ---------------------------------------------------------------- 11


def lined():
    rng = random.Random(3)
    common = ["All rights reserved.", "\tall RIGHTS reserved.  ", "—", "x", "", "  ", "\x0b\f", "Äpfel", "äpfel", "a ", "menu | home"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"line {rng.randint(0, 400)}" for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (63, "\n\n x"), (None, "x\nno id"), (None, "x\nno id"), (None, None), (7, "other text of id 7\nx"), (64, "only here"), rows[5], rows[5]]
    rows.append((65, "\n".join(rng.choice(common) if i % 3 else f"long {i}" for i in range(30_000))))  # very long
    return rows


def brute_lines(rows, min_docs, min_chars):
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in held.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


@pytest.mark.parametrize(("min_docs", "min_chars", "batches"), [(10, 1, 5), (3, 5, 2), (1, 1, 1)])
def test_lines(spark, min_docs, min_chars, batches):
    rows = lined()
    store = linededup.LineRuns(spark, new_path(spark, "store"), min_docs, min_chars, fanout=2)
    for k in range(batches):
        assert store.add(table(spark, rows[k::batches]), f"batch {k}")
    got = linededup.drop_lines(table(spark, rows), store.frequent(), min_chars)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect()) == brute_lines(rows, min_docs, min_chars)


def test_lines_by_sort_merge_joins(spark):
    """Beyond the broadcast threshold the joins merge, with the same rows."""
    rows = lined()
    store = linededup.LineRuns(spark, new_path(spark, "store"))
    store.add(table(spark, rows), "all")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"} if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) else {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        got = linededup.drop_lines(table(spark, rows), store.frequent())
        assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect()) == brute_lines(rows, 10, 1)


def test_runs_have_levels_and_open_again(spark):
    rows, path = lined(), new_path(spark, "store")
    store = linededup.LineRuns(spark, path, fanout=2)
    for k in range(6):
        store.add(table(spark, rows[k::6]), str(k))
    assert sorted(level for level, _ in store.runs) == [1, 2]  # 4 + 2 batches
    before = {tuple(r) for r in store.frequent().collect()}
    for _, name in store.runs:
        spark.sql(f"DROP TABLE {name}")  # another session knows none of them
    again = linededup.LineRuns(spark, path, fanout=2)
    assert (again.runs, again.batches) == (store.runs, store.batches) and {tuple(r) for r in again.frequent().collect()} == before
    assert not again.add(table(spark, rows[0::6]), "0") and {tuple(r) for r in again.frequent().collect()} == before  # a replayed batch
    with pytest.raises(ValueError, match="was made for"):
        linededup.LineRuns(spark, path, min_docs=3)
    again.close()
    assert again.frequent().count() == 0


def test_settled_keys_join_no_run_again(spark):
    rows = [(i, "frequent\nown " + str(i)) for i in range(12)]
    store = linededup.LineRuns(spark, new_path(spark, "store"), fanout=9)
    store.add(table(spark, rows), "0")
    store.add(table(spark, [*rows, (99, "FREQUENT\nnew")]), "1")
    sizes = [store.run(name).count() for _, name in store.runs]
    assert sizes == [13, 13]  # the second has "new" and the twelve unsettled keys, not the frequent one
    assert store.frequent().count() == 1


def test_runs_are_merged_without_a_shuffle_or_sort_of_theirs(spark):
    store = linededup.LineRuns(spark, new_path(spark, "store"), fanout=9)
    for k in range(2):
        store.add(table(spark, lined()[k::2]), str(k))
    counts = linededup.counted(table(spark, lined()))
    with settings(spark, linededup.MERGING):
        plan = store.unsettled(counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", plan)) == 1, plan
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning")  # keys are counted before they are dealt
    merged = store._merged([n for _, n in store.runs])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merged


def test_counts_of_runs_add_up(spark):
    """Keys that no run alone counts in ten documents, in as many buckets as there are."""
    store = linededup.LineRuns(spark, new_path(spark, "store"), fanout=3)
    rows = [(i, "\n".join(f"line {k}" for k in range(i % 2, 4000, 2))) for i in range(20)]  # each line in ten documents
    for k in range(4):
        store.add(table(spark, rows[k * 5 : k * 5 + 5]), str(k))
    assert sorted(level for level, _ in store.runs) == [0, 1]
    for names in ([n for _, n in store.runs], *[[n] for _, n in store.runs]):
        merged = store._merged(names)
        assert merged.count() == merged.select("h", "g").distinct().count() == 4000
    assert store.frequent().count() == 4000
    assert linededup.drop_lines(table(spark, rows), store.frequent()).select(F.sum("n_dropped")).first()[0] == 40_000


def test_lines_of_nothing(spark):
    store = linededup.LineRuns(spark, new_path(spark, "store"))
    assert store.frequent().count() == 0
    store.add(table(spark, []), "0")
    assert store.frequent().count() == 0
    assert linededup.drop_lines(table(spark, []), store.frequent()).count() == 0
    assert {(r.text, r.n_lines) for r in linededup.drop_lines(table(spark, [(1, None), (2, "a\n")]), store.frequent()).collect()} == {("", 1), ("a\n", 2)}


def test_each_file_is_in_one_batch(spark, tmp_path):
    spark.range(100).repartition(11).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    dealt = linededup.batches_of(docs, 4)
    assert len(dealt) == 4 and sorted(f for b in dealt for f in b) == sorted(docs.inputFiles())


# ---------------------------------------------------------------- 12


def weighed_rows():
    rng = random.Random(8)
    words = ["Alpha", "beta", "gamma", "DELTA", "é", "1", "2024", "zeta"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "-x"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "..."), (None, rows[3][1]), (None, None), rows[4], rows[4], (83, rows[4][1]), (84, rows[4][1].upper())]
    return rows + [(85, "alpha " * 40_000), (86, "w" * 50_000 + " beta" * 25)]


TARGET = [(1, "alpha beta, ALPHA beta gamma"), (2, None), (3, ""), (3, "zeta zeta"), (None, "é é")]


def brute_weights(rows, target, buckets, width, min_words, percent):
    def features(text):
        words = WORD.findall(lower(text))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in table for f in features(x)[1]) for table in (rows, target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + float(buckets)) / ((s[b] + 1.0) * (total_t + float(buckets)))))
    out = []
    for i, x in rows:
        n, f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(v)) for v in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[2]))
    for k in range(percent * len(able) // 100):
        able[k][4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize(("buckets", "width", "min_words", "percent"), [(10_000, 1, 20, 10), (7, 3, 0, 100), (50, 2, 5, 33)])
def test_resampling(spark, buckets, width, min_words, percent):
    rows, target = weighed_rows(), table(spark, TARGET)
    got = resampling.draw(resampling.weigh(table(spark, rows), target, buckets, width), min_words, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_weights(rows, TARGET, buckets, width, min_words, percent)


def test_identical_texts_are_weighed_once(spark):
    rows = [(i, "one text of all " * 9) for i in range(500)] + [(1000, "another text " * 20)]
    seen = []
    original = resampling.buckets_of
    try:
        resampling.buckets_of = lambda df, *a: seen.append(df.count()) or original(df, *a)
        got = resampling.weigh(table(spark, rows), table(spark, TARGET)).collect()
    finally:
        resampling.buckets_of = original
    assert seen[0] == 2 and len(got) == 501


def test_resampling_of_nothing(spark):
    none = table(spark, [])
    assert resampling.draw(resampling.weigh(none, table(spark, TARGET))).count() == 0
    rows = weighed_rows()
    got = resampling.draw(resampling.weigh(table(spark, rows), none))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_weights(rows, [], 10_000, 1, 20, 10)


# ---------------------------------------------------------------- 13


def aligned_texts():
    rng = random.Random(6)
    texts = ["Hello world", "hello  two   spaces ", " leading", "▁ is no space", "<|endoftext|> and <s></s><unk> <0x41>", "tab\tnew\n\nline\r\n", "nul\0 byte", "naïve café 你好 🙂🙂", "", None, "a", " ", "don't WON'T 12345678", "ﬁ ligature ½"]
    texts += ["".join(rng.choice(["lo", "mira", " ", "ß", "  ", "9", "é", "\n", "x" * 7]) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    return [*texts, texts[0], texts[0], "".join(rng.choice("qzxj") for _ in range(3000)), " ".join(rng.choice(["lomira", "den", "of", "it's", "é" * 3]) for _ in range(40_000))]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, _, b_path = alignment.vocabularies()
    first, second = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    first.encode_special_tokens = True
    letters, held, each = alignment.byte_letters(), Counter(), []
    for text in texts:
        whole, groups, a, b = (" " + (text or "")).encode(), [], [], []
        if text:
            code = first.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(letters[c] for c in t)) for i, t in zip(code.ids, code.tokens, strict=True)]
            b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
            if {b"".join(x for _, x in side) for side in (a, b)} != {whole}:
                a, b = [], []
        ends = [[sum(len(x) for _, x in side[: k + 1]) for k in range(len(side))] if len(side) < 4000 else list(__import__("itertools").accumulate(len(x) for _, x in side)) for side in (a, b)]
        i = j = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]))
            i, j = k, m
        each.append((len(a), len(b), groups))
        held.update({(x, y) for p, q in groups for x in p for y in q})
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for n_a, n_b, groups in each:
        links = [(x, y) for p, q in groups for x in p for y in q]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out, held, top


def test_alignment(spark):
    texts = aligned_texts()
    ids = [None if k in (3, 7) else k // 2 if k > 40 else k for k in range(len(texts))]  # null and repeated ids
    want, held, top = brute_alignment(texts)
    got, pairs = alignment.align(table(spark, list(zip(ids, texts, strict=True))), *alignment.vocabularies())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((i, *w)) for i, w in zip(ids, want, strict=True))
    assert {(r.a_id, r.b_id): (r["count"], r.best) for r in pairs.collect()} == {k: (n, n == top[k[0]]) for k, n in held.items()}
    assert any(w[0] == 0 for w in want[:8]) and alignment.align(table(spark, []), *alignment.vocabularies())[0].count() == 0


@pytest.mark.parametrize(("block", "swept", "wide", "chars"), [(4096, 1 << 19, 4096, 1 << 16), (3, 1, 2, 5), (2, 40, 5, 20), (50, 7, 1, 9)])
def test_machine_in_small_steps(monkeypatch, block, swept, wide, chars):
    """However the events are cut, totals, digests and pairs stay; the machine holds no more than an open group and a block."""
    for name, value in (("BLOCK", block), ("SWEPT", swept), ("WIDE", wide), ("PIECE_CHARS", chars)):
        monkeypatch.setattr(alignment, name, value)
    a, pattern, b = alignment.vocabularies()
    pair = alignment.Pair(bpe.load_ranks(a), pattern, bpe.load_ranks(b))
    texts = [t for t in aligned_texts() if t is None or len(t) < 3000]
    want, held, _ = brute_alignment(texts)
    batch = alignment._events(pair, list(range(len(texts))), list(range(len(texts))), texts)
    batch = batch.sort_by([("row", "ascending"), ("start", "ascending"), ("side", "ascending")])
    machine, rows, most = alignment.Sweep(pair), [], 0
    for blocks in alignment._runs(batch):
        rows += machine.take(blocks)
        most = max(most, sum(len(x[4]) for x in machine.open))
    rows += machine.end()
    totals, digests, links, whole = defaultdict(lambda: [0] * 4), {}, defaultdict(Counter), defaultdict(list)
    for row, _, *sums, digest, once, pairs, times in rows:
        totals[row] = [x + y for x, y in zip(totals[row], sums, strict=True)]
        digests[row] = digest if digest is not None else digests.get(row)
        for p, n in zip(pairs.tolist(), times.tolist(), strict=True):
            links[row][divmod(p, pair.sizes[1])] += n
        if len(pairs):
            whole[row].append(once)
    assert all(len(x) == 1 or not any(x) for x in whole.values())  # a document in parts is never taken for whole
    for k, w in enumerate(want):
        assert (*totals[k], digests[k]) == (*w[:4], w[6]), k
        assert sum(links[k].values()) == w[3] and sum(n * held[x] for x, n in links[k].items()) == w[5]
    assert block > 100 or most < 2 * (block + 60)


def test_ids_of_the_json_vocabulary(spark):
    """The ranks of the JSON file give what its own library gives."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path, pattern, _ = alignment.vocabularies()
    side = alignment.ByteBpe(bpe.load_ranks(path), pattern)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    texts = [t for t in aligned_texts() if t] + [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)} \n{chr(c)}" for c in range(0x20, 0x3100, 7)]
    assert [x.tolist() for x in side.encode(texts)] == [e.ids for e in own.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]

