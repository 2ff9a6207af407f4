"""Each operator against brute force on small fixtures: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from palimpsest.llm import arrowtext, bpe, components, decontaminate, langid, minhash, passages, quality, sharding, suffixes, vectors, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, place string"
WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi") for b in ("ra", "so", "tu") for c in ("", "n", "st", "x")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS).capitalize() if rng.random() < 0.1 else rng.choice(WORDS) + rng.choice(["", "", ",", ".", "é"]) for _ in range(n))


def corpus():
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(30)]
    shared = prose(rng, 120)
    texts += [prose(rng, 60) + " " + shared + " " + prose(rng, rng.randint(0, 90)) for _ in range(6)]
    texts += [texts[3], texts[3], texts[4].upper(), "", None, "   \n", "a", "é", "1 2 3", "🙂 🙂", texts[31] + "\0" * 500, "\0" * 900]
    for k in range(8):  # near copies
        words = texts[5].split(" ") + prose(rng, 150).split(" ") if k < 4 else texts[40 - k].split(" ") if texts[40 - k] else ["x"]
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts.append(prose(rng, 60_000))  # very long
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "xx", "s", None, 1, "p") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(None, "no id", None, None, None, None, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


# ---------------------------------------------------------------- bytes and words


def test_words_never_join_across_documents():
    body, offs = np.frombuffer(b"abab cd", np.uint8), np.array([0, 2, 2, 7])
    starts, ends, firsts = arrowtext.word_bounds(arrowtext.SPACED[body], offs)
    assert [body[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == [b"ab", b"ab", b"cd"] and firsts.tolist() == [0, 1, 1, 3]
    h = arrowtext.word_hashes(body, starts, ends)
    assert h[0] == h[1] != h[2]


# ---------------------------------------------------------------- 3


def test_decontaminate(spark, docs, empty):
    items = [(1, TEXTS[31]), (2, " ".join(TEXTS[7].split(" ")[5:25])), (3, "1 2"), (4, None), (5, "..."), (None, "Ba-"), (2, "nothing of this kind"), (10, TEXTS[8][:90])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    sizes = {len(k) for k in windows}
    got = by_id(decontaminate.report(decontaminate.find_overlaps(docs, bench)))
    for d, t in enumerate(TEXTS):
        w, hit, found = word.findall(lower(t)), set(), set()
        for n, j in itertools.product(sizes, range(len(w))):
            if ids := windows.get(tuple(w[j : j + n])):
                hit |= set(range(j, j + n))
                found |= ids
        names = ",".join(sorted(str(i) for i in found if i is not None))
        r = got[d]
        assert (r.n_words, r.n_hit, r.items_sha256, r.contaminated) == (len(w), len(hit), hashlib.sha256(names.encode()).hexdigest(), bool(hit)), d
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {d for d in got if not got[d].contaminated} | {None}
    assert decontaminate.find_overlaps(empty, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.find_overlaps(docs, bench.limit(0)).collect())


def test_benchmark_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, TEXTS[20 + i]) for i in range(8)], "item_id long, text string")
    whole = decontaminate.report(decontaminate.find_overlaps(docs, bench)).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert len([b for b in decontaminate._blocks(bench) if b]) > 2
    key = lambda rows: sorted(map(str, rows))
    assert key(decontaminate.report(decontaminate.find_overlaps(docs, bench)).collect()) == key(whole)
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {r.doc_id for r in whole if not r.contaminated}


# ---------------------------------------------------------------- 4


def test_bpe_round_trip(docs, empty):
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode(docs, path, pattern))
    for d, t in enumerate(TEXTS):
        ids = plain.encode_ordinary(t or "")
        assert list(got[d].token_ids) == ids and got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = by_id(bpe.decode(bpe.encode(docs, path, pattern), path, pattern))
    assert all(bytes(back[d].content) == (t or "").encode() for d, t in enumerate(TEXTS))
    assert bpe.encode(empty, path, pattern).count() == 0


def test_pieces_keep_matches():
    _, pattern = bpe.vocabulary()
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "'s", "'", " ", "  ", "\n", "9", "!", "é", "　", "\t"]) for _ in range(rng.randint(0, 60)))
        parts = list(bpe.pieces(text, 5))
        assert "".join(parts) == text
        assert [m for p in parts for m in regex.findall(pattern, p)] == regex.findall(pattern, text)


# ---------------------------------------------------------------- 6


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for s in range(len(t) - 399):
            seen[t[s : s + 400]] = seen.get(t[s : s + 400], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        out.append(gone)
    return raw, out


@pytest.mark.parametrize("bucket", [4 << 20, 1500])
def test_suffixes(docs, empty, monkeypatch, bucket):
    texts = TEXTS if bucket > 1500 else [t if t is None or len(t) < 50_000 else t[:3000] for t in TEXTS]  # few bytes a bucket make very many buckets
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    short = docs if texts is TEXTS else docs.withColumn("text", F.when(F.length("text") >= 50_000, F.substring("text", 1, 3000)).otherwise(F.col("text")))
    raw, gone = brute_repeats([*texts, "no id"])
    got = by_id(suffixes.remove_repeats(short))
    for d in range(len(texts)):
        want = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone[d]))]
        assert [(s.start, s.end) for s in got[d].spans] == want, d
        assert bytes(got[d].kept) == bytes(b for b, g in zip(raw[d], gone[d], strict=True) if not g)
    assert any(r.spans for r in got.values())
    cut = suffixes.drop_repeats(short)
    assert cut.columns == docs.columns and cut.count() == len(texts) + 1
    assert suffixes.remove_repeats(empty).count() == 0


def test_passages_of_over_50_words_are_told(spark):
    words = lambda side, n: " ".join(f"{side}{i}" for i in range(n))
    rows = [(1, f"{words('a', 40)} {words('p', 55)} {words('b', 40)}"), (2, f"{words('c', 40)} {words('p', 55)}"), (3, f"{words('d', 90)} {words('q', 45)}"), (4, f"{words('q', 45)} {words('e', 9)}"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__doc": F.lit("x"), "th": F.lit(1), "starts400": F.lit(2)}).repartition(3)
    got = by_id(suffixes.remove_repeats(df, passages=True))
    text = {i: (t or "").encode() for i, t in rows}
    assert {i: [text[i][p.start : p.end].split()[-55:] for p in r.passages] for i, r in got.items() if r.passages} == {1: [words("p", 55).encode().split()], 2: [words("p", 55).encode().split()]}
    assert not any(r.spans for r in got.values()) and all(bytes(r.kept) == text[i] for i, r in got.items())
    assert suffixes.drop_repeats(df).columns == df.columns and {(r["__doc"], r.th, r.starts400) for r in suffixes.drop_repeats(df).collect()} == {("x", 1, 2)}


def test_multikey_sort():
    rng = random.Random(1)
    for _ in range(300):
        strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 12))]
        order, lcp = suffixes.multikey_sort(strings)
        ranked = [strings[i] for i in order]
        for i, j in itertools.combinations(range(len(ranked)), 2):
            common = next((k for k, (x, y) in enumerate(zip(ranked[i], ranked[j], strict=False)) if x != y), min(len(ranked[i]), len(ranked[j])))
            assert min(lcp[i + 1 : j + 1]) == common


# ---------------------------------------------------------------- 2 and 8


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    sets = [shingles(t) for t in TEXTS]
    group = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    got = by_id(minhash.near_duplicates(docs))
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), group[d], group[d] == d) for d in range(len(sets))}
    assert len(set(group)) < len(group) - 3
    assert minhash.near_duplicates(empty).count() == 0
    null = minhash.near_duplicates(docs).where("doc_id is null").first()
    assert null.component_id is None and null.kept


def test_links_without_a_common_leader(spark):
    """A chain of texts, each like the next only, is one group whoever leads the buckets."""
    rng = random.Random(3)
    base = [prose(rng, 1).lower() + str(i) for i in range(700)]
    texts = [" ".join(base[k * 20 : k * 20 + 300]) for k in range(20)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0}


def test_passages(spark, docs, empty):
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in TEXTS]
    seen = {}
    for d, w in enumerate(words):
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), set()).add(d)
    exact = {d: set() for d in range(len(words))}
    for d, w in enumerate(words):
        for j in range(len(w) - 49):
            if len(seen[tuple(w[j : j + 50])]) > 1:
                exact[d] |= set(range(j, j + 50))
    got = by_id(passages.repeated_passages(docs))
    for d, where in exact.items():
        found = {k for p in (got[d].passages if d in got else []) for k in range(p.first, p.end)}
        assert where <= found, d
    alone = [d for d in got if not exact[d]]
    sets = {d: shingles(TEXTS[d]) for d in range(len(words))}
    assert all(any(len(sets[d] & sets[e]) > 30 for e in range(len(words)) if e != d) for d in alone)  # near passages only
    assert passages.repeated_passages(empty).count() == 0


def test_changed_words_keep_a_passage():
    """Along a diagonal, every place of a similar run is found, or lies in one with a shared shingle that is."""
    rng = random.Random(17)
    vocabulary = [f"v{k}" for k in range(5000)]
    cases = [(50, [25]), (60, [30]), (70, [35]), (100, [33, 66]), (70, [30, 35]), (50, [1]), (50, [49]), (49, []), (44, []), (50, [10, 30])]
    cases += [(rng.randint(50, 100), [rng.randrange(100) for _ in range(rng.randint(1, 4))]) for _ in range(60)]
    for k, (n, changed) in enumerate(cases):
        words = rng.sample(vocabulary, n) if k % 3 or k < 10 else [rng.choice(vocabulary[:12]) for _ in range(n)]  # some with repeats
        other = [("changed" if k % 5 == 0 else f"changed{i}") if i in changed else w for i, w in enumerate(words)]
        left, right = rng.randrange(60), rng.randrange(60)
        pad = lambda side, m: [f"{side}{i}" for i in range(m)]
        a = passages.tokens_of(" ".join(pad("a", left) + words + pad("c", right)))
        b = passages.tokens_of(" ".join(pad("b", left) + other + pad("d", right)))
        one, two = passages.Tokens(a), passages.Tokens(b)
        similar, m = [], len(a)
        for s in range(m):
            for e in range(s + passages.SPAN - 1, m):
                x, y = set(a[s : e + 1].tolist()), set(b[s : e + 1].tolist())
                if 4 * len(x & y) >= 3 * len(x | y):
                    similar.append((s, e))
        found = passages.stretches(one, two, [(0, 0, m - 1)]) if m >= passages.SPAN else []
        assert all((s, e) in similar and (s, e) == (u, v) for s, e, u, v in found), (n, changed)
        covered = {i for s, e, _, _ in found for i in range(s, e + 1)}
        common = set(a.tolist()) & set(b.tolist())
        assert {i for s, e in similar for i in range(s, e + 1) if {int(a[i]), int(b[i])} & common} <= covered, (n, changed)
        if k < 4:
            assert found, (n, changed)


def _edited(rng, words, edits):
    """Words changed, put in or left out one by one, as long as the shingles' similarity stays at 0.75 or more; and the similarity."""
    pick = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    whole, best, alike = pick(words), list(words), 1.0
    for k in range(edits):
        now, at = list(best), rng.randrange(len(best))
        kind = rng.random()
        now[at : at + (kind < 0.8)] = [] if 0.6 <= kind < 0.8 else [f"edit{k}x{rng.randrange(10**9)}"]
        both = len(whole & pick(now))
        value = both / (len(whole) + len(pick(now)) - both)
        if value >= 0.75 and len(now) >= 50:
            best, alike = now, value
    return best, alike


def test_recall_of_edited_passages(spark):
    """Passages planted in two documents each, with edits down to a similarity of 0.75, some with a frequent line of 30 words inside: nearly all are found."""
    rng = random.Random(23)
    fresh = iter(range(10**9))
    prose_of = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    line, rows, planted = prose_of(30), [], []
    for k in range(240):
        words = prose_of(rng.choice([50, 55, 60, 80, 120, 300]))
        if k % 3 == 0:
            words[5:5] = line  # its first places belong to documents that share nothing else
        other, alike = _edited(rng, words, rng.choice([0, 1, 2, 4, 12]))
        for version in (words, other):
            head = prose_of(rng.randrange(80))
            planted.append((k, len(rows), len(head), len(head) + len(version), alike))
            rows.append((len(rows), " ".join(head + version + prose_of(rng.randrange(80)))))
    clean = range(len(rows), len(rows) + 60)
    rows += [(d, " ".join(prose_of(150)[:100] + line + prose_of(20))) for d in clean]
    got = by_id(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert not [d for d in clean if d in got]  # a common line of 30 words is no passage
    hit = {}
    for k, d, first, end, alike in planted:
        found = {i for p in (got[d].passages if d in got else []) for i in range(p.first, p.end)}
        hit[k, alike] = hit.get((k, alike), True) and len(found & set(range(first, end))) >= 0.8 * (end - first)
    low = [v for (_, alike), v in hit.items() if alike < 0.85]
    assert len(low) > 40 and sum(low) >= 0.9 * len(low), sum(low) / len(low)
    assert sum(hit.values()) >= 0.97 * len(hit), sum(hit.values()) / len(hit)
    print("recall", sum(hit.values()) / len(hit), "below 0.85", sum(low) / len(low))


def test_all_windows_of_a_group_meet():
    """The windows of up to SMALL sequences with one shingle meet each other; the windows of a larger group come out for the cells."""
    def met(n, size):
        rows = pa.RecordBatch.from_pydict({"key": pa.array([5] * n + [6]), "seq": pa.array([*range(n), 0]), "place": pa.array(passages.pack(np.zeros(n + 1), 100 + np.arange(n + 1), np.full(n + 1, 40), np.full(n + 1, 40), np.full(n + 1, 2)))})
        out = pa.Table.from_batches(passages._meet(rows.slice(k, size) for k in range(0, n + 1, size))).to_pylist()
        return {(r["a"], r["b"]) for r in out if r["function"] == 2}, [r["b"] for r in out if r["function"] == 2 + passages.ALONE]

    for size in (3, 100):
        assert met(20, size) == (set(itertools.combinations(range(20), 2)), [])
        pairs, alone = met(passages.SMALL + 1, size)
        assert pairs and alone == list(range(passages.SMALL + 1))


def test_passages_behind_a_frequent_line(spark):
    """Each of 300 passages of 50 words that stand twice is found though the line of 40 words inside stands in 1,200 documents, and those that differ are not."""
    rng = random.Random(31)
    fresh = iter(range(10**9))
    prose_of = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    line, rows = prose_of(40), []
    for k in range(600):
        around = prose_of(10)
        for j in range(2):
            words = [*around[:5], *line, *around[5:]] if k < 300 else [*prose_of(20), *line, *prose_of(20)]
            rows.append((2 * k + j, " ".join(prose_of(rng.randrange(1, 60)) + words + prose_of(rng.randrange(1, 60)))))
    got = by_id(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    texts = dict(rows)
    for k in range(300):
        for d in (2 * k, 2 * k + 1):
            start = texts[d].split().index(line[0]) - 5
            assert any(p.first <= start and p.end >= start + 50 for p in got[d].passages), d
        assert got[2 * k].group_id == got[2 * k + 1].group_id


def test_pairs_are_verified_in_parts(spark, monkeypatch):
    """Each of 40 near copies is paired with all others: no write's shuffles hold all those pairs with their texts at once, and every link is found."""
    rng = random.Random(41)
    base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows = []
    for d in range(40):
        at = rng.randrange(300)
        rows.append((d, " ".join([*base[:at], f"edit{d}", *base[at + 1 :]])))
    links = set(itertools.combinations(range(40), 2))
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def stages():
        """Shuffled rows by stage."""
        sc.listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList()
        all_ = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(all_.apply, range(all_.size()))}

    most, write = [], passages.materialize

    def noted(df, tag):
        before = stages()
        out = write(df, tag)
        if tag == "passages":
            most.append(sum(n for k, n in stages().items() if k not in before))
        return out

    monkeypatch.setattr(passages, "materialize", noted)
    monkeypatch.setattr(passages, "PART_BYTES", 1 << 10, raising=False)
    joins = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(joins)
    spark.conf.set(joins, "-1")  # as large tables are joined
    try:
        pairs = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))[2]
    finally:
        spark.conf.set(joins, before)
    assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == links
    assert 0 < max(most) < len(links), most


def test_windows_of_cells_are_placed_in_parts():
    """The parts hold each window in each of its cells once, whole cells each, and no part most of them."""
    window = lambda key, block: {"key": key, "blocks": 9, "block": block, "centre": 20, "first": 0, "last": 60}
    rows = [{"seq": d, "doc": d, "component": d, "spans": [], "text": " ".join(f"w{d}x{i}" for i in range(80)), "windows": [window(7, d % 9), window(-3, d % 5)]} for d in range(40)]
    batch = pa.RecordBatch.from_pylist(rows)
    placed = lambda n, k: [tuple(r.values()) for b in passages._placed(n, k)([batch]) for r in b.to_pylist()]
    parts = [placed(6, k) for k in range(6)]
    assert sorted(itertools.chain(*parts)) == sorted(placed(1, 0)) and len(placed(1, 0)) == 40 * 2 * 9
    cells = [{r[:3] for r in part} for part in parts]
    assert sum(map(len, cells)) == len(set().union(*cells))
    assert max(map(len, parts)) < 40 * 2 * 9 / 2
    assert (passages._parts(None, None), passages._parts(10, passages.PART_BYTES + 1), passages._parts(passages.PART_BYTES, 5 * passages.PART_BYTES)) == (1, 2, 3)


def test_runs_of_one_shingle_are_a_few_windows():
    values = np.array([9, 8, 1, *[1] * 199, *range(2, 60)], np.uint64) << np.uint64(32)
    begins, ends = np.array([0]), np.array([len(values)])
    all_ = passages.compact_windows(values, begins, ends)
    within = passages.thinned(values, *all_)[4]
    of, at, left, right = (x[~within] for x in passages.thinned(values, *all_)[:4])
    run = values[at] == values[2]
    assert len(all_[1]) > 200 and at[run].tolist() == [2, 48, 94, 140, 186, 201]
    assert (left[run] == 0).all() and (right[run] == len(values) - 1).all()


def test_passages_of_shared_ids_and_far_places(spark):
    """Rows that share a doc_id are one document; a passage stands where it stands in a very long text."""
    rng = random.Random(5)
    words = lambda side, n: " ".join(f"{side}{i}" for i in range(n))
    passage = words("p", 60)
    rows = [(1, words("a", 70) + " " + passage), (1, words("b", 90)), (2, words("c", 40_000) + " " + passage), (2, words("c", 40_000) + " " + passage), (3, words("d", 100)), (None, passage)]
    rng.shuffle(rows)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, p.first, p.end) for r in got for p in r.passages} == {(1, 70, 130), (2, 40_000, 40_060)}


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)]
    low = {n: n for p in pairs for n in p}
    for _ in range(200):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: c for n, c in low.items() if any(a != b and n in (a, b) for a, b in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 7


def test_arc_versions():
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\n\r\nhi\nWARC/1.1\r\n"
        content = warc.arc_head(version, "f.arc") + warc.arc_record(version, "f.arc", 0, "http://a b/c", "-", "text/html", body) + warc.arc_record(version, "f.arc", 0, None, "-", "text/plain", b"")
        (first, one), (second, two) = warc.parse_arc(content)
        assert one == body and first["URL"] == "http://a%20b/c" and first["Archive-date"] == warc.CRAWL_DATE and two == b"" and second["URL"] == "-"
        assert ("Result-code" in first) == (version == 2)
    with pytest.raises(ValueError):
        list(warc.parse_arc(content[:-10]))
    assert warc.timestamp("19970203040506") == "1997-02-03T04:05:06Z"
    assert warc.split_http(b"plain") is None


@pytest.mark.parametrize("size", [8 << 20, 300])
def test_warc_round_trip(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    big, trap = "x" * 1200, "WARC/1.1\r\n\r\n" + "y" * 1500 + "\r\n\r\n"
    rows = [(1, "http://u/1", big), (2, None, big), (9, "http://u/9", big), (9, "http://u/9", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", trap), (7, "v", trap), (None, "n", big), (8, "é", "ü" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    warc.write_arc(pages, str(tmp_path / "arc"))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = sorted(((r.source_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        best = max((k for k, _, h in rows if h == html and k is not None), default=None)
        again = len(raw) >= 1000 and best is not None and (i is None or i < best)
        want.append((i, hashlib.sha1(raw).hexdigest(), len(raw), "revisit" if again else "response", best if again else None))
    assert got == sorted(want, key=str)
    heads = [h for c in warc._read_files(spark, str(tmp_path / "warc")).collect() for h, _ in warc.parse_warc(warc._unzip(bytes(c.content)))]
    by_id_ = {h["warc-record-id"]: h for h in heads}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert revisits and all(h["warc-refers-to-target-uri"] == by_id_[h["warc-refers-to"]]["warc-target-uri"] and h["warc-refers-to-date"] == by_id_[h["warc-refers-to"]]["warc-date"] for h in revisits)
    assert all(by_id_[h["warc-refers-to"]]["warc-type"] == "response" for h in revisits) and 0 < sum(h["warc-type"] == "warcinfo" for h in heads) < len(heads)
    warc.write_arc(pages.limit(0), str(tmp_path / "arc0"))
    warc.convert(spark, str(tmp_path / "arc0"), str(tmp_path / "warc0"))
    assert warc.read_warc(spark, str(tmp_path / "warc0")).count() == 0


# ---------------------------------------------------------------- 9


def test_sharding(spark, docs, empty):
    placed, slot_map = sharding.place(docs, shards=4)
    rows = placed.collect()
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    for s in range(4):
        places = sorted(r.slot for r in rows if r.shard == s)
        assert places == list(range(len(places)))
    assert {r.version for r in slot_map.select("version").distinct().collect()} == {0, 1}
    assert sharding.place(empty, shards=4)[0].count() == 0
    want = sorted((str(d), len((t or "").encode()) + 1) for d, t in [*enumerate(TEXTS), (None, "no id")])
    assert sorted((str(r.doc_id), r.size) for r in rows) == want
    totals = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(totals) - min(totals) <= max(r.size for r in rows)
    rng = random.Random(2)
    load = {s: rng.randint(1, 1000) for s in range(4096)}
    owner = sharding.rebalance(sharding.first_map(4096, 8), load, 8)
    totals = [sum(w for s, w in load.items() if owner[s] == k) for k in range(8)]
    assert max(totals) - min(totals) <= 2
    assert sharding.rebalance([0] * 10, {}, 3) == [0] * 10


def test_no_row_is_too_common_to_balance(spark, tmp_path):
    """A third of all rows without id and of one text; a stored map goes on from its newest version."""
    rows = [(None, "the same text of all") for _ in range(3000)] + [(i, "x" * (i % 37)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).repartition(6)
    store = str(tmp_path / "map")
    placed, slot_map = sharding.place(df, store=store)
    got = placed.collect()
    assert sorted(r.size for r in got) == sorted(len(t) + 1 for _, t in rows)
    totals = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(totals) - min(totals) <= 64, totals
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.virtual_slot for r in got if r.doc_id is None}) > 1000
    version, owner = sharding.load_map(spark, store)
    assert version == 1 and owner == [r.shard for r in slot_map.where("version = 1").orderBy("virtual_slot").collect()]
    again, _ = sharding.place(df.where("doc_id is null or doc_id < 3000"), store=store)
    version, edited = sharding.load_map(spark, store)
    totals = [0] * 8
    for r in again.collect():
        totals[r.shard] += r.size
    assert version == 2 and 0 < sum(a != b for a, b in zip(owner, edited, strict=True)) < 2000 and max(totals) - min(totals) <= 64
    assert sharding.load_map(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        sharding.place(df, shards=4, store=store)


# ---------------------------------------------------------------- 10


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ITEMS", 64)
    monkeypatch.setattr(vectors, "QUERIES", 128)
    monkeypatch.setattr(vectors, "LIST", 40)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 24))
    near = base[:200] + rng.normal(size=(200, 24)) * rng.uniform(0.02, 0.12, (200, 1)) * 4.5
    hub = base[0] + rng.normal(size=(150, 24)) * 0.05
    x = np.concatenate((base, near, hub, base[5:8], base[9:10] * 3)).astype(np.float32)
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [1.0] * 5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).repartition(4)
    got = {r.vec_id: r for r in vectors.link(df).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
    low = np.arange(len(x))
    near_ = unit @ unit.T >= 0.9
    for _ in range(len(x)):
        new = np.where(near_, low, len(x)).min(axis=1)
        if (new == low).all():
            break
        low = new
    same = np.array([got[i].component_id for i in range(len(x))]) == low
    assert (same | (found < true)).all() and same.mean() > 0.99  # a component may be larger by a link that was not found only
    assert all(got[2000 + i].n_links == 0 and got[2000 + i].kept for i in range(len(odd)))
    assert all(r.component_id <= i for i, r in got.items())
    assert got[len(x) - 4].component_id == got[5].component_id
    assert vectors.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("sample, part", [(20_000, 1000), (800, 100)])
def test_probes_choose_among_many_lists(spark, monkeypatch, sample, part):
    """At a size where a vector's probes are a tenth of the lists, nearly all links are found, none below the bound, and groups follow the links.

    The second case has a sample so small that its lists are parted.
    """
    monkeypatch.setattr(vectors, "SAMPLE", sample)
    monkeypatch.setattr(vectors, "PART", part)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30_000, 32))
    copies = base[:3000] + rng.normal(size=(3000, 32)) * rng.uniform(0.05, 0.45, (3000, 1))
    x = np.concatenate((base, copies)).astype(np.float32)
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").createOrReplaceTempView("many")
    got = {r.vec_id: r for r in vectors.link(spark.table("many")).collect()}
    assert len(x) // vectors.LIST > 10 * vectors.PROBES
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true, links = np.zeros(len(x), int), []
    for lo in range(0, len(x), 2000):
        a, b = np.nonzero(unit[lo : lo + 2000] @ unit.T >= 0.9)
        a += lo
        keep = a != b
        np.add.at(true, a[keep], 1)
        links += list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))
    found = np.array([got[i].n_links for i in range(len(x))])
    print("recall", found.sum() / true.sum())
    assert true.sum() > 2000 and (found <= true).all() and found.sum() >= 0.98 * true.sum(), (found.sum(), true.sum())
    assert np.mean([got[a].component_id == got[b].component_id for a, b in links]) >= 0.98
    alone = np.flatnonzero(true == 0)
    assert all(got[i].kept and got[i].component_id == i for i in alone.tolist())


# ---------------------------------------------------------------- 1 and 5


def spoken(rng, lang, n):
    return " ".join(rng.choice({"aa": ["the", "house", "thing", "with"], "bb": ["der", "haus", "ding", "mit", "schön"], "cc": ["дом", "вещь", "с", "этот"]}[lang]) for _ in range(n))


def test_language_spans(spark, empty):
    rng = random.Random(8)
    rows = [(spoken(rng, lang, rng.randint(1, 60)), lang) for _ in range(60) for lang in ("aa", "bb", "cc")]
    model = langid.train(spark.createDataFrame(rows + [(None, "aa"), ("x", None)], "text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    mixed = spoken(rng, "aa", 30) + " " + spoken(rng, "bb", 20) + " " + spoken(rng, "cc", 10)
    texts = [mixed, spoken(rng, "bb", 3000), "", None, "123 !?", "🙂", "этот"]
    got = by_id(langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model))
    assert [s.lang for s in got[0].spans] == ["aa", "bb", "cc"] and got[0].lang_pred == "aa" and 0.3 < got[0].score < 0.8
    assert mixed.encode()[got[0].spans[1].start : got[0].spans[1].end].decode().split()[-1] in ("der", "haus", "ding", "mit", "schön")
    assert [got[i].lang_pred for i in range(1, 7)] == ["bb", "und", "und", "und", "und", "cc"]
    assert langid.identify(empty, model).count() == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), nothing).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes = rng.integers(0, 6, 4)
        firsts = np.concatenate(([0], np.cumsum(sizes)))
        scores = rng.normal(size=(int(firsts[-1]), 3)).astype(np.float32) * 3
        labels = langid.viterbi(scores, firsts, 1.5)
        for lo, hi in zip(firsts[:-1], firsts[1:], strict=True):
            value = lambda path: sum(scores[lo + k, p] for k, p in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
            best = max(map(value, itertools.product(range(3), repeat=int(hi - lo))), default=0)
            assert value(labels[lo:hi]) == pytest.approx(best, abs=1e-4)


def test_quality(spark, docs, empty):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        good = i % 4 != 0
        text = prose(rng, rng.randint(20, 80))
        rows.append((i, text if good else " ".join(w.upper() + rng.choice(["!!", "$$$", "&&&"]) for w in text.split()), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    labels = df.where("doc_id % 5 <> 0").select("doc_id", "quality")
    extra = spark.createDataFrame([(None, 1), (1, None), (3, 0), (3, 1), (99999, 1)], "doc_id long, quality int")
    held = [r for r in quality.scores(df, labels.unionByName(extra)).collect() if r.doc_id % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held]) > 0.9
    kept = quality.keep_good(df.withColumn("vector", F.lit(0)), labels)
    assert kept.columns == [*df.columns, "vector"] and np.mean([r.quality for r in kept.collect()]) > 0.95
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.scores(empty, labels).count() == 0


def test_quality_against_brute_force(spark):
    """Neighbour counts, pooling and scores by plain loops; repeated rows score alike, very long and empty texts score too."""
    rng = random.Random(40)
    texts = [prose(rng, rng.randint(3, 60)) if i % 3 else prose(rng, 20).upper() + " !!!" for i in range(90)] + ["", None, prose(rng, 30_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    split = lambda t: quality.tokens(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].tolist()
    context = np.zeros((quality.VOCABULARY, quality.SIZE))
    for _, t in rows:
        words = split(t)
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.NEAR), min(len(words), i + quality.NEAR + 1)):
                if j != i:
                    context[w, quality.DIMS[words[j]]] += quality.SIGNS[0]
    length = np.linalg.norm(context, axis=1, keepdims=True)
    vectors_ = (context / np.where(length > 0, length, 1)).astype(np.float32)
    assert np.allclose(quality.word_vectors(df), vectors_)

    def feature(t):
        v = vectors_[split(t)]
        return np.concatenate((v.mean(axis=0), v.std(axis=0))) if len(v) else np.zeros(2 * quality.SIZE)

    network = quality.Network(np.array([feature(texts[i]) for i in range(90)], np.float32).astype(np.float64), np.array([int(i % 3 > 0) for i in range(90)]))
    got = quality.scores(df, labels).collect()
    assert len(got) == len(rows)
    want = {i: network(feature(t)[None].astype(np.float32).astype(np.float64))[0] for i, t in enumerate(texts)}
    for r in got:
        assert r.score == pytest.approx(want[7 if r.doc_id is None else r.doc_id], abs=0.02) and r.predicted == int(r.score >= quality.THRESHOLD)
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_ranges_of_a_batch_are_those_of_its_rows():
    """Covered ranges, long passages and what they leave, of all rows of a batch at once, against loops over each row."""
    rng = random.Random(11)
    raws = [b"", *("".join(rng.choice("ab  \t\n\x0bc") for _ in range(rng.randint(300, 1500))).encode() for _ in range(40)), b"", b"x" * 900]
    runs = [sorted({(s, s + rng.randint(0, 60)) for s in (rng.randrange(len(r) - 170) for _ in range(rng.randint(0, 5)))}) if len(r) > 170 else [] for r in raws]
    runs[-1] = [(0, 799), (799, 799), (100, 300)]

    def merged(runs, gap):
        out = []
        for first, last in sorted(runs):
            if out and first <= out[-1][1] + gap:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return out

    column = pa.array([None if not r and k % 2 else [{"first": s, "last": e} for s, e in r] for k, r in enumerate(runs)], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
    body, offs = arrowtext.column_bytes(pa.array(raws, pa.binary()))
    rows = lambda table: [[(s, e) for k, s, e in zip(*(x.tolist() for x in table), strict=True) if k == row] for row in range(len(raws))]
    cut = suffixes.covered(*suffixes._starts(column), 101)
    want = [[(s, e + 101) for s, e in merged(r, 101)] for r in runs]
    assert rows(cut) == want
    left = [bytes(b for i, b in enumerate(raw) if not any(s <= i < e for s, e in spans)) for raw, spans in zip(raws, want, strict=True)]
    assert suffixes._kept(body, offs, *cut).to_pylist() == left
    long = suffixes.long_passages(body, offs, *suffixes._starts(column), 101)
    assert rows(long) == [[(s, e) for s, e in merged(r, 1) if e + 101 - s >= 400 or len(raw[s : e + 101].split()) > 50] for raw, r in zip(raws, runs, strict=True)]
    assert 0 < len(long[0]) < sum(len(merged(r, 1)) for r in runs)
    assert suffixes.covered(*suffixes._starts(column.slice(0, 0)))[0].tolist() == []


def test_passages_are_looked_for_where_none_is_yet():
    """Shared words outside of passages, too few for one, do not bring back passages that both sides know already."""
    line, rest = [f"w{i}" for i in range(80)], [f"line{i}" for i in range(12)]
    foreign = lambda side: [f"{side}{i}" for i in range(20)]
    one, two = (passages.Tokens(passages.tokens_of(" ".join(line[:40] + [f"odd{side}"] + line[41:] + foreign(side) + rest))) for side in "ab")
    whole = [(0, 0, len(one.values) - 1)]
    assert passages.stretches(one, two, whole)
    known = np.arange(len(one.values)) >= 100  # only the line of 12 words lies in no passage
    assert passages.stretches(one, two, whole, (known, known)) == []
    known[:5] = True
    assert [s for s, *_ in passages.stretches(one, two, whole, (known, known))] == [0]


def test_pairs_are_grouped_with_their_widest_ranges():
    rows = [(1, 2, 3, 0, 10, 80, 1), (1, 2, 3, 1, 10, 70, 1), (1, 2, 3, 2, 12, 80, 0), (1, 2, 3, 4, 60, 99, 1), (1, 2, -4, 4, 12, 60, 1), (1, 3, 0, 0, 0, 50, 1), (1, 3, 0, 1, 0, 50, 1), (4, 1, 0, 0, 0, 50, 1), (4, 1, 0, 1, 0, 50, 1), (4, 1, 0, 5, 0, 50, 1)]
    types = [pa.int64()] * 2 + [pa.int32()] * 5
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=passages.PAIR_NAMES)
    for size in (1, 3, 100):
        got = pa.Table.from_batches(list(passages._grouped(iter(table.to_batches(size)), False))).to_pylist()
        assert [(r["a"], r["b"], r["late"], [tuple(x.values()) for x in r["ranges"]]) for r in got] == [(1, 2, False, [(-4, 12, 60), (3, 10, 80), (3, 60, 99)]), (4, 1, True, [(0, 0, 50)])]


def test_shingles_that_stand_again_are_no_passage(monkeypatch):
    """A word written 120 times is one shingle, so with other words that stand again around it no run needs comparing; what is a passage still is."""
    again = lambda name: [f"{name}{k % 7}" for k in range(150)]
    one, two = (passages.Tokens(passages.tokens_of(" ".join(again(side) + ["same"] * 120 + again(side)))) for side in "ab")
    n, compared = len(one.values), []
    diagonal = passages._diagonal
    monkeypatch.setattr(passages, "_diagonal", lambda x, y, wanted: compared.append(len(x)) or diagonal(x, y, wanted))
    assert passages.stretches(one, two, [(130, 0, n - 131)]) == [] and not compared
    assert passages.stretches(one, two, [(30, 0, n - 31)]) == [(150, 235, 180, 265)]  # the run of one shingle
    rng = random.Random(5)
    for _ in range(300):  # runs of few different shingles: whatever is similar lies in what is left to compare
        x, y = (np.array([rng.randrange(1, 9) if rng.random() < 0.5 else rng.randrange(1, 60) for _ in range(rng.randrange(passages.SPAN, 90))], np.uint64) for _ in "ab")
        m = min(len(x), len(y))
        y = np.where(np.array([rng.random() < 0.8 for _ in range(m)]), x[:m], y[:m])
        a, b = passages.Tokens(x[:m]), passages.Tokens(y)
        in_b, in_a = a.common(b), b.common(a)
        foreign = passages._distinct(a.before, ~in_b) + passages._distinct(b.before, ~in_a)
        lo, hi = passages._able(0, in_b - 3 * (a.once & ~in_b).astype(int) - 3 * (b.once & ~in_a), *passages._shared_ones(a, in_b), foreign, np.ones(m, bool))
        for s in range(m - passages.SPAN + 1):
            for e in range(s + passages.SPAN, m + 1):
                u, v = set(x[s:e].tolist()), set(y[s:e].tolist())
                assert 100 * len(u & v) < passages.SIMILAR * len(u | v) or lo <= s and e - 1 <= hi


def test_windows_that_share_too_little_reach_no_cell(spark, monkeypatch):
    """700 documents share a line of 20 words and nothing else, 54 of them a passage besides: cells get the windows of those only, and find them."""
    rng = random.Random(8)
    fresh = iter(range(10**9))
    prose_of = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    line, around = prose_of(20), prose_of(50)
    rows = [(d, " ".join([*prose_of(rng.randrange(40, 60)), *(around[:25] if d % 13 == 5 else []), *line, *(around[25:] if d % 13 == 5 else []), *prose_of(rng.randrange(40, 60))])) for d in range(700)]
    placed, write = [], passages.materialize

    def noted(df, tag):
        out = write(df, tag)
        if tag == "windows" and "windows" in out.columns:
            placed.extend(r.doc for r in out.select("doc").collect())
        return out

    monkeypatch.setattr(passages, "materialize", noted)
    got = by_id(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    family = set(range(5, 700, 13))
    assert set(got) == family and {r.group_id for r in got.values()} == {5}
    assert all(any(p.end - p.first >= 70 for p in r.passages) for r in got.values())
    assert placed and set(placed) <= family


def test_shingles_are_counted_in_parts_of_a_group():
    """For each window the shingles that other sequences of its group hold, its own others and those of other groups left out, however many parts."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60, 140))) for _ in range(12)]
    rows = []
    for d, text in enumerate(texts):
        n = len(text.split()) - 4
        rows.append({"seq": d, "text": text, "windows": [{"key": d % 2, "deals": 3, "centre": 9, "first": k, "last": n - 1 - k} for k in (0, 3)]})
    parts = pa.Table.from_batches(passages._dealt([pa.RecordBatch.from_pylist(rows)])).sort_by([(c, "ascending") for c in ("main", "i")])
    got = {}
    for r in pa.Table.from_batches(passages._by_cell(passages._elsewhere)(parts.to_batches(7))).to_pylist():
        n, least = got.get((r["seq"], r["first"]), (0, r["least"]))
        got[r["seq"], r["first"]] = n + r["n"], least
    assert len(got) == 24
    tokens = [passages.tokens_of(t) >> np.uint64(32) for t in texts]
    for (d, k), (n, least) in got.items():
        own = lambda e, k: tokens[e][k : len(tokens[e]) - k].tolist()
        others = set().union(*(own(e, 0) for e in range(d % 2, 12, 2) if e != d))
        assert n == len(set(own(d, k)) & others) and least == min(len(set(own(d, k)[s : s + passages.SPAN])) for s in range(len(own(d, k)) - passages.SPAN + 1))


def test_ranges_of_many_pairs_are_looked_at_at_once(monkeypatch):
    """What is looked at for many ranges, or windows, together is told as it is for each alone."""
    monkeypatch.setattr(passages, "FIELD", 700)
    rng = random.Random(10)
    text = lambda: np.array([rng.randrange(1, 40) if rng.random() < 0.5 else rng.randrange(1, 4000) for _ in range(rng.randrange(60, 200))], np.uint64)
    ones, others, every, ranges = [], [], [], []
    for k in range(120):
        x, y = text(), text()
        n = min(len(x), len(y))
        y[:n] = np.where(np.array([rng.random() < (0.97, 0.8, 0.5)[k % 3] for _ in range(n)]), x[:n], y[:n])
        ones.append(passages.Tokens(x))
        others.append(passages.Tokens(y))
        for t in (ones[-1], others[-1]):
            t.open[: rng.randrange(len(t.open))] = False
        every.append(rng.random() < 0.3)
        ranges += [(k, 0, lo, min(n, lo + rng.randrange(30, 90)) - 1) for lo in range(0, n - 30, 25)] + [(k, 3, 0, n - 5)]
    table = np.array(ranges)
    pair, whole = passages._whole_ranges(table[:, 0], table[:, 1:])
    likely = passages._likely(ones, others, np.array(every), pair, whole)
    assert 0 < likely.sum() < len(likely)
    for k, (a, b) in enumerate(zip(ones, others, strict=True)):
        known = None if every[k] else (a.open, b.open)
        assert passages.stretches(a, b, table[table[:, 0] == k][:, 1:].tolist(), known) == passages.stretches(a, b, whole[likely & (pair == k)].tolist(), known)
    # A cell whose first row meets all others, window by window.
    size = [len(x.values) for x in others]
    offs = np.concatenate(([0], np.cumsum(size)))
    token = np.unique(np.concatenate([x.values for x in others]), return_inverse=True)[1]
    order, at = np.lexsort((np.repeat(np.arange(120), size), token)), np.repeat(np.arange(120), size)
    same = (token[order[1:]] == token[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
    before, after = np.full(len(token), -1), np.full(len(token), len(token))
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    open_, mark = np.concatenate([x.open for x in others]), np.zeros(token.max() + 1, bool)
    token[offs[7] : offs[7] + 60] = token[:60]  # not all is foreign
    x, y = np.zeros(119, np.int64) + 2, offs[1:120] + 1
    lengths = np.array([min(size[0] - 2, n - 1) for n in size[1:]])
    got = passages._hopeful(slice(0, offs[1]), x, y, lengths, np.array(every[1:]), token, before, after, open_, np.full(len(mark), -1))
    for k in range(119):
        sides = [slice(s, s + lengths[k]) for s in (x[k], y[k])]
        one, other = (passages.Slice(token, before, after, s, mark) for s in sides)
        assert got[k] != passages._hopeless(one, other, None if every[k + 1] else tuple(open_[s] for s in sides))
