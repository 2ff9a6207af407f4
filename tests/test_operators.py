"""Hand-derived expectations and properties of the operators that SQL does not say."""

import html
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import udfs
from palimpsest.functions.scripts import LATIN, TAMIL
from palimpsest.operators import corpus, formatting, layout, lines, metrics, noise, pairs, recognition, sampling, shaping
from palimpsest.plans import runs
from palimpsest.sources import readers, writers
from palimpsest.streaming import streams


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "line, want",
    [("30 எலி நேரம்", "எலி நேரம்"), ("<b>கண்ண</b>ரடி டாக்ஸி", "கண்ணரடி டாக்ஸி"), ("38", "38"), ("123", None), ("55 GRAT GRATITION.", "GRAT GRATITION."), ("हिन्दी", None), ("", None), (None, None)],
)
def test_clean_line(spark, line, want):
    assert one(spark, lambda c: T.clean_line(c, TAMIL), line) == want


def test_text_rules(spark):
    assert one(spark, T.strip_artifacts, "a1\n\nb1 www.x.com\n40.55\no") == "a1\nb1 "
    assert one(spark, T.split_stanzas, "a   12 b") == ["a", "b"]
    assert one(spark, formatting.strip_page_numbers, "mix\nbody of the page\nmore\nlines\nhere") == "body of the page\nmore\nlines\nhere"
    assert one(spark, lambda c: T.edits_at_least(c, F.lit("abd"), 2), "abc") is False
    assert one(spark, lambda c: T.edits_at_least(c, F.lit("a"), 2), "abc") is True
    assert one(spark, T.split_lines, "a\r\nb\n") == ["a", "b"]
    assert one(spark, T.decode_entities, "a &amp; b &hellip;") == "a & b …"
    assert one(spark, lines.reflow, "long line of text here\ntail\n\n\nnext") == "long line of text here tail\n\nnext"
    assert one(spark, lines.paragraphs, "a.\nb\nc!") == "a.\n\nb c!"
    assert one(spark, T.ends_sentence, "said “so”  ") is True


def test_entities_are_those_of_html(spark):
    rng = random.Random(31)
    bits = ["&", "amp", ";", "#", "x", "38", "3C", "lt", "notit", "not", "nbsp", "hellip", "&#128;", "&#x1F600;", "&#0;", "&#xD800;", "&#99999999999;", "&#11;", "&#xFFFE;", "&#x80", "&ampx", "&lt", "&ltimes;", "é", " ", "<", "&NotEqualTilde;", "&a;", "&1;", "&#013;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(1500)] + ["&amp;lt;", "&amp;amp; &#38;lt;", "no entity", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.decode_entities(F.col("t")).alias("d")).collect()
    assert {r.i: r.d for r in got} == {i: html.unescape(t) for i, t in enumerate(texts)}
    assert one(spark, T.decode_entities, None) is None


def test_open_references_stay_where_tags_were_stripped(spark):
    """``&amp<style>p{`` is ``&ampp{`` without its tag: that is no reference, nor is a longer name closed later."""
    stripped = lambda c: T.decode_entities(T.strip_tags(c), closed=True)
    assert one(spark, stripped, "a &amp<style>p{x} &amp;lt; &not<i>in</i> &ampx; &#39 &#39; &#x3C; &copy;&quot &hellip;") == "a &ampp{x} &lt; &notin &ampx; &#39 ' < ©&quot …"
    assert one(spark, stripped, "&&amp;&;&#;&#x;&nosuch;") == "&&&;&#;&#x;&nosuch;"


def test_merge_short_lines(spark):
    assert one(spark, lines.merge_short_lines, "a short line here\nthat goes on\n\n'speech'\nend.") == "a short line here that goes on\n\n'speech'\nend."
    assert one(spark, lines.merge_short_lines, "tiny\nword") == "tiny\nword"


def test_running_headers(spark):
    def pages(n, with_header):
        return spark.createDataFrame([("d", i + 1, ("Head\n" if i < with_header else "") + f"body {i} text\nmore {i}\nlast {i}\nx {i}\ny {i}") for i in range(n)], "doc string, page int, text string")

    assert [r.line for r in formatting.running_headers(pages(5, 2)).collect()] == ["Head"]
    assert formatting.running_headers(pages(9, 2)).count() == 0
    assert formatting.running_headers(pages(2, 2)).count() == 0
    whole = formatting.format_document(pages(5, 3)).first().text
    assert whole.startswith("=" * 60 + "\nTamil OCR Output — d\nPages processed: 5\n") and whole.count("Head") == 1 and "PAGE 5" in whole


def fold_stanzas(rows):
    out, buffer = [], ""
    for line in rows:
        if len(line) >= 80:
            out += [b for b in (buffer, line) if b]
            buffer = ""
        elif buffer and len(buffer) + 1 + len(line) > 150:
            out.append(buffer)
            buffer = line
        else:
            buffer = f"{buffer} {line}" if buffer else line
            if len(buffer) >= 80:
                out.append(buffer)
                buffer = ""
    return out + [buffer] * (len(buffer) >= 20)


def test_join_stanzas(spark):
    rng = random.Random(5)
    sources = {f"s{k}": ["x" * rng.choice([5, 10, 30, 75, 79, 80, 120]) for _ in range(rng.randint(1, 30))] for k in range(40)}
    df = spark.createDataFrame([(s, i, t) for s, ts in sources.items() for i, t in enumerate(ts)], "source string, line_no int, line string")
    got = {s: [] for s in sources}
    for r in shaping.join_stanzas(df).orderBy("source", "segment", "piece").collect():
        got[r.source].append(r.line)
    assert got == {s: fold_stanzas(ts) for s, ts in sources.items()}


def test_pack(spark):
    rng = random.Random(6)
    texts = [" ".join("w" * rng.randint(1, 12) + rng.choice(["", "", "."]) for _ in range(rng.randint(1, 200))) for _ in range(60)] + ["y" * 1000, "z" * 341]
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", shaping.pack(F.col("t")).alias("p")).collect():
        assert all(20 <= len(p) <= 340 for p in row.p)
        assert row.p == [row.t] or len(row.t) > 340 or (len(row.t) < 20 and row.p == [])


def test_split_sizes(spark):
    for n, want in ((20, 2), (3, 1)):
        df = spark.range(n).select(F.col("id").cast("string").alias("k"))
        rows = sampling.train_val_split(df, 0.10, 42, "k").collect()
        assert sum(r.split == "validation" for r in rows) == want and len(rows) == n
    assert sampling.register_targets(75000) == (30000, 24750, 20250)
    with pytest.raises(ValueError):
        sampling.train_val_split(spark.range(3), 1.0, 1, "id")


def test_repeat_and_redistribute(spark):
    df = spark.range(7).select(F.col("id").cast("string").alias("k"))
    assert sampling.repeat_to(df, 20, 1, "k").count() == 20
    assert sampling.repeat_to(df, 5, 1, "k").count() == 5
    mix = sampling.balance(df, df, df.limit(0), 20, 1, "k").groupBy("register").count().collect()
    assert {r.register: r["count"] for r in mix} == {"modern": 7, "classical": 6 + 5 - 2}


def test_noise(spark):
    texts = ["தமிழ் மொழி மிகவும் பழமையான மொழி ஆகும்", "plain latin", "", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, t string")
    key, text = F.col("k"), F.col("t")
    rows = df.select("t", noise.corrupt(text, key, 0.0).alias("none"), noise.corrupt(text, key, 0.6).alias("much"), noise.register_noise(text, key, F.lit(0.3)).alias("reg"), noise.inject_tags(text, key).alias("tag")).collect()
    assert [r.none for r in rows] == texts
    assert rows[0].much != texts[0] and rows[0].reg != texts[0] and rows[1].reg == texts[1] and rows[2].much == ""
    assert rows[0].tag.replace("<mark>", "").replace("</mark>", "").replace("<sub>", "").replace("</sub>", "").replace("<sup>", "").replace("</sup>", "") == texts[0] and "<" in rows[0].tag


boxes = st.lists(st.tuples(*[st.integers(0, 60)] * 2, *[st.integers(0, 30)] * 2), max_size=14)


@settings(max_examples=300, deadline=None)
@given(boxes, st.integers(1, 3))
def test_reading_order_is_a_permutation(sizes, columns):
    page = [(x, y, x + w, y + h) for x, y, w, h in sizes]
    assert sorted(layout.cut_order(page, columns)) == list(range(len(page)))


def test_reading_order_of_columns():
    left, right = [(0, 0, 40, 10), (0, 20, 40, 30)], [(60, 0, 100, 10), (60, 20, 100, 30)]
    assert layout.cut_order([right[1], left[1], right[0], left[0]]) == [3, 1, 2, 0]


def test_overlap_of_half_is_not_enough(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    line = spark.createDataFrame([("d", 1, 0, "text", (0.0, 0.0, 10.0, 10.0), 1.0)], f"doc string, page int, line_no int, text string, box {box}, confidence double")
    block = spark.createDataFrame([("d", 1, 0, "Text", (5.0, 0.0, 20.0, 10.0), 1.0)], f"doc string, page int, block int, label string, box {box}, confidence double")
    assert layout.assign_lines(line, block).first().block is None
    assert layout.reconstruct(line, block).first().text == "text"


def test_suppression_leaves_no_overlaps(spark):
    rng = random.Random(7)
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [("d", p, b, "Text", (x := rng.random() * 5, y := rng.random() * 5, x + 10, y + 10), rng.random()) for p in range(5) for b in range(12)]
    kept = layout.suppress_duplicates(spark.createDataFrame(rows, f"doc string, page int, block int, label string, box {box}, confidence double"))
    pair = kept.alias("a").join(kept.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.block") < F.col("b.block")))
    assert kept.count() and pair.where(layout.iou(F.col("a.box"), F.col("b.box")) > 0.70).count() == 0


def test_spreads(spark):
    pages = spark.createDataFrame([("a", 1, 1400, 1000), ("b", 1, 1300, 1000)], "doc string, page int, width int, height int")
    assert [(r.doc, r.page, r.x0, r.x1) for r in layout.split_spreads(pages).orderBy("doc", "page").collect()] == [("a", 1, 0, 700), ("a", 2, 700, 1400), ("b", 1, 0, 1300)]


def test_error_rates(spark):
    df = spark.createDataFrame([("k", "the quick brown fox")], "key string, text string")
    wrong = spark.createDataFrame([("k", "the quack brown")], "key string, text string")
    row = metrics.score(wrong, df, "key").first()
    assert row.cer == pytest.approx(5 / 19) and row.wer == pytest.approx(2 / 4)


def test_cleaners_count_rules(spark):
    df = spark.createDataFrame([("s", 0, "3) தமிழ் மொழி மிகவும் பழமையானது ஆகும்"), ("s", 1, "only english here"), ("s", 2, "&lt;")], "source string, line_no int, line string")
    counts = {r.counter: r.lines for r in corpus.clean_report(corpus.clean_web(df), "source").collect()}
    assert counts == {"input": 3, "output": 1, "drop:foreign_heavy": 1, "drop:too_short": 1, "note:list_marker": 1}


def test_models_are_plugged_in(spark):
    import pandas as pd

    def load():
        def engine(page):
            if page.page.iloc[0] == 2:
                raise RuntimeError("blank")
            return pd.DataFrame([{"doc": page.doc.iloc[0], "page": page.page.iloc[0], "line_no": 0, "text": "ab__c", "box": None, "confidence": 0.99}])

        return engine

    recognition.register("echo", load)
    found = recognition.recognise(spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int"), "echo").cache()
    assert {r.error for r in found.collect()} == {None, "[OCR ERROR: blank]"}
    assert [r.text for r in recognition.correct(found.where("error is null"), str.upper).collect()] == ["AB__C"]
    with pytest.raises(ValueError):
        recognition.create("none")


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", None), ("c", "d", "s")], "input string, target string, source string")
    writers.pairs(rows, str(tmp_path / "pairs"))
    assert {r.source for r in readers.json_pairs(spark, str(tmp_path / "pairs")).collect()} == {"unknown", "s"}
    (tmp_path / "t.txt").write_text(" one \n\n two\n")
    assert [r.line for r in readers.text_lines(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]
    for n in ("a.pdf", "b (verify).pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rpartition("/")[2] for r in readers.page_files(spark, str(tmp_path)).collect()] == ["a.pdf"]
    texts = spark.createDataFrame([("d1", "body")], "doc string, text string")
    writers.texts(texts, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "body"


def test_docx_pages(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        for n in (10, 2, 1):
            z.writestr(f"word/media/image{n}.png", b"\x89PNG\r\n\x1a\n%d" % n)
        z.writestr("word/media/image3.png", b"no image")
        z.writestr("word/document.xml", b"no")
    files = readers.page_files(spark, str(tmp_path), "docx")
    assert [(r.page, bytes(r.content)[8:]) for r in readers.docx_pages(files).collect()] == [(1, b"1"), (2, b"2"), (3, b"10")]
    with pytest.raises(Exception, match="more than 2"):
        readers.docx_pages(files, 2).count()
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/media/image1.png", b"\x89PNG\r\n\x1a\n1")
    with zipfile.ZipFile(tmp_path / "y.bin", "w") as z:
        z.writestr("word/document.xml", b"no")
    with pytest.raises(Exception, match="holds no images"):
        readers.docx_pages(readers.page_files(spark, str(tmp_path), "bin")).count()
    assert readers.at_most(readers.docx_pages(files)).count() == 1
    with pytest.raises(Exception, match="pages"):
        readers.at_most(readers.docx_pages(files), 0).count()


def test_paged_interface():
    answers = iter([{"query": {"m": [{"t": 1}]}, "continue": {"c": "x"}}, {"query": {"m": [{"t": 2}, {"t": 3}]}}])
    assert [m["t"] for m in readers.paged(lambda p: next(answers), {}, "m", 2)] == [1, 2]
    waits = []
    assert readers.with_retries(lambda p: 1 / 0, {}, wait=waits.append) == {} and waits == [1, 2]


def test_streams_append_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "text string"

    def run():
        stream = streams.new_files(spark, source, schema)
        streams.append_once(stream, "text", out, mark, lambda df: df.where("text <> ''")).awaitTermination()

    spark.createDataFrame([("a",), ("b",), ("a",), ("",)], schema).write.parquet(source)
    run()
    spark.createDataFrame([("b",), ("c",)], schema).write.mode("append").parquet(source)
    run()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    lines_ = spark.createDataFrame([('{"type":"done","status":"ok"}',), ("junk",)], "value string")
    assert {(r.type, r.message) for r in streams.parse_events(lines_).collect()} == {("done", "ok"), ("error", "junk")}


def test_pairs_resume_and_pack(spark):
    targets = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    assert [r.t for r in pairs.unfinished(targets, targets.where("t = 'a'"), "t").collect()] == ["b"]


def test_long_turns_give_pairs(spark, tmp_path):
    from palimpsest.plans import pair_queries

    texts = ["A line of thirty characters ok.", " ".join(f"Sentence number {i} of a long turn." for i in range(40)), "x" * 700, "short", None]
    rows = [(1, k, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.key: r.target for r in pair_queries.made_pairs(spark, str(tmp_path)).collect()}
    whole = lambda k: [got[x] for x in sorted((x for x in got if x.startswith(f"1-{k}-")), key=lambda x: int(x.split("-")[2]))]
    assert whole(0) == [texts[0]] and " ".join(whole(1)) == texts[1] and "".join(whole(2)) == texts[2] and not whole(3) and not whole(4)
    assert all(20 <= len(t) <= 340 for t in got.values())


def test_mean_edits_of_all_pairs(spark):
    made = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") < 2000, "same").otherwise("sane").alias("input"), F.lit("same").alias("target"), F.lit("s").alias("source"))
    assert pairs.stats(made, "key").first().avg_edits == 0.3
    assert pairs.stats(made, "key", edits_of_first=2000).first().avg_edits == 0.0


def test_other_sources(spark, tmp_path):
    urls = spark.createDataFrame([("good",), ("bad",)], "url string")
    got = {r.url: (r.text, r.error) for r in readers.fetched_texts(urls, lambda u: {"good": "<p>text</p>"}[u]).collect()}
    assert got == {"good": ("<p>text</p>", None), "bad": (None, "'bad'")}
    pages = spark.createDataFrame([(1, "<p>தமிழ் மொழி மிகவும் பழமையான மொழி ஆகும்.</p> <b>இது இரண்டாவது வாக்கியம் ஆகும்.</b> short."), (2, None)], "id int, html string")
    assert [(r.id, r.sentence_no) for r in readers.page_sentences(pages, "id", "html").collect()] == [(1, 0), (1, 1)]
    assert readers.page_sentences(pages, "id", "html", most=1).count() == 1
    assert readers.first_that_works(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: pages.limit(0), lambda: pages).count() == 2
    with pytest.raises(ValueError):
        readers.first_that_works(lambda: pages.limit(0))
    made = []
    make = lambda: made.append(1) or pages
    assert [readers.once(spark, str(tmp_path / "kept"), make).count() for _ in range(2)] == [2, 2] and len(made) == 1
    members = spark.createDataFrame([("root", "A", "page"), ("root", "sub", "subcat"), ("sub", "A", "page"), ("sub", "B", "page"), ("sub", "deep", "subcat"), ("deep", "C", "page"), ("other", "D", "page")], "category string, title string, kind string")
    assert sorted(r.title for r in readers.crawl_titles(members, ["root"]).collect()) == ["A", "B"]


def test_reports_and_reference_pages(spark, tmp_path):
    compared = spark.createDataFrame([("d", 1, 0.9, 3, 10, 0.8, 3, 10), ("d", 2, 0.5, 3, 10, 0.8, 3, 10), ("e", 1, None, 3, 10, 0.8, 3, 10)], "doc string, page int, a_confidence double, a_n_lines int, a_chars int, b_confidence double, b_n_lines int, b_chars int")
    writers.comparison(compared, str(tmp_path / "report"))
    assert readers.stored_winner(spark, str(tmp_path / "report"), "one", "two") == "two" and readers.stored_winner(spark, str(tmp_path / "no"), "one", "two") == "one"
    writers.stats(compared.agg(F.count("*").alias("n")), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first().n == 3
    for doc, n, text in (("s", 2, " two \n"), ("s", 1, "one"), ("t", 1, "other")):
        (tmp_path / "truth" / doc).mkdir(parents=True, exist_ok=True)
        (tmp_path / "truth" / doc / f"page_{n:03}.txt").write_text(text)
    truth = readers.reference_pages(spark, str(tmp_path / "truth"))
    assert {r.doc: r.text for r in truth.collect()} == {"s": "one two", "t": "other"}
    head = "Tamil OCR Output — s\nPages processed: 1\n" + "=" * 60 + "\n\n" + "=" * 60 + "\nPAGE 1\n" + "=" * 60 + "\none\ntwo"
    row = runs.evaluate(spark.createDataFrame([("s", head)], "doc string, text string"), truth).first()
    assert (row.cer, row.wer, row.reference_chars, row.predicted_chars) == (0.0, 0.0, 7, 7)
    pages = spark.createDataFrame([("/x/my: file.pdf", 3, b"1")], "path string, page int, content binary")
    folder = str(tmp_path)

    def put(name, content):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)

    assert [r.name for r in writers.page_images(pages, put).collect()] == ["my_ file_page_0003.png"] and (tmp_path / "my_ file_page_0003.png").read_bytes() == b"1"


def test_round_trip_of_rendered_texts(spark):
    import pandas as pd

    def load():
        return lambda page: pd.DataFrame([{"doc": page.doc.iloc[0], "page": 1, "line_no": 0, "text": bytes(page.content.iloc[0]).decode().replace("a", "oo"), "box": None, "confidence": 0.9}])

    recognition.register("swap", load)
    texts = spark.createDataFrame([("1", "banana"), ("2", "cherry"), ("3", "papaya"), ("4", "avocado")], "key string, text string")
    made = recognition.round_trip(texts, str.encode, lambda image, seed: image, "swap", 2, done=texts.where("key = '3'"))
    assert {(r.key, r.input, r.target, r.source) for r in made.collect()} == {("1", "boonoonoo", "banana", "roundtrip_swap"), ("4", "oovocoodo", "avocado", "roundtrip_swap")}
    with pytest.raises(ValueError):
        recognition.round_trip(texts, str.encode, lambda image, seed: image, "swap", 4)


def test_samples(spark):
    df = spark.range(7).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError):
        sampling.take(df, 8, 1, "k", strict=True)
    drawn = sampling.with_replacement(df, 50, 1, "k").collect()
    assert len(drawn) == 50 and len({r.copy for r in drawn}) == 50 and len({r.k for r in drawn}) <= 7
    assert sampling.with_replacement(df.limit(0), 5, 1, "k").count() == 0
    assert sampling.remaining(df, df.limit(3), "k").count() == 4
    texts = spark.createDataFrame([("1", "தமிழ் மொழி மிகவும் பழமையான மொழி ஆகும்"), ("2", "no script"), ("3", " "), ("4", None)], "key string, text string")
    pairs_ = noise.changed_pairs(texts, 5, 0.5).collect()
    assert 1 < len(pairs_) <= 5 and all(r.input != r.target and r.key.startswith("1#") for r in pairs_)


def test_page_rates_and_extents(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    blocks = spark.createDataFrame([("d", 1, (1.0, 5.0, 9.0, 9.0)), ("d", 1, (3.0, 2.0, 4.0, 20.0))], f"doc string, page int, box {box}")
    assert tuple(layout.region_extents(blocks).first()) == ("d", 1, 1.0, 2.0, 9.0, 20.0)
    rates = layout.quality_rates(spark.createDataFrame([("தமிழ்",), ("",), ("हि",), (None,)], "text string")).first()
    assert (rates.blank_rate, rates.stray_rate, rates.script_ratio) == (0.5, 0.25, 0.25)
    found = spark.createDataFrame([("d", 1, True), ("d", 1, False), ("d", 2, False)], "doc string, page int, is_corrected boolean")
    assert {(r.page, r.lm_corrected) for r in recognition.corrected_pages(found).collect()} == {(1, True), (2, False)}
    compared = metrics.compare_engines(*[spark.createDataFrame(rows, "doc string, page int, confidence double, n_lines int, text string") for rows in ([("d", 1, 0.5, 1, "x"), ("d", 2, 0.5, 1, "x")], [("d", 2, 0.5, 1, "x"), ("e", 1, 0.5, 1, "x")])])
    assert [(r.doc, r.page) for r in compared.collect()] == [("d", 2)]


def test_images():
    import zlib

    import numpy as np

    from palimpsest.operators import images

    page = np.full((60, 80), 255, np.uint8)
    page[10:50:10, 10:70] = 0
    assert images.dark_ratio(page) == pytest.approx(4 * 60 / 4800) and images.dark_ratio(np.empty((0, 0), np.uint8)) == 0
    assert (images.degraded(page, [], 0.0, 1) == page).all()
    thick, thin = images.degraded(page, ["erosion"], 0.0, 1), images.degraded(page, ["dilation"], 0.0, 1)
    assert (thick == 0).sum() > (page == 0).sum() > (thin == 0).sum()
    for kind in ("blur", "noise", "contrast"):
        out = images.degraded(page, [kind], 1.5, 7)
        assert out.shape == page.shape and out.dtype == np.uint8 and (out != page).any() and (out == images.degraded(page, [kind], 1.5, 7)).all()
    assert images.degraded(page, ["contrast"], 0.0, 1).min() >= 30
    sheet = np.full((300, 400), 255, np.uint8)
    sheet[40:260:20, 40:360] = 0
    leaning = images.rotated(sheet, 2.0)
    assert abs(abs(images.skew(leaning)) - 2.0) < 0.5 and images.skew(page) == 0.0 and images.skew(np.full((9, 9), 255, np.uint8)) == 0.0
    assert abs(images.skew(images.rotated(leaning, images.skew(leaning)))) < 0.5
    done = images.preprocessed(np.stack([page] * 3, axis=-1))
    assert set(np.unique(done)) <= {0, 255} and (done == 0).sum() > 0
    data = images.png(page)
    at = data.index(b"IDAT")
    assert data.startswith(b"\x89PNG") and zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")]) == b"".join(b"\0" + r.tobytes() for r in page)


def test_pages_corrected_line_by_line(spark):
    pages = spark.createDataFrame([("abc\nxy\nfail it",), (None,), ("",)], "text string")

    def model(line):
        if line.startswith("fail"):
            raise RuntimeError
        return line.upper()

    assert [r.text for r in recognition.correct_pages(pages, model).collect()] == ["ABC\nxy\nfail it", None, ""]
    assert (layout.same_block(1), layout.same_block(2)) == (0.70, 0.60)


def test_crop_stays_inside(spark):
    box = spark.createDataFrame([((2.0, 3.0, 96.5, 40.0),)], "box struct<x0:double,y0:double,x1:double,y1:double>")
    assert tuple(box.select(layout.crop(F.col("box"), F.lit(100), F.lit(200)).alias("c")).first().c) == (0, 0, 100, 44)
    assert one(spark, layout.wants_preprocessing, "historical_scan") is True and one(spark, layout.wants_preprocessing, None) is False


def test_appended_values_keep_their_place(spark):
    known = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "at int, line string")
    new = spark.createDataFrame([(0, "b"), (1, "c"), (2, "c")], "at int, line string")
    assert [(r.rank, r["at"], r.line) for r in corpus.append_distinct(known, new, "line", "at").orderBy("rank", "at").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c")]
    pages = spark.createDataFrame([(1, "x" * 60 + "\n" + "y" * 60), (2, "z" * 120)], "id int, text string")
    assert [r.line[0] for r in corpus.crawl_lines(pages, "id", "text", LATIN, most=2).orderBy("id", "line_no").collect()] == ["x", "y"]


def test_rows_of_a_page_meet_once(spark):
    """Suppression, reading order and accessors join nothing, reconstruction joins lines and blocks once; suppression needs no Python."""
    box = "named_struct('x0', 0D, 'y0', 0D, 'x1', 9D, 'y1', 9D)"
    blocks = spark.sql(f"SELECT 'd' doc, 1L page, 0 block, 'Text' label, {box} box, 0.5D confidence, 10 width, 10 height, 'a' text, false fallback")
    said = spark.sql(f"SELECT 'd' doc, 1L page, 0 line_no, 'a' text, {box} box, 0.5D confidence")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    suppressed, ordered, told, whole = map(plan, (layout.suppress_duplicates(blocks), layout.reading_order(blocks), layout.page_accessors(blocks), layout.reconstruct(said, blocks)))
    assert [p.count("Join ") for p in (suppressed, ordered, told, whole)] == [0, 0, 0, 1]
    assert [p.count("EvalPython") for p in (suppressed, ordered, told, whole)] == [0, 1, 1, 1]


def test_suppression_takes_equal_confidences_by_number(spark):
    box = lambda x: {"x0": float(x), "y0": 0.0, "x1": x + 10.0, "y1": 10.0}
    rows = [("d", 1, 3, 0.5, box(0)), ("d", 1, 1, 0.5, box(1)), ("d", 1, 2, 0.9, box(30)), ("d", 1, 0, 0.1, box(31)), ("d", 1, 4, 0.2, box(5)), ("d", 2, 0, 0.1, box(0))]
    got = layout.suppress_duplicates(spark.createDataFrame(rows, f"doc string, page long, block int, confidence double, box {layout.BOX}"))
    assert {(r.page, r.block) for r in got.collect()} == {(1, 1), (1, 2), (1, 4), (2, 0)}
    assert got.columns == ["doc", "page", "block", "confidence", "box"]


def test_edits_are_those_of_levenshtein(spark):
    """Against Spark's own function, by which pairs were compared one by one before: ends of 64-bit words, empty, null and long texts."""
    rng = random.Random(17)
    draw = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    rows = [(draw(rng.choice([0, 1, 63, 64, 65, 128, 129, 300]), "abé😀 க"), draw(rng.choice([0, 2, 64, 127, 400]), "abcé😀")) for _ in range(120)]
    rows += [(a, a[:7] + "x" + a[9:]) for a, _ in rows] + [(None, "a"), ("a", None), (None, None), ("", ""), ("ab" * 1500, "ba" * 10)]
    df = spark.createDataFrame(rows, "a string, b string")
    edits = udfs.edits(F.col("a"), F.col("b"))
    assert df.where(~edits.eqNullSafe(F.levenshtein("a", "b"))).count() == 0
    assert "ArrowEvalPython" in df.select(edits)._jdf.queryExecution().executedPlan().toString()


def test_short_lines_are_told_by_their_first_letters(spark):
    """Whether a line has 15 letters is the same as by counting them all, and the cleaners make no line anew to tell."""
    lines = [None, "", "a" * 14, "a" * 15, " 1.".join("abcdefghijklmn"), " é\n".join("abcdefg") + "ÿ", "😀".join("abcdefghijklmno"), "é" * 15, "1" * 5000, "x" + "- " * 3000 + "y" * 14, "அ" * 20]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, line string")
    for profile in (LATIN, TAMIL):
        got = df.select(T.has_letters(F.col("line"), 15, profile).alias("some"), (T.count_script(F.col("line"), profile) >= 15).alias("all")).collect()
        assert [r.some for r in got] == [r["all"] for r in got] and {True, False, None} == {r.some for r in got}
        for clean in (corpus.clean_print, corpus.clean_web, corpus.clean_verse):
            plan = clean(df, profile)._jdf.queryExecution().optimizedPlan().toString()
            assert f"[^{profile.letters}], " not in plan
