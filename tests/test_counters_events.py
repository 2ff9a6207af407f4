"""Counters of a pass, table functions, ranks, appends by parts, error rates of words, events of documents, models in processes."""

import os
import random
import signal
import sys
import time
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from palimpsest import __main__ as cli
from palimpsest.functions import tables, udfs
from palimpsest.functions import text as T
from palimpsest.functions.scripts import LATIN
from palimpsest.operators import corpus, processes, recognition, sampling
from palimpsest.streaming import documents, streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


@pytest.mark.parametrize("kind", ["web", "verse", "print"])
def test_counters_of_the_pass_that_writes(spark, tmp_path, kind):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", T.strip(F.col("line")).alias("line")).where("line <> ''")
    extra = spark.createDataFrame([(1, 0, "<b>x</b> &nbsp;12 a stanza of some length  13 the second stanza of it"), (1, 1, "12"), (1, 2, "[abc] - an item of a list that is long enough*"), (1, 3, "Chapter"), (1, 4, " ")], "doc_id long, line_no int, line string")
    cleaned = {"web": corpus.clean_web, "verse": corpus.clean_verse, "print": corpus.clean_print}[kind](lines.unionByName(extra), LATIN)
    watched, seen = corpus.observed(cleaned, kind)
    kept = watched.where("reason is null")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    kept.select("line").write.text(str(tmp_path / "out"))
    counted = corpus.counters(seen)
    assert counted == {r.counter: r.lines for r in corpus.clean_report(cleaned).collect()} and counted["output"] == spark.read.text(str(tmp_path / "out")).count()
    rate = corpus.drop_rates(cleaned).first()
    assert corpus.rates(counted) == {c: rate[c] for c in ("input", "output", "dropped", "dropped_pct")}


def test_command_line_counts_once(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("A line of printed text, long enough to stay\n12\n")
    cli.main(["--script", "latin", "clean", "--source", "print", str(tmp_path / "in.txt"), "--report"])
    said = dict(line.split() for line in capsys.readouterr().out.splitlines() if line)
    assert said == {"drop:page_number": "1", "input": "2", "output": "1", "dropped": "1", "dropped_pct": "50.0"}


def test_table_functions(spark):
    tables.register(spark)
    texts = ["One. Two!  Three\n\nfour", "", None, "a" * 5001, "x\n" * 4000, "  . ? ", "no end  "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    df.createOrReplaceTempView("some_texts")
    for name, native in (("chunk_text", udfs.chunk_text("text")), ("split_sentences", T.split_sentences(F.col("text")))):
        got = spark.sql(f"SELECT k, t.* FROM some_texts, LATERAL {name}(text) t").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, df.select("k", F.posexplode(native)).collect())) and got


def test_ranks_of_any_size(spark):
    df = spark.range(30_000).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([("5",)], "k string"))
    rows = sampling.ranked(df, 7, "k").collect()
    want = sorted((r.k for r in df.collect()), key=lambda k: (__import__("hashlib").md5(f"7|{k}".encode()).hexdigest(), k))
    assert [r.k for r in sorted(rows, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in rows) == list(range(1, 30_002))
    assert {r.k for r in sampling.take(df, 12_000, 7, "k").collect()} == set(want[:12_000])  # by ranks
    plan = sampling.take(df, 12_000, 7, "k")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and plan.count("SinglePartition") == 1  # that of the 4096 groups
    assert sampling.take(df, 10, 7, "k").columns == sampling.take(df, 12_000, 7, "k").columns == ["k", "shuffle_key"]
    assert sampling.ranked(df.limit(0), 7, "k").count() == 0


def test_first_rows(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a"), F.lit("x").alias("place"))
    for n in (0, 1, 1234, 4999, 5000, 9000):
        few = sampling.first_rows(df, n, "a").collect()
        monkeypatch.setattr(sampling, "TOP", -1)
        many = sampling.first_rows(df, n, "a")
        assert sorted(r.a for r in many.collect()) == sorted(r.a for r in few) == list(range(min(n, 5000))) and many.columns == df.columns
        monkeypatch.undo()
    monkeypatch.setattr(sampling, "TOP", -1)
    assert sampling.first_rows(df.limit(0), 5, "a").count() == 0


def test_appends_read_touched_parts_only(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run(rows):
        spark.createDataFrame([(t,) for t in rows], "text string").write.mode("append").parquet(source)
        streams.append_once(streams.new_files(spark, source, "text string"), "text", out, mark, lambda df: df, parts=16).awaitTermination()

    run([f"t{k}" for k in range(200)])
    run(["t1", "new"])
    run([])
    run(["t1", "new", "newer"])
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == sorted([*(f"t{k}" for k in range(200)), "new", "newer"])
    earlier = streams.earlier_keys(spark, out, "text", 99, [3, 5])
    assert {r.part for r in earlier.collect()} <= {3, 5}
    plan = earlier._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan[plan.index("PartitionFilters") :] and "ReadSchema: struct<text:string>" in plan
    assert streams.earlier_keys(spark, str(tmp_path / "none"), "text", 1, [1]) is None and streams.earlier_keys(spark, out, "text", 0, [1]) is None


def test_word_edits(spark):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
        return row[-1]

    rng = random.Random(2)
    words = ["a", "bb", "é", "ab", "த", "🙂", "A", "x" * 50]
    some = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " ", "　"]) for _ in range(rng.randint(0, 25)))
    rows = [(some(), some()) for _ in range(200)] + [("", ""), ("", "a b"), ("  ", "a"), (None, "a"), ("a", None)]
    rows += [(" ".join(f"w{k}" for k in range(700)), " ".join(f"w{k + (k > 300)}" for k in range(700)))]
    got = spark.createDataFrame(rows, "a string, b string").repartition(3).select("a", "b", T.word_edits(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == (None if r.a is None or r.b is None else distance(r.a.split(), r.b.split())) for r in got) and len(got) == len(rows)


def test_words_beyond_the_surrogates(spark):
    n = 56_000  # more words than there are code points before the surrogates
    both = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: k.cast("string")), " ").alias("a"))
    row = both.select(F.transform(F.array(T.words(F.col("a"))), lambda w: F.struct(F.size(w).alias("n"), w[n].alias("last")))[0].alias("r")).first().r
    assert (row.n, row.last) == (n + 1, str(n))
    code = lambda k: chr(k + 0x20 + (0x800 if k + 0x20 >= 0xD800 else 0))
    assert [code(k) for k in (1, 0xD800 - 0x21, 0xD800 - 0x20, T.CODES - 0x21)] == ["!", "퟿", "", "\U0010ffff"]


def test_documents_end_in_a_stream(spark, tmp_path):
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
        schema = "doc string, page int, n_pages int, ts timestamp"
        at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)

        def run(rows):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            pages = streams.new_files(spark, source, schema)
            documents.document_events(pages).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
            return sorted((r.doc, r.type, r.pages, r.total) for r in spark.read.schema(documents.EVENTS).parquet(out).collect())

        first = run([("whole", 1, 2, at(0)), ("missing", 1, 3, at(0)), ("late", 1, 2, at(0)), ("missing", 1, 3, at(1))])
        assert first == [("late", "progress", 1, 2), ("missing", "progress", 1, 3), ("whole", "progress", 1, 2)]
        second = run([("whole", 2, 2, at(5)), ("late", 2, 2, at(9))])  # late, but in time
        assert set(second) - set(first) == {("late", "done", 2, 2), ("whole", "done", 2, 2)}
        run([("other", 1, 1, at(60))])  # time goes on: the watermark passes the timer of what is missing
        last = run([("missing", 2, 3, at(2)), ("whole", 2, 2, at(3)), ("other", 1, 1, at(61))])  # too late, and again
        assert set(last) - set(second) == {("other", "done", 1, 1), ("missing", "error", 1, 3)} and len(last) == len(set(last)) == 7
        events = spark.read.schema(documents.EVENTS).parquet(out)
        parsed = streams.parse_events(documents.as_progress(events)).collect()
        assert sorted(r.type for r in parsed) == sorted(r[1] for r in last) and "only 1 of 3 pages came in time" in {r.message for r in parsed}
    finally:
        spark.conf.set(conf, before)


SERVER = '''
import json, os, sys
print(json.dumps({"status": sys.argv[1] if len(sys.argv) > 1 else "ready"}), flush=True)
for line in sys.stdin:
    asked = json.loads(line)
    if asked["text"] == "die":
        os._exit(1)
    if asked["text"] == "die once" and not os.path.exists(sys.argv[2]):
        open(sys.argv[2], "w").close()
        os._exit(1)
    answer = {"error": "no"} if asked["text"] == "fail" else {"corrected": asked["text"].upper() + asked.get("lang_code", "")}
    print(json.dumps(answer), flush=True)
'''


def test_correction_in_a_process(spark, tmp_path):
    script = tmp_path / "server.py"
    script.write_text(SERVER)
    command = [sys.executable, str(script), "ready", str(tmp_path / "mark")]
    server = processes.LineServer(command, 20, lang_code="ta")
    assert server("one") == "ONEta" and server.starts == 1
    os.kill(server.process.pid, signal.SIGKILL)  # in the middle
    assert server("two") == "TWOta" and server.starts == 2
    with pytest.raises(RuntimeError, match="no"):
        server("fail")
    with pytest.raises((EOFError, OSError)):
        server("die")
    assert server("three") == "THREEta" and server.starts == 4
    server.stop()
    with pytest.raises(RuntimeError, match="not ready"):
        processes.LineServer([sys.executable, str(script), "broken"], 20)("x")
    lines = spark.createDataFrame([("d", 1, k, t, 0.1) for k, t in enumerate(["good text", "fail", "die", "die once", "more text", "long sure"])], "doc string, page int, line_no int, text string, confidence double").coalesce(1)
    lines = lines.withColumn("confidence", F.when(F.col("text") == "long sure", 0.99).otherwise(F.col("confidence")))
    got = recognition.correct(lines, processes.process_model(command, 20)).orderBy("line_no").collect()
    assert [r.text for r in got] == ["GOOD TEXT", "fail", "die", "DIE ONCE", "MORE TEXT", "long sure"] and got[5].is_corrected is False  # a line that fails stays


def test_silent_process(tmp_path):
    began = time.time()
    with pytest.raises(TimeoutError):
        processes.LineServer([sys.executable, "-c", "import time; time.sleep(60)"], 0.5)("x")
    assert time.time() - began < 20


def test_profiles_keep_models_apart(spark):
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    assert processes.residency(spark) is None  # a local master has no executors to choose from
    made = [ResourceProfileBuilder().require(ExecutorResourceRequests().cores(n).memory("1g")).require(TaskResourceRequests().cpus(n)).build for n in (2, 3)]
    recognition.register("profiled", lambda: lambda page: page)
    found = recognition.recognise(spark.createDataFrame([("d", 1)], "doc string, page int"), "profiled", made[0])
    fixed = recognition.correct(found, str.upper, profile=made[1])

    def profiles(node):
        own = [node.profile().get().id()] if node.nodeName() in ("MapInPandas", "MapInArrow") and node.profile().isDefined() else []
        children = node.children()
        return own + [p for k in range(children.size()) for p in profiles(children.apply(k))]

    held = profiles(fixed._jdf.queryExecution().analyzed())
    assert len(set(held)) == 2  # the engine's stage and the corrector's


