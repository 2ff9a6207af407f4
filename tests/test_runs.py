"""Whole runs, from pages to documents and from lines to packed pairs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest import __main__ as cli
from palimpsest.functions.scripts import LATIN
from palimpsest.operators import recognition
from palimpsest.plans import runs
from palimpsest.plans.pair_queries import LATIN_CONFUSIONS

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


@pytest.fixture(scope="module")
def recognised(spark):
    def load():
        def engine(page):
            n = int(page.page.iloc[0])
            rows = [{"doc": page.doc.iloc[0], "page": n, "line_no": k, "text": f"page {n} says line {k} of the body .", "box": {"x0": 0.0, "y0": 20.0 * k, "x1": 90.0, "y1": 20.0 * k + 10}, "confidence": 0.5 + 0.1 * n} for k in range(3)]
            return pd.DataFrame(rows)

        return engine

    recognition.register("three-lines", load)
    pages = spark.createDataFrame([("d", p) for p in (1, 2, 3, 4)], "doc string, page int")
    blocks = spark.createDataFrame([("d", p, 0, "Text", (0.0, 0.0, 100.0, 70.0), 0.9, 100, 100) for p in (1, 2, 3, 4)], f"doc string, page int, block int, label string, box {BOX}, confidence double, width int, height int")
    return runs.batch_run(pages, "three-lines", blocks, corrector=lambda t: t), recognition.recognise(pages, "three-lines")


def test_batch_run(recognised):
    (results, documents), _ = recognised
    rows = {r.page: r for r in results.collect()}
    assert rows[2].text == "page 2 says line 0 of the body.\npage 2 says line 1 of the body.\npage 2 says line 2 of the body." and rows[2].confidence == 0.7
    text = documents.first().text
    assert "Pages processed: 4" in text and text.count("PAGE ") == 4


def test_reviewed_run(recognised):
    (results, _), lines = recognised
    router = lambda t: json.dumps({"doc_type": "newspaper", "detected_language": "en", "noise_level": 1, "estimated_columns": 1, "routing_reason": ""})
    out = runs.reviewed_run(results, lines, router, lambda p: "{}", lambda chunk: chunk.upper()).first().text
    assert "Detected language: en" in out and "LLM calls made   : 4" in out and "PAGE 3\nPAGE 3 SAYS LINE 0" in out


def test_one_document(spark, recognised):
    (results, _), lines = recognised
    plain = runs.run_document(results)
    assert set(plain) == {"final_markdown", "total_pages", "llm_call_count", "elapsed_ocr", "elapsed_agents", "elapsed_total", "detected_language", "doc_type", "qa_decisions", "routing_reason"}
    assert plain["final_markdown"].startswith("=== PAGE 1 ===\npage 1 says") and (plain["total_pages"], plain["llm_call_count"]) == (4, 0)
    router = lambda t: json.dumps({"doc_type": "newspaper", "detected_language": "hi", "noise_level": 1, "estimated_columns": 1, "routing_reason": "why"})
    full = runs.run_document(results, lines, (router, lambda p: "seen", lambda chunk: chunk + "+"))
    assert full["final_markdown"].endswith("++") and full["routing_reason"] == "why" and [d["page"] for d in full["qa_decisions"]] == [1, 2] and full["elapsed_total"] > 0


def test_web_run(spark, recognised):
    def load():
        def engine(page):
            if page.page.iloc[0] == 2:
                raise RuntimeError("blank")
            return pd.DataFrame([{"doc": page.doc.iloc[0], "page": page.page.iloc[0], "line_no": 0, "text": "<b>some</b> words", "box": {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0}, "confidence": 0.9}])

        return engine

    recognition.register("half", load)
    pages = spark.createDataFrame([("/in/a.pdf", 1, b""), ("/in/a.pdf", 2, b"")], "path string, page int, content binary")
    blocks = spark.createDataFrame([("a.pdf", p, 0, "Text", (0.0, 0.0, 100.0, 70.0), 0.9, 100, 100) for p in (1, 2)], f"doc string, page int, block int, label string, box {BOX}, confidence double, width int, height int")
    references = spark.createDataFrame([("a.pdf", "some words", "user-provided reference text")], "doc string, reference string, origin string")
    row = runs.web_run(pages, "half", blocks, references).first()
    assert "PAGE 1" in row.text and "some words" in row.text and "[OCR ERROR: blank]" in row.text and row.cer == 0.0 and "| **CER** | 0.00% |" in row.report
    assert "N/A" in runs.web_run(pages, "half", blocks).first().report


def test_compared_run(spark, recognised):
    (results, _), _ = recognised
    assert {(r.engine, r.lm_corrected) for r in results.collect()} == {("three-lines", False), ("three-lines", True)}
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int")
    blocks = spark.createDataFrame([("d", p, 0, "Text", (0.0, 0.0, 100.0, 70.0), 0.9, 100, 100) for p in (1, 2)], f"doc string, page int, block int, label string, box {BOX}, confidence double, width int, height int")
    assert runs.compared_run(pages, ("three-lines", "three-lines"), blocks).count() == 2


def test_training_set(spark):
    rows = [(s, i, f"sentence number {i} of the source {s} goes on for a while, it does.") for s in ("m", "c", "p") for i in range(40)]
    df = spark.createDataFrame(rows, "source string, line_no int, line string")
    parts = [df.where(F.col("source") == s) for s in ("m", "c", "p")]
    made = runs.build_training_set(*parts, total=90, letters=LATIN.letters, table=LATIN_CONFUSIONS)
    counts = {r.source: r["count"] for r in made.groupBy("source").count().collect()}
    assert counts == {"modern": 36, "classical": 29, "premodern": 24}
    assert made.where("input = target").count() < 10 and made.where(F.octet_length("input") > 1024).count() == 0
    packed = runs.pack_training_set(made, None, 40)
    assert {r.split: r["count"] for r in packed.groupBy("split").count().collect()} == {"train": 36, "validation": 4}
    with pytest.raises(ValueError):
        runs.pack_training_set(made, None, 0)


def test_clean_all(spark):
    df = spark.createDataFrame([(1, 0, "A line of printed text, long enough to stay*"), (1, 1, "12"), (1, 2, "A line of printed text, long enough to stay*")], "doc_id long, line_no int, line string")
    combined, check = runs.clean_all(df, df, df, LATIN)
    assert combined.count() == 2 and tuple(check.first()) == (0, 0, 0)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("A line of printed text, long enough to stay\n12\n")
    cli.main(["--script", "latin", "clean", "--source", "print", str(tmp_path / "in.txt"), "--report", "--output", str(tmp_path / "out")])
    assert "drop:page_number" in capsys.readouterr().out
    assert spark.read.text(str(tmp_path / "out")).count() == 1


PLUGIN = '''
import pandas as pd

from palimpsest.operators import recognition


def load():
    def engine(page):
        text = bytes(page.content.iloc[0])[8:].decode().replace("o", "0")
        return pd.DataFrame([{"doc": page.doc.iloc[0], "page": page.page.iloc[0], "line_no": 0, "text": text, "box": None, "confidence": 0.9}])

    return engine


for name in ("first", "second"):
    recognition.register(name, load)
recognition.register_renderer("bytes", lambda t: b"\\x89PNG\\r\\n\\x1a\\n" + t.encode(), lambda image, seed: image)
models = (lambda t: "{}", lambda p: "{}", lambda chunk: chunk + "!")
'''


def test_runs_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "plug").mkdir()
    (tmp_path / "plug" / "my_engines.py").write_text(PLUGIN)
    monkeypatch.syspath_prepend(str(tmp_path / "plug"))
    spark.sparkContext.addPyFile(str(tmp_path / "plug" / "my_engines.py"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "story.png").write_bytes(b"\x89PNG\r\n\x1a\nonce upon a time")
    base = ["--script", "latin"]
    plugged = ["--plugin", "my_engines", str(tmp_path / "in")]
    cli.main([*base, "run", "--engine", "first", "--compare-with", "second", "--output", str(tmp_path / "cmp"), *plugged])
    cli.main([*base, "run", "--engine", "best", "--of", "first", "second", "--comparison", str(tmp_path / "cmp"), "--output", str(tmp_path / "out"), *plugged])
    page = spark.read.json(str(tmp_path / "out" / "pages")).first()
    assert (page.doc, page.text, page.lm_corrected) == ("story", "0nce up0n a time", False)
    assert "Pages processed: 1" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "texts")).collect())
    for extra, end in (([], "!!"), (["--plain"], "time")):
        cli.main([*base, "review", "--engine", "first", "--output", str(tmp_path / "rev"), *extra, *plugged])
        assert spark.read.json(str(tmp_path / "rev")).first().final_markdown.endswith(end)
    pairs = [{"input": f"w{i}rd", "target": f"w{i}rd of a good book to look at", "source": "modern"} for i in range(30)]
    (tmp_path / "pairs.json").write_text("\n".join(map(json.dumps, pairs)))
    pack = ["pack", str(tmp_path / "pairs.json"), "--pairs", "20", "--round-trip", "10", "--engine", "first", "--renderer", "bytes", "--plugin", "my_engines", "--output", str(tmp_path / "packed")]
    cli.main(pack)
    packed = spark.read.parquet(str(tmp_path / "packed"))
    assert {r.source: r["count"] for r in packed.groupBy("source").count().collect()} == {"modern": 20, "roundtrip_first": 10} and packed.where("split = 'validation'").count() == 3
    for wrong in (["--pairs", "0"], ["--val-ratio", "1"], ["--pairs", "31"]):
        with pytest.raises(ValueError):
            cli.main([*pack, *wrong])
    (tmp_path / "truth" / "story").mkdir(parents=True)
    (tmp_path / "truth" / "story" / "page_001.txt").write_text("once")
    (tmp_path / "texts.json").write_text(json.dumps({"doc": "story", "text": "onse"}))
    capsys.readouterr()
    cli.main(["evaluate", str(tmp_path / "texts.json"), str(tmp_path / "truth")])
    assert "0.25" in capsys.readouterr().out
