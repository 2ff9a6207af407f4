"""Paged listings as a data source, and models that are called once: batches, stops at a target, stores."""

import json
import os
import sys
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from palimpsest.functions.scripts import LATIN
from palimpsest.operators import recognition
from palimpsest.plans import runs
from palimpsest.sources import listings, readers, stores

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def said(folder) -> list[str]:
    """What the calls of a model left in a folder, a file a call."""
    return [p.read_text() for p in sorted(Path(folder).iterdir())]


def teller(folder):
    """A function that leaves a file a call; the tests' workers share the machine."""
    os.makedirs(folder, exist_ok=True)

    def tell(what) -> None:
        Path(folder, f"{time.time_ns()}-{os.getpid()}-{os.urandom(4).hex()}").write_text(str(what))

    return tell


def wiki(folder, fails=()):
    """A fake interface of three pages a category; each request in ``fails`` fails once, whatever process asks."""
    tell = teller(folder)

    def call(params):
        at = params.get("cmcontinue", "0")
        mark = Path(f"{folder}-failed-{params['cmtitle']}-{at}")
        if (params["cmtitle"], at) in fails and not mark.exists():
            mark.write_text("")
            raise OSError("no answer")
        tell(f"{params['cmtitle']} {at}")
        found = [{"title": f"{params['cmtitle']}/{at}{k}", "type": "subcat" if k == 2 and at == "0" and params["cmtitle"] == "A" else "page"} for k in range(3)]
        return {"query": {"members": found}} | ({} if at == "2" else {"continue": {"cmcontinue": str(int(at) + 1)}})

    return call


ITEMS = {"items": "members", "wait": "0"}


def test_listing_as_a_table(spark, tmp_path):
    listings.register(spark, "fake_wiki", wiki(tmp_path / "calls", {("A", "1"), ("B", "2")}))
    df = listings.listed(spark, "fake_wiki", ["A", "B"], **ITEMS)
    assert df.rdd.getNumPartitions() == 2  # one a root
    rows = df.collect()
    assert sorted((r.root, r.place, json.loads(r.item)["title"]) for r in rows) == sorted((c, 3 * p + k, f"{c}/{p}{k}") for c in "AB" for p in range(3) for k in range(3))
    few = listings.listed(spark, "fake_wiki", ["A"], limit="4", **ITEMS).collect()
    assert len(few) == 4 and sum(s.startswith("A") for s in said(tmp_path / "calls")) == 3 + 2  # the third page is not asked for


def test_listing_that_fails(spark, tmp_path):
    def call(params):
        if params.get("cmcontinue"):
            raise OSError("no answer")
        return {"query": {"members": [{"title": "x"}]}, "continue": {"cmcontinue": "1"}}

    listings.register(spark, "broken_wiki", call)
    with pytest.raises(Exception, match="no answer"):
        listings.listed(spark, "broken_wiki", ["A"], **ITEMS).collect()
    assert listings.listed(spark, "broken_wiki", ["A"], onFailure="end", **ITEMS).count() == 1
    with pytest.raises(Exception, match="different names"):
        listings.listed(spark, "broken_wiki", ["A", "A"], **ITEMS).collect()


def test_stream_goes_on_at_its_token(spark, tmp_path):
    calls, out, mark = (str(tmp_path / n) for n in ("calls", "out", "mark"))
    listings.register(spark, "stream_wiki", wiki(calls, {("A", "1")}))

    def run(batches):
        df = listings.listed(spark, "stream_wiki", ["A", "B"], stream=True, **(ITEMS | {"tries": "1"}))
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(processingTime="0 seconds").start()
        before = query.lastProgress
        until = time.time() + 60
        while time.time() < until and sum(p.numInputRows for p in query.recentProgress) < batches:
            time.sleep(0.2)
        query.stop()
        return before

    run(6)  # stopped after the first pages
    first = len(said(calls))
    assert 2 <= first < 6 + 1
    run(18 - spark.read.parquet(out).count())
    rows = spark.read.parquet(out).collect()
    assert sorted((r.root, r.place) for r in rows) == [(c, k) for c in "AB" for k in range(9)]  # none twice, none lost, with one failure between
    asked = said(calls)
    assert max(asked.count(x) for x in set(asked)) <= 2 and asked.count("A 0") == 1  # the stopped batch at most is asked for again, never the start


def test_crawl(spark, tmp_path):
    listing = wiki(tmp_path / "calls")
    tell = teller(tmp_path / "texts")

    def call(params):
        if "cmtitle" in params:
            return listing(params)
        tell(params["titles"] + " " + params["prop"])
        if params["titles"] == "B/01":
            raise OSError("gone")
        if params["prop"] == "extracts":
            return {"query": {"pages": {"1": {"extract": "a line of the page, long enough\n12\n" * (1 if params["titles"] == "B/02" else 9)}}}}
        return {"query": {"pages": {"1": {"revisions": [{"slots": {"main": {"*": "'''bold''' words of the wiki text [[link|shown]] and more\n" * 4}}}]}}}}

    listings.register(spark, "whole_wiki", call)
    options = dict(items="members", wait="0")
    titles = {r.title for r in listings.crawled(spark, "whole_wiki", ["A", "B"], **options).collect()}
    assert len(titles) == 8 + 9 + 9 and "A/02" not in titles and "A/02/00" in titles  # the subcategory's pages, not itself
    monkey = listings.page_texts(spark.createDataFrame([("B/01",), ("B/02",), ("B/00",)], "title string"), call, LATIN, wait=0)
    got = {r.title: r for r in monkey.collect()}
    assert got["B/01"].error == "gone" and "bold" in got["B/02"].wikitext and got["B/00"].wikitext is None
    seen = spark.createDataFrame([(t,) for t in titles - {"B/00", "B/02", "A/00"}], "title string")
    lines = runs.crawl(spark, "whole_wiki", call, ["A", "B"], seen, profile=LATIN, **options).collect()
    assert {r.line for r in lines} == {"a line of the page, long enough", "bold words of the wiki text shown and more"}


def echo(folder, size=1, bad=()):
    def load():
        tell = teller(folder)

        def engine(pages):
            tell(len(pages))
            if set(pages["page"]) & set(bad):
                raise RuntimeError("blank")
            keep = pages[pages["page"] != 77]
            return pd.DataFrame([{"doc": d, "page": n, "line_no": k, "text": f"page {n} says {k}", "box": {"x0": 0.0, "y0": 20.0 * k, "x1": 90.0, "y1": 20.0 * k + 9}, "confidence": 0.6 + n % 3 / 10} for d, n in zip(keep["doc"], keep["page"], strict=True) for k in range(2)], columns=["doc", "page", "line_no", "text", "box", "confidence"])

        return engine

    return load


def test_batches_are_halved_until_the_bad_page_fails_alone(spark, tmp_path):
    recognition.register("sixteen", echo(tmp_path / "calls", bad=(42,)), pages_per_call=16)
    pages = spark.createDataFrame([("d", p) for p in range(100)], "doc string, page int").coalesce(1)
    rows = recognition.recognise(pages, "sixteen").collect()
    calls = list(map(int, said(tmp_path / "calls")))
    assert len(rows) == 98 * 2 + 1 and [(r.page, r.text) for r in rows if r.error] == [(42, None)]  # page 77 says nothing
    assert sorted(calls, reverse=True)[:6] == [16] * 6 and len(calls) == 7 + 8  # six whole batches and a rest, eight more calls to find one page of 16
    with pytest.raises(ValueError, match="one page"):
        recognition.register("none", echo(tmp_path), pages_per_call=0)


def test_rounds_trips_stop_at_the_target(spark, tmp_path):
    def load():
        tell = teller(tmp_path / "calls")

        def engine(pages):
            for d in pages["doc"]:
                tell(d)
            return pd.DataFrame([{"doc": d, "page": 1, "line_no": 0, "text": bytes(c).decode().replace("a", "" if int(d) % 2 else "a"), "box": None, "confidence": 0.9} for d, c in zip(pages["doc"], pages["content"], strict=True)])

        return engine

    recognition.register("odd", load, pages_per_call=4)
    texts = spark.createDataFrame([(str(k), f"banana {k}" if k % 50 else "  ") for k in range(400)], "key string, text string")
    store = str(tmp_path / "store")

    def draw(n, **more):
        return recognition.round_trip(texts, str.encode, lambda image, seed: image, "odd", n, store=store, step=10, **more)

    got = draw(20).collect()
    once = said(tmp_path / "calls")
    assert len({r.key for r in got}) == 20 and all(int(r.key) % 2 and r.input == r.target.replace("a", "") for r in got)
    assert len(once) == len(set(once)) <= 20 * 2 + 10 + 10  # half of the texts give a pair: about 40, a step more at most
    assert draw(20).count() == 20 and len(said(tmp_path / "calls")) == len(once)  # the store has them
    last = max((tmp_path / "store" / "steps").iterdir())
    (last / "_SUCCESS").unlink()  # killed while it wrote its last step
    more = {r.key for r in draw(60).collect()}
    calls = said(tmp_path / "calls")
    assert len(more) == 60 and {r.key for r in got} <= more and max(calls.count(k) for k in set(calls)) == 2
    again = {k for k in calls if calls.count(k) == 2}
    assert len(again) <= 20 and again <= set(once[-20:])  # those of the step that was lost, no others
    with pytest.raises(ValueError, match="of 500 pairs"):
        draw(500)
    with pytest.raises(ValueError, match="after 30 attempts"):
        recognition.round_trip(texts, str.encode, lambda image, seed: image, "odd", 29, step=10, attempts=30)


@pytest.fixture
def shown(spark):
    pages = [("/in/d.png", p, b"") for p in (1, 2, 3, 77)]
    blocks = [("d.png", p, 0, "Text", (0.0, 0.0, 100.0, 70.0), 0.9, 100, 100) for p in (1, 2, 3, 77)]
    return spark.createDataFrame(pages, "path string, page int, content binary"), spark.createDataFrame(blocks, f"doc string, page int, block int, label string, box {BOX}, confidence double, width int, height int")


def test_runs_recognise_once(spark, tmp_path, shown):
    recognition.register("once", echo(tmp_path / "calls", bad=(3,)))
    recognition.register("other", echo(tmp_path / "others"))
    pages, blocks = shown
    named = pages.select(F.lit("d.png").alias("doc"), "page", "content")
    corrections = teller(tmp_path / "corrections")

    def corrector(line):
        corrections(line)
        return line + "!"

    store = str(tmp_path / "store")
    results, documents = runs.batch_run(named, "once", blocks, corrector, LATIN, store=store)
    assert sorted(r.page for r in results.collect()) == [1, 2] and documents.count() == 1 and results.count() == 2
    assert len(said(tmp_path / "calls")) == 4 and len(said(tmp_path / "corrections")) == 4  # once a page; once a line of low confidence
    again, _ = runs.batch_run(named, "once", blocks, corrector, LATIN, store=store)
    assert again.count() == 2 and len(said(tmp_path / "calls")) == 4 and len(said(tmp_path / "corrections")) == 4  # the second run calls nothing
    assert runs.compared_run(named, ("once", "other"), blocks, LATIN, store).count() == 2
    assert len(said(tmp_path / "calls")) == 4 and len(said(tmp_path / "others")) == 4
    row = runs.web_run(pages, "other", blocks, profile=LATIN, store=str(tmp_path / "web")).first()
    assert "page 3 says 1" in row.text and "Pages processed  : 4" in row.text and len(said(tmp_path / "others")) == 8
    new = named.unionByName(named.limit(1).withColumn("page", F.lit(9)))
    assert runs.read_once(new, "once", store).where("page = 9").count() == 2 and len(said(tmp_path / "calls")) == 5  # the new page alone


def test_reviewing_models_are_called_once(spark, tmp_path, shown):
    recognition.register("plain", echo(tmp_path / "calls"))
    pages, blocks = shown
    named = pages.where("page < 4").select(F.concat(F.lit("d"), F.col("page").cast("string")).alias("doc"), "page", "content")
    store = str(tmp_path / "store")
    results, _ = runs.batch_run(named, "plain", blocks.where("page < 4").withColumn("doc", F.concat(F.lit("d"), F.col("page").cast("string"))), profile=LATIN, store=store)
    lines = runs.read_once(named, "plain", store)
    router, reviewer, finisher = (teller(tmp_path / n) for n in ("router", "reviewer", "finisher"))
    out = runs.reviewed_run(results, lines, lambda t: router(t) or "{}", lambda p: reviewer(p) or "{}", lambda c: finisher(c) or c)
    rows = out.collect()
    assert len(rows) == 3 and out.count() == 3
    assert (len(said(tmp_path / "calls")), len(said(tmp_path / "router")), len(said(tmp_path / "finisher"))) == (3, 3, 6)
    assert len(said(tmp_path / "reviewer")) == sum(len(r.qa_decisions) for r in rows) == 2  # pages of a mean confidence below 0.80


def test_documents_of_too_many_pages_are_opened_once(spark, tmp_path):
    tell = teller(tmp_path / "opened")

    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                tell(path)
                yield pd.DataFrame([{"path": path, "page": k, "content": b""} for k in range(1, 4)])

    pages = spark.createDataFrame([("a",), ("b",)], "path string").mapInPandas(run, readers.PAGES)
    assert readers.at_most(pages, 3).count() == 6 and len(said(tmp_path / "opened")) == 2
    with pytest.raises(Exception, match="has 3 pages"):
        readers.at_most(pages, 2).count()


def test_stores_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert stores.keyed(path, rows, ["k"], lambda df: df).count() == 2 and stores.numbered(spark, path) == [0]
    assert stores.keyed(path, rows, ["k"], lambda df: df).count() == 2 and stores.numbered(spark, path) == [0]  # nothing new leaves nothing
    assert stores.keyed(path, rows.unionByName(rows.selectExpr("k + 2 as k", "v")), ["k"], lambda df: df).count() == 4
    (tmp_path / "t" / "step=1" / "_SUCCESS").unlink()
    assert stores.numbered(spark, path) == [0] and stores.read_steps(spark, path, [0]).count() == 2
    assert stores.once(f"{path}/x", lambda: rows, spark).count() == stores.once(f"{path}/x", lambda: rows.limit(0), spark).count() == 2


def test_pages_are_prepared_by_route(spark, tmp_path):
    pages = spark.createDataFrame([("scan", 1, b"a"), ("scan", 2, b"bad"), ("print", 1, b"c"), ("unknown", 1, b"d")], "doc string, page int, content binary")
    routes = spark.createDataFrame([("scan", "historical_scan"), ("print", "modern_print")], "doc string, doc_type string")
    tell = teller(tmp_path / "chain")

    def chain(content):
        tell(bytes(content).decode())
        if bytes(content) == b"bad":
            raise ValueError("no image")
        return bytes(content).upper()

    got = {(r.doc, r.page): bytes(r.content) for r in recognition.prepared(pages, routes, chain).collect()}
    assert got == {("scan", 1): b"A", ("scan", 2): b"bad", ("print", 1): b"c", ("unknown", 1): b"d"} and sorted(said(tmp_path / "chain")) == ["a", "bad"]

    def load():
        return lambda page: pd.DataFrame([{"doc": page.doc.iloc[0], "page": page.page.iloc[0], "line_no": 0, "text": bytes(page.content.iloc[0]).decode() * 9, "box": {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0}, "confidence": 0.99}])

    recognition.register("content", load)
    blocks = spark.createDataFrame([(d, p, 0, "Text", (0.0, 0.0, 100.0, 70.0), 0.9, 100, 100) for d, p in got], f"doc string, page int, block int, label string, box {BOX}, confidence double, width int, height int")
    results, _ = runs.batch_run(pages, "content", blocks, profile=LATIN, routes=routes, preprocess=chain)
    assert {r.doc: r.text for r in results.where("page = 1").collect()} == {"scan": "A" * 9, "print": "c" * 9, "unknown": "d" * 9}


def test_blocks_are_cut_and_read(spark, tmp_path):
    tell = teller(tmp_path / "calls")

    def load():
        def engine(pages):
            tell(len(pages))
            return pd.DataFrame([{"doc": d, "page": p, "line_no": 0, "text": bytes(c).decode(), "box": {"x0": 1.0, "y0": 2.0, "x1": 30.0, "y1": 12.0}, "confidence": 0.99} for d, p, c in zip(pages["doc"], pages["page"], pages["content"], strict=True)])

        return engine

    recognition.register("crops", load, pages_per_call=8)
    pages = spark.createDataFrame([("d", 1, b"whole"), ("d", 2, b"alone"), ("d", 3, b"picture")], "doc string, page int, content binary").coalesce(1)
    rows = [("d", 1, 0, "Text", (10.0, 20.0, 100.0, 60.0), 0.9, 200, 200), ("d", 1, 1, "SectionHeader", (10.0, 70.0, 198.0, 90.0), 0.9, 200, 200), ("d", 1, 2, "Picture", (0.0, 100.0, 9.0, 110.0), 0.9, 200, 200), ("d", 3, 0, "Picture", (0.0, 0.0, 9.0, 9.0), 0.9, 200, 200)]
    blocks = spark.createDataFrame(rows, f"doc string, page int, block int, label string, box {BOX}, confidence double, width int, height int")
    cut = lambda content, part: f"{bytes(content).decode()}{part}".encode()
    got = {(r.page, r.line_no): (r.text, r.box) for r in recognition.read_blocks(pages, blocks, cut, "crops").collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 0): "whole(6, 16, 104, 64)", (1, 1_000_000): "whole(6, 66, 200, 94)", (2, 0): "alone"}
    assert tuple(got[1, 0][1]) == (7.0, 18.0, 36.0, 28.0) and tuple(got[2, 0][1]) == (1.0, 2.0, 30.0, 12.0) and said(tmp_path / "calls") == ["3"]
    store = str(tmp_path / "store")
    for _ in range(2):
        results, _ = runs.batch_run(pages.where("page = 1"), "crops", blocks.where("page = 1"), profile=LATIN, store=store, cut=cut)
        assert [x for x in results.first().text.split("\n") if x] == ["whole(6, 16, 104, 64)", "whole(6, 66, 200, 94)"]
    assert len(said(tmp_path / "calls")) == 2  # the second run calls nothing


def test_all_sources_are_acquired_once(spark, tmp_path):
    made = []

    def source(name, rows):
        def make():
            made.append(name)
            if rows is None:
                raise OSError("no network\nat all")
            return spark.range(rows)

        return make

    sources = {"a": source("a", 3), "broken": source("broken", None), "b": source("b", 5)}
    for _ in range(2):
        got = {r.source: (r.rows, r.error) for r in runs.acquire_all(spark, sources, str(tmp_path)).collect()}
        assert got == {"a": (3, None), "broken": (None, "no network"), "b": (5, None)}
    assert made == ["a", "broken", "b", "broken"] and spark.read.parquet(str(tmp_path / "b")).count() == 5  # what failed is tried again, the rest is not
