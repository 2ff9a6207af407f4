"""Queries over page tables and boxes: formatting, shaping, layout, engines, metrics.

Conversations stand in for documents of pages (a turn is a page, with a heading and a page number added); order lines stand in
for recognised lines and layout blocks, with boxes made of their integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scripts import LATIN
from ..operators import formatting, layout, lines, metrics, shaping
from . import sql as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, text)"""
    t = table(spark, sf_dir, "conversations")
    page = F.row_number().over(_by("conv_id", "turn", "role", "text"))
    return t.select(
        F.concat(F.lit("doc"), c("conv_id").cast("string")).alias("doc"), page.alias("page"),
        F.concat_ws("\n", F.concat(F.lit("Chronicle "), (c("conv_id") % 7).cast("string")), F.lit(""), F.coalesce("text", F.lit("")), (c("turn") + 1).cast("string")).alias("text"),
    )


def _by(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


PAGES = (
    "WITH pages_ AS (SELECT 'doc' || conv_id AS doc, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS page, "
    "'Chronicle ' || (conv_id % 7) || chr(10) || chr(10) || coalesce(text, '') || chr(10) || (turn + 1) AS text FROM conversations)"
)
FILLED = f"list_filter(list_transform(string_split(text, chr(10)), lambda v: {S.strip('v')}), lambda v: v <> '')"
NUMERAL = lambda x: f"({S.has(x, T.PAGE_NUMBER)} OR {S.has(x, T.ROMAN_NUMBER)})"
_STRIP_NUMBERS = (
    "n1 AS (SELECT doc, page, string_split(text, chr(10)) AS xs FROM pages_), n2 AS (SELECT doc, page, len(xs) AS n, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM n1), "
    f"n3 AS (SELECT * FROM n2 WHERE NOT ((i < 3 OR i >= n - 3) AND {NUMERAL('x')}))"
)
_HEADERS = (
    f"h1 AS (SELECT doc, page, {FILLED} AS ls FROM pages_), h2 AS (SELECT DISTINCT doc, page, unnest(list_concat(ls[1:3], ls[-3:])) AS line FROM h1), "
    "h3 AS (SELECT doc, line, count(*) AS pages FROM h2 GROUP BY ALL), h4 AS (SELECT doc, count(*) AS n FROM pages_ GROUP BY doc HAVING count(*) >= 3), "
    f"headers AS (SELECT doc, line, pages FROM h3 JOIN h4 USING (doc) WHERE pages >= greatest(2, CAST(floor(n * 0.35) AS BIGINT)) AND length(line) < 50 AND NOT (length(line) > 30 AND {S.script('line', chr(92) + 'x{0B80}-' + chr(92) + 'x{0BFF}')}))"
)


@query(f"{PAGES}, {_STRIP_NUMBERS} SELECT p.doc, p.page, coalesce((SELECT string_agg(x, chr(10) ORDER BY i) FROM n3 WHERE n3.doc = p.doc AND n3.page = p.page), '') AS text FROM pages_ p")
def page_numbers(spark, sf_dir):
    return pages(spark, sf_dir).withColumn("text", formatting.strip_page_numbers(c("text")))


@query(
    f"{PAGES}, m AS (SELECT doc, page, {FILLED} AS ls FROM pages_), s AS (SELECT doc, page, CASE WHEN len(ls) > 5 THEN list_concat(ls[1:5], list_reverse(ls[-5:])) ELSE ls END AS scan FROM m) "
    f"SELECT doc, page, coalesce(list_filter(scan, lambda v: {NUMERAL('v')})[1], '') AS number FROM s"
)
def page_metadata(spark, sf_dir):
    number, _ = formatting.page_metadata(c("text"))
    return pages(spark, sf_dir).select("doc", "page", number.alias("number"))


@query(f"{PAGES}, {_HEADERS} SELECT * FROM headers")
def running_headers(spark, sf_dir):
    return formatting.running_headers(pages(spark, sf_dir))


@query(
    f"{PAGES}, {_HEADERS}, a AS (SELECT doc, page, string_split(text, chr(10)) AS xs FROM pages_), b AS (SELECT doc, page, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM a), "
    f"f AS (SELECT doc, page, i, row_number() OVER (PARTITION BY doc, page ORDER BY i) AS up, row_number() OVER (PARTITION BY doc, page ORDER BY i DESC) AS down FROM b WHERE {S.strip('x')} <> ''), "
    f"k AS (SELECT b.* FROM b LEFT JOIN f USING (doc, page, i) LEFT JOIN headers h ON h.doc = b.doc AND h.line = {S.strip('b.x')} WHERE b.page = 1 OR NOT coalesce((f.up <= 4 OR f.down <= 4) AND h.line IS NOT NULL, false)) "
    "SELECT p.doc, p.page, coalesce((SELECT string_agg(x, chr(10) ORDER BY i) FROM k WHERE k.doc = p.doc AND k.page = p.page), '') AS text FROM pages_ p"
)
def strip_headers(spark, sf_dir):
    p = pages(spark, sf_dir)
    return formatting.strip_headers(p, formatting.running_headers(p)).select("doc", "page", "text")





#: Speech marks that open a turn, and closing ones.
_ENDS = "rtrim(acc[-1]) <> '' AND contains('.!?।\"''”’‘“…', right(rtrim(acc[-1]), 1))"
_OPEN = (
    f"len(acc) > 0 AND {S.strip('x')} <> '' AND {S.strip('acc[-1]')} <> '' AND length(acc[-1]) < 30 AND NOT ({_ENDS}) AND NOT regexp_matches({S.strip('x')}, '^[''\"‘’“”«—]') "
    f"AND NOT regexp_matches(acc[-1], '(''''|’’|\"|”)$') AND NOT (length(acc[-1]) < 8 AND NOT regexp_matches({S.strip('x')}, '^[\\x{{B80}}-\\x{{BFF}}]'))"
)


@query(
    f"SELECT doc_id, CASE WHEN len(xs) <= 1 THEN text ELSE array_to_string(list_reduce(xs, lambda acc, x: CASE WHEN {_OPEN} THEN list_append(acc[1:len(acc) - 1], acc[-1] || ' ' || {S.strip('x')}) "
    f"ELSE list_append(acc, CASE WHEN {S.strip('x')} = '' THEN x ELSE {S.strip('x')} END) END, CAST([] AS VARCHAR[])), chr(10)) END AS text FROM (SELECT doc_id, text, string_split(text, chr(10)) AS xs FROM documents)"
)
def merge_short_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lines.merge_short_lines(c("text")).alias("text"))


_REFLOW = (
    f"WITH l AS (SELECT doc_id, list_transform({S.split_lines('text')}, lambda v: {S.strip('v')}) AS xs FROM d), e AS (SELECT doc_id, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM l), "
    "g AS (SELECT *, CASE WHEN x = '' OR length(x) >= 18 OR coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), '') = '' THEN 1 ELSE 0 END AS start FROM e), "
    "s AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM g), j AS (SELECT doc_id, grp, string_agg(x, ' ' ORDER BY i) AS line FROM s GROUP BY ALL), "
    "b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY grp) AS before FROM j) "
    f"SELECT d.doc_id, {S.strip('coalesce((SELECT string_agg(line, chr(10) ORDER BY grp) FROM b WHERE b.doc_id = d.doc_id AND NOT (line = chr(0) OR (line = ' + chr(39) * 2 + ' AND before = ' + chr(39) * 2 + '))), ' + chr(39) * 2 + ')')} AS text FROM d"
).replace("line = chr(0) OR ", "")


@query("WITH d AS (SELECT doc_id, regexp_replace(text, '[.] ', chr(10), 'g') AS text FROM documents), " + _REFLOW[5:])
def reflow(spark, sf_dir):
    broken = F.regexp_replace("text", "[.] ", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", lines.reflow(broken).alias("text"))


@query(
    f"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda v: {S.strip('v')}), lambda v: v <> '') AS xs FROM documents), "
    "e AS (SELECT doc_id, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM l), g AS (SELECT *, coalesce(sum(CASE WHEN right(x, 1) IN ('.', '!', '?', '။') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM e), "
    "j AS (SELECT doc_id, grp, string_agg(x, ' ' ORDER BY i) AS p FROM g GROUP BY ALL) SELECT d.doc_id, coalesce((SELECT string_agg(p, chr(10) || chr(10) ORDER BY grp) FROM j WHERE j.doc_id = d.doc_id), '') AS text FROM documents d"
)
def paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lines.paragraphs(c("text")).alias("text"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)[ \\t\\r\\x0B\\f]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS text FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '  ' || chr(10), 'g') AS t FROM pages)")
def blank_collapse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", lines.collapse_blank_lines(F.regexp_replace("html", "<[^>]+>", "  \n")).alias("text"))


@query()
def format_document(spark, sf_dir):
    return formatting.format_document(pages(spark, sf_dir))


@query("SELECT conv_id, string_agg(t, chr(10) ORDER BY turn, t) AS text FROM (SELECT conv_id, turn, 'PAGE ' || turn || chr(10) || coalesce(text, '') AS t FROM conversations) GROUP BY conv_id")
def assemble_doc(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("t", F.concat(F.lit("PAGE "), c("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))))
    return lines.ordered_join(t, ["conv_id"], "turn", "t")


def verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, line_no, line): the sentences of each document."""
    split = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("source"), F.posexplode(T.split_sentences(c("text"))).alias("line_no", "line"))
    return split


_VERSE = f"v0 AS (SELECT 'd' || doc_id AS source, {S.sentences('text')} AS xs FROM documents)"


@query(
    f"WITH RECURSIVE {_VERSE}, f(source, i, done, buf) AS (SELECT source, 0, CAST([] AS VARCHAR[]), '' FROM v0 UNION ALL SELECT f.source, i + 1, "
    "CASE WHEN length(x) >= 80 THEN CASE WHEN buf = '' THEN list_append(done, x) ELSE list_append(list_append(done, buf), x) END WHEN buf <> '' AND length(buf) + length(x) + 1 > 150 THEN list_append(done, buf) "
    "WHEN length(CASE WHEN buf = '' THEN x ELSE buf || ' ' || x END) >= 80 THEN list_append(done, CASE WHEN buf = '' THEN x ELSE buf || ' ' || x END) ELSE done END, "
    "CASE WHEN length(x) >= 80 THEN '' WHEN buf <> '' AND length(buf) + length(x) + 1 > 150 THEN x WHEN length(CASE WHEN buf = '' THEN x ELSE buf || ' ' || x END) >= 80 THEN '' ELSE CASE WHEN buf = '' THEN x ELSE buf || ' ' || x END END "
    "FROM (SELECT f.*, v0.xs[f.i + 1] AS x FROM f JOIN v0 USING (source) WHERE f.i < len(v0.xs)) f), "
    "r AS (SELECT f.source, CASE WHEN length(buf) >= 20 THEN list_append(done, buf) ELSE done END AS ls FROM f JOIN v0 USING (source) WHERE f.i = len(v0.xs)) "
    "SELECT source, l AS line, count(*) AS n FROM (SELECT source, unnest(ls) AS l FROM r) GROUP BY ALL"
)
def stanza_concat(spark, sf_dir):
    return shaping.join_stanzas(verse(spark, sf_dir)).groupBy("source", "line").agg(F.count("*").alias("n"))


_PARTS = "string_split(regexp_replace(line, '([.!?।])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(
    f"WITH {S.lines()}, f AS (SELECT doc_id, line_no, line, list_reduce({_PARTS}, lambda a, p: CASE WHEN length(a.now) + length(p) + 1 <= 340 "
    f"THEN {{'done': a.done, 'now': CASE WHEN a.now = '' THEN p ELSE {S.strip('a.now || chr(32) || p')} END}} ELSE {{'done': CASE WHEN a.now = '' THEN a.done ELSE list_append(a.done, a.now) END, 'now': p}} END, "
    "{'done': CAST([] AS VARCHAR[]), 'now': ''}) AS s FROM lines), g AS (SELECT *, CASE WHEN s.now = '' THEN s.done ELSE list_append(s.done, s.now) END AS ps FROM f), "
    "h AS (SELECT doc_id, line_no, CASE WHEN length(line) < 20 THEN CAST([] AS VARCHAR[]) WHEN length(line) <= 340 THEN [line] "
    "ELSE list_filter(flatten(list_transform(ps, lambda s: list_transform(range(0, length(s), 340), lambda i: substring(s, i + 1, 340)))), lambda v: length(v) >= 20) END AS xs FROM g) "
    "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(unnest(range(len(xs))) AS INTEGER) AS piece_no, unnest(xs) AS piece FROM h"
)
def length_pack(spark, sf_dir):
    split = lines.explode_lines(table(spark, sf_dir, "documents"), "doc_id")
    return split.select("doc_id", "line_no", F.posexplode(shaping.pack(c("line"))).alias("piece_no", "piece"))


# ------------------------------------------------------------------ layout


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, line_no, text, box, confidence)"""
    t = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(_by("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    x, y = (c("l_partkey") % 4 * 150).cast("double"), (c("l_suppkey") % 10 * 60).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 40 + c("l_quantity")).alias("x1"), (y + 25).alias("y1"))
    return t.select(
        (c("l_orderkey") % 100).cast("string").alias("doc"), c("l_orderkey").alias("page"), n.alias("line_no"), F.concat(F.lit("line "), c("l_partkey").cast("string")).alias("text"),
        F.when(c("l_partkey") % 11 != 0, box).alias("box"), F.when(c("l_suppkey") % 13 != 0, F.round(1 - c("l_discount") * 3, 4)).alias("confidence"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, block, label, box, confidence, width, height)"""
    t = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(_by("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    x, y = (c("l_partkey") % 4 * 150 - c("l_partkey") % 3 * 10).cast("double"), (c("l_suppkey") % 5 * 120).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 115).alias("y1"))
    label = F.element_at(F.array(*map(F.lit, ["Text", "PageHeader", "Picture", "SectionHeader", "Text"])), (c("l_suppkey") % 5 + 1).cast("int"))
    return t.select(
        (c("l_orderkey") % 100).cast("string").alias("doc"), c("l_orderkey").alias("page"), n.alias("block"), label.alias("label"), box.alias("box"),
        F.round(1 - c("l_tax") * 10, 4).alias("confidence"), F.lit(800).alias("width"), F.lit(1000).alias("height"),
    )


_NTH = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER)"
LINES = (
    f"ls AS (SELECT CAST(l_orderkey % 100 AS VARCHAR) AS doc, l_orderkey AS page, {_NTH} AS line_no, l_partkey % 11 <> 0 AS boxed, CAST(l_partkey % 4 * 150 AS DOUBLE) AS x0, CAST(l_suppkey % 10 * 60 AS DOUBLE) AS y0, "
    "l_partkey % 4 * 150 + 40 + l_quantity AS x1, CAST(l_suppkey % 10 * 60 + 25 AS DOUBLE) AS y1, CASE WHEN l_suppkey % 13 <> 0 THEN round(1 - l_discount * 3, 4) END AS confidence, 'line ' || l_partkey AS text FROM lineitem)"
)
BLOCKS = (
    f"bs AS (SELECT CAST(l_orderkey % 100 AS VARCHAR) AS doc, l_orderkey AS page, {_NTH} AS block, ['Text', 'PageHeader', 'Picture', 'SectionHeader', 'Text'][l_suppkey % 5 + 1] AS label, "
    "CAST(l_partkey % 4 * 150 - l_partkey % 3 * 10 AS DOUBLE) AS x0, CAST(l_suppkey % 5 * 120 AS DOUBLE) AS y0, CAST(l_partkey % 4 * 150 - l_partkey % 3 * 10 + 100 AS DOUBLE) AS x1, CAST(l_suppkey % 5 * 120 + 115 AS DOUBLE) AS y1, "
    "round(1 - l_tax * 10, 4) AS confidence FROM lineitem)"
)


@query(
    f"WITH {LINES}, {BLOCKS}, j AS (SELECT ls.doc, ls.page, ls.line_no, ls.boxed, bs.block, greatest(0, least(ls.x1, bs.x1) - greatest(ls.x0, bs.x0)) * greatest(0, least(ls.y1, bs.y1) - greatest(ls.y0, bs.y0)) / ((ls.x1 - ls.x0) * (ls.y1 - ls.y0)) AS share "
    "FROM ls LEFT JOIN bs USING (doc, page)), r AS (SELECT *, row_number() OVER (PARTITION BY page, line_no ORDER BY share DESC, block) AS k, min(block) OVER (PARTITION BY page, line_no) AS first_block FROM j) "
    "SELECT doc, page, line_no, CASE WHEN NOT boxed THEN first_block WHEN share > 0.50 THEN block END AS block FROM r WHERE k = 1"
)
def line_block_assign(spark, sf_dir):
    return layout.assign_lines(ocr_lines(spark, sf_dir), blocks(spark, sf_dir))


_SHARED = "greatest(0, least(b.x1, k.x1) - greatest(b.x0, k.x0)) * greatest(0, least(b.y1, k.y1) - greatest(b.y0, k.y0))"
_BLOCK = "{'c': -confidence, 'n': block, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"


@query(
    f"WITH {BLOCKS}, p AS (SELECT doc, page, list({_BLOCK} ORDER BY {_BLOCK}) AS xs FROM bs GROUP BY ALL), "
    f"k AS (SELECT doc, page, list_reduce(xs[2:], lambda a, b: CASE WHEN len(list_filter(a, lambda k: {_SHARED} > 0.70 * ((b.x1 - b.x0) * (b.y1 - b.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) - {_SHARED}))) = 0 THEN list_append(a, b) ELSE a END, xs[1:1]) AS ks FROM p), "
    "u AS (SELECT doc, page, unnest(ks).n AS block FROM k) SELECT doc, page, block, label, confidence FROM bs JOIN u USING (doc, page, block)"
)
def nms_blocks(spark, sf_dir):
    return layout.suppress_duplicates(blocks(spark, sf_dir)).select("doc", "page", "block", "label", "confidence")


@query(
    f"WITH {BLOCKS}, p AS (SELECT doc, page, list({_BLOCK} ORDER BY {_BLOCK}) AS xs FROM bs GROUP BY ALL), "
    f"k AS (SELECT doc, page, list_reduce(xs[2:], lambda a, b: CASE WHEN len(list_filter(a, lambda k: {_SHARED} > 0.60 * ((b.x1 - b.x0) * (b.y1 - b.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) - {_SHARED}))) = 0 THEN list_append(a, b) ELSE a END, xs[1:1]) AS ks FROM p) "
    "SELECT doc, page, CAST(len(ks) AS BIGINT) AS n_blocks FROM k"
)
def nms_columns(spark, sf_dir):
    return layout.suppress_duplicates(blocks(spark, sf_dir), layout.same_block(2)).groupBy("doc", "page").agg(F.count("*").alias("n_blocks"))


@query(
    f"WITH {BLOCKS} SELECT doc, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM bs GROUP BY doc, page"
)
def region_extents(spark, sf_dir):
    return layout.region_extents(blocks(spark, sf_dir))


@query(
    f"WITH p AS (SELECT coalesce(text, '') AS t FROM documents) SELECT avg(CASE WHEN {S.strip('t')} = '' THEN 1 ELSE 0 END) AS blank_rate, avg(CASE WHEN {S.has('t', f'[{LATIN.stray}]')} THEN 1 ELSE 0 END) AS stray_rate, "
    f"round(avg(CASE WHEN length(t) > 0 THEN {S.count_script('t')} / length(t) ELSE 0.0 END), 6) AS script_ratio FROM p"
)
def quality_rates(spark, sf_dir):
    return layout.quality_rates(table(spark, sf_dir, "documents"), LATIN).withColumn("script_ratio", F.round("script_ratio", 6))


@query()
def reading_order(spark, sf_dir):
    return layout.reading_order(blocks(spark, sf_dir)).select("doc", "page", "block", "rank")


def read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks with page sizes and texts, every seventh blank."""
    text = F.when(c("block") % 7 == 3, " ").otherwise(F.concat(F.lit(" block "), c("block").cast("string"), F.lit("\n")))
    return blocks(spark, sf_dir).withColumns({"width": F.lit(600), "height": F.lit(800), "text": text, "fallback": F.lit(False)})


@query()
def page_accessors(spark, sf_dir):
    return layout.page_accessors(read_blocks(spark, sf_dir))


@query()
def reconstruct_page(spark, sf_dir):
    return layout.reconstruct(ocr_lines(spark, sf_dir), blocks(spark, sf_dir))


@query(
    f"WITH {BLOCKS}, t AS (SELECT doc, page, coalesce(bool_or(confidence >= 0.3 AND label IN ('Text', 'SectionHeader', 'Caption', 'ListItem', 'Footnote', 'TableOfContents', 'Form', 'Code')), false) AS ok FROM bs GROUP BY ALL) "
    "SELECT bs.doc, bs.page, bs.block, bs.label, false AS fallback FROM bs JOIN t USING (doc, page) WHERE t.ok AND bs.confidence >= 0.3 UNION ALL SELECT doc, page, 0, 'Text', true FROM t WHERE NOT ok"
)
def usable_blocks(spark, sf_dir):
    return layout.usable_blocks(blocks(spark, sf_dir)).select("doc", "page", "block", "label", "fallback")


@query(f"WITH {LINES} SELECT doc, page, round(coalesce(avg(confidence), 0.0), 6) AS confidence, count(*) AS n_lines FROM ls GROUP BY doc, page")
def page_confidence(spark, sf_dir):
    return layout.page_confidence(ocr_lines(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {LINES} SELECT doc, page, line_no, coalesce(confidence < 0.90, false) AND length({S.strip('text')}) > 3 AS corrected FROM ls")
def surgical_gate(spark, sf_dir):
    return ocr_lines(spark, sf_dir).select("doc", "page", "line_no", layout.needs_correction(c("confidence"), c("text")).alias("corrected"))


@query(f"WITH {LINES}, p AS (SELECT doc, page, avg(confidence) AS m, count(confidence) AS k, count(*) AS n FROM ls GROUP BY ALL) SELECT doc, page, coalesce(k > 0 AND (round(m, 6) < 0.80 OR (page % 5 >= 3 AND n < 10)), false) AS review FROM p")
def qa_gate(spark, sf_dir):
    p = ocr_lines(spark, sf_dir).groupBy("doc", "page").agg(F.avg("confidence").alias("m"), F.count("confidence").alias("k"), F.count("*").alias("n"))
    return p.select("doc", "page", F.coalesce(layout.needs_review(F.round("m", 6), c("k"), c("page") % 5, c("n")), F.lit(False)).alias("review"))


@query(
    "WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey AS page, CAST(600 + o_orderkey % 9 * 100 AS INTEGER) AS width, 1000 AS height FROM orders), "
    "e AS (SELECT doc, page, height, unnest(CASE WHEN width > height * 1.3 THEN [[0, width // 2], [width // 2, width]] ELSE [[0, width]] END) AS s FROM p) "
    "SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page, s[1]) AS INTEGER) AS page, CAST(s[1] AS INTEGER) AS x0, CAST(s[2] AS INTEGER) AS x1, height FROM e"
)
def spread_split(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(c("o_custkey").cast("string").alias("doc"), c("o_orderkey").alias("page"), (600 + c("o_orderkey") % 9 * 100).cast("int").alias("width"), F.lit(1000).alias("height"))
    return layout.split_spreads(p)


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_partkey % 100 < 50 THEN 'scan' WHEN p_size % 3 = 0 AND p_partkey % 100 > 50 THEN 'digital' WHEN p_size % 3 > 0 AND p_partkey % 100 > 50 THEN 'hybrid' ELSE 'unknown' END AS kind FROM part")
def pdf_verdict(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", layout.document_kind(c("p_size") % 3, c("p_partkey") % 100).alias("kind"))


def engine(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    return t.select(c("source").alias("doc"), c("doc_id").alias("page"), F.round((c("n_chars") * (7 + which) % 100) / 100, 2).alias("confidence"), F.size(T.split_lines(c("text"))).alias("n_lines"), "text")


def _engine(factor: int) -> str:
    return f"(SELECT source AS doc, doc_id AS page, round((n_chars * {factor} % 100) / 100, 2) AS confidence, len({S.split_lines('text')}) AS n_lines, length(text) AS chars FROM documents)"


_COMPARED = f"WITH a AS {_engine(7)}, b AS {_engine(8)}"


@query(
    f"{_COMPARED} SELECT a.doc, a.page, a.confidence AS a_confidence, CAST(a.n_lines AS INTEGER) AS a_n_lines, CAST(a.chars AS INTEGER) AS a_chars, b.confidence AS b_confidence, CAST(b.n_lines AS INTEGER) AS b_n_lines, CAST(b.chars AS INTEGER) AS b_chars FROM a JOIN b USING (doc, page)"
)
def engine_compare(spark, sf_dir):
    return metrics.compare_engines(engine(spark, sf_dir, 0), engine(spark, sf_dir, 1))


@query(f"{_COMPARED}, w AS (SELECT count(*) FILTER (WHERE a.confidence >= b.confidence) AS a_wins, count(*) FILTER (WHERE a.confidence < b.confidence) AS b_wins FROM a JOIN b USING (doc, page)) SELECT *, CASE WHEN a_wins >= b_wins THEN 'a' ELSE 'b' END AS winner FROM w")
def best_engine(spark, sf_dir):
    return metrics.best_engine(engine_compare(spark, sf_dir))


@query(
    f"WITH r AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN ' ' ELSE d.text END AS f, CASE WHEN d.doc_id % 2 = 0 THEN d.lang END AS p, d.source AS e FROM documents d) "
    f"SELECT doc_id, coalesce(CASE WHEN {S.strip('f')} <> '' THEN {S.strip('f')} END, p, e) AS reference, CASE WHEN {S.strip('f')} <> '' THEN 'user-provided reference file' WHEN p IS NOT NULL THEN 'user-provided reference text' WHEN e IS NOT NULL THEN 'embedded PDF text (best-effort)' ELSE 'no reference available' END AS origin FROM r"
)
def reference_pick(spark, sf_dir):
    ref, origin = metrics.reference_text(F.when(c("doc_id") % 3 == 0, " ").otherwise(c("text")), F.when(c("doc_id") % 2 == 0, c("lang")), c("source"))
    return table(spark, sf_dir, "documents").select("doc_id", ref.alias("reference"), origin.alias("origin"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN ['en'] WHEN 'fr' THEN ['ta', 'en'] WHEN 'de' THEN ['hi', 'en'] ELSE ['te', 'bn', 'en'] END AS codes FROM documents")
def lang_codes(spark, sf_dir):
    pick = lambda *labels: F.array(*map(F.lit, labels))
    labels = F.when(c("lang") == "en", pick("English")).when(c("lang") == "fr", pick("unknown")).when(c("lang") == "de", pick("Hindi (हिन्दी)")).otherwise(pick("Telugu (తెలుగు)", "Bengali (বাংলা)", "English"))
    return table(spark, sf_dir, "documents").select("doc_id", T.language_codes(labels).alias("codes"))


_RAW = "CASE user_id % 4 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN j WHEN 2 THEN '{\"doc_type\":\"newspaper\",\"detected_language\":\"xx\"}' ELSE 'no json' END"


@query(
    "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'modern_print' WHEN 1 THEN 'modern_print' WHEN 2 THEN 'newspaper' ELSE 'historical_scan' END AS doc_type, CASE WHEN user_id % 4 < 2 THEN 'hi' ELSE 'ta' END AS detected_language, "
    "CASE WHEN user_id % 4 < 2 THEN CAST(user_id % 10 AS INTEGER) ELSE 5 END AS noise_level, CASE WHEN user_id % 4 < 2 THEN 2 ELSE 1 END AS estimated_columns, CASE WHEN user_id % 4 < 2 THEN 'seen' WHEN user_id % 4 = 2 THEN '' ELSE 'fallback' END AS routing_reason FROM events"
)
def llm_json(spark, sf_dir):
    j = F.concat(F.lit('{"doc_type":"modern_print","detected_language":"hi","noise_level":'), (c("user_id") % 10).cast("string"), F.lit(',"estimated_columns":2,"routing_reason":"seen"}'))
    kind = c("user_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(kind == 1, j).when(kind == 2, '{"doc_type":"newspaper","detected_language":"xx"}').otherwise("no json")
    return table(spark, sf_dir, "events").select("event_id", T.routing_decision(raw).alias("d")).select("event_id", "d.*")


@query("SELECT doc_id, 'Language: ' || lang || chr(10) || 'Scores: [0.500, 0.250]' || chr(10) || 'Text:' || chr(10) || substr(text, 1, 3000) AS prompt FROM documents")
def review_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.prompt(c("text"), F.array(F.lit(0.5), F.lit(0.25)), c("lang")).alias("prompt"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS events FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    from ..streaming.streams import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).select("event_type", c("window.start").alias("start"), "events")
