"""Queries over samples, corrupted text and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..functions.scripts import LATIN
from ..operators import images, lines, metrics, noise, pairs, sampling, shaping
from . import sql as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col

#: Register noise for Latin letters: look-alikes.
LATIN_CONFUSIONS = {"e": "c", "c": "e", "n": "mh", "m": "n", "h": "nb", "i": "lj", "l": "i", "o": "a", "a": "o", "t": "f", "f": "t", "u": "v"}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, md5('42|' || doc_id) AS shuffle_key FROM documents ORDER BY 2, 1")
def shuffle_seeded(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "documents").select("doc_id"), 42, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def sample_n(spark, sf_dir):
    return sampling.take(table(spark, sf_dir, "documents").select("doc_id"), 100, 7, "doc_id").drop("shuffle_key")


@query(
    "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) "
    "SELECT doc_id, CASE WHEN k <= greatest(1, round_even(n * 0.1, 0)) THEN 'validation' ELSE 'train' END AS split FROM r"
)
def train_val_split(spark, sf_dir):
    return sampling.train_val_split(table(spark, sf_dir, "documents").select("doc_id"), 0.1, 42, "doc_id")


def registers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return tuple(d.where(rule).select("doc_id") for rule in ("lang = 'en'", "lang in ('fr', 'es')", "lang = 'de'"))


def _oversampled(rule: str, share: float, name: str) -> str:
    return (
        f"SELECT doc_id, CAST(unnest(range(1, greatest(1, t // n) + CASE WHEN k <= greatest(0, t - greatest(1, t // n) * n) THEN 1 ELSE 0 END + 1)) AS INTEGER) AS copy, '{name}' AS register "
        f"FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k, count(*) OVER () AS n, CAST(floor((SELECT count(*) FROM documents) * {share}) AS BIGINT) AS t FROM documents WHERE {rule}) WHERE k <= t"
    )


@query(
    "WITH m AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k FROM documents WHERE lang = 'en') "
    "SELECT doc_id, 1 AS copy, 'modern' AS register FROM m WHERE k <= floor((SELECT count(*) FROM documents) * 0.40) "
    f"UNION ALL {_oversampled('lang IN (' + chr(39) + 'fr' + chr(39) + ', ' + chr(39) + 'es' + chr(39) + ')', 0.33, 'classical')} UNION ALL {_oversampled('lang = ' + chr(39) + 'de' + chr(39), 0.27, 'premodern')}"
)
def balance(spark, sf_dir):
    total = table(spark, sf_dir, "documents").count()
    return sampling.balance(*registers(spark, sf_dir), total, 42, "doc_id").select("doc_id", "copy", "register")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, source, text): the turns of all conversations; the role tells the register."""
    register = F.when(c("role") == "user", "modern").when(c("turn") % 2 == 1, "classical").otherwise("premodern")
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string")).alias("key"), register.alias("source"), "text")


_TURNS = "t AS (SELECT concat_ws('-', conv_id, turn) AS key, text FROM conversations)"
_MARKS = "[" + ", ".join(S.lit(m) for m in noise.SPURIOUS) + "]"


@query(
    f"WITH {_TURNS}, e AS (SELECT key, text, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS x, length(text) AS n FROM t), "
    f"u AS (SELECT *, substr(text, i, 1) AS before, {S.draw(42, 'key', 'i', chr(39) + 'err' + chr(39))} AS err, {S.draw(42, 'key', 'i', chr(39) + 'kind' + chr(39))} AS kind, "
    f"{_MARKS}[CAST(floor({S.draw(42, 'key', 'i', chr(39) + 'mark' + chr(39))} * 4) AS INTEGER) + 1] AS mark FROM e), "
    "o AS (SELECT key, i, CASE WHEN err > 0.15 THEN x WHEN kind >= 0.75 AND kind < 0.80 AND x = ' ' AND i > 0 AND i < n - 1 THEN '' "
    "WHEN kind >= 0.80 AND kind < 0.90 AND (i = 0 OR before = ' ') THEN mark || x WHEN kind >= 0.90 AND x = ' ' THEN ' ' || mark || ' ' ELSE x END AS y FROM u) "
    f"SELECT t.key, CASE WHEN {S.strip('t.text')} = '' THEN t.text ELSE (SELECT string_agg(y, '' ORDER BY i) FROM o WHERE o.key = t.key) END AS text FROM t"
)
def noise_chars(spark, sf_dir):
    return turns(spark, sf_dir).select("key", noise.corrupt(c("text"), c("key")).alias("text"))


_KINDS = ["blur", "noise", "erosion", "dilation", "contrast"]


def _drawn(tag: str) -> str:
    return S.draw(42, "doc_id", f"'{tag}'")


@query(
    "WITH o AS (SELECT doc_id, list_sort([" + ", ".join(f"{{'u': {_drawn(k)}, 'kind': '{k}'}}" for k in _KINDS) + f"]) AS o, 2 + CAST(floor({_drawn('count')} * 3) AS INTEGER) AS n, {_drawn('angle')} AS a FROM documents), "
    "k AS (SELECT doc_id, list_transform(o[1:n], lambda s: s.kind) AS ks, a FROM o) "
    "SELECT doc_id, array_to_string(list_filter(['blur', 'erosion', 'dilation', 'noise', 'contrast'], lambda x: list_contains(ks, x) AND NOT (x = 'dilation' AND list_contains(ks, 'erosion'))), ',') AS kinds, round((a * 2 - 1) * 2, 6) AS angle FROM k"
)
def degradation_plan(spark, sf_dir):
    plan = table(spark, sf_dir, "documents").select("doc_id", images.degradation_plan(c("doc_id").cast("string")).alias("p"))
    return plan.select("doc_id", F.array_join("p.kinds", ",").alias("kinds"), F.round("p.angle", 6).alias("angle"))


@query()
def noise_register(spark, sf_dir):
    rate = noise._rates(noise.ERROR_RATES)[c("source")]
    return turns(spark, sf_dir).select("key", noise.register_noise(c("text"), c("key"), rate, 42, LATIN.letters, LATIN_CONFUSIONS).alias("text"))


@query()
def inject_tags(spark, sf_dir):
    return turns(spark, sf_dir).select("key", noise.inject_tags(c("text"), c("key"), 42, LATIN.letters).alias("text"))


def made_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, input, target, source): the turns' pieces of 20 to 340 characters, their numbers at the end of the key."""
    pieces = turns(spark, sf_dir).select("key", "source", F.posexplode(shaping.pack(c("text"))).alias("n", "text"))
    short = pieces.withColumn("key", F.concat_ws("-", "key", c("n").cast("string")))
    return short.select("key", noise.training_pairs(c("text"), c("key"), c("source"), 42, LATIN.letters, LATIN_CONFUSIONS).alias("input"), c("text").alias("target"), "source")


@query()
def training_pairs(spark, sf_dir):
    return pairs.usable(made_pairs(spark, sf_dir))


_ASCII = r"[^\x00-\x7F]"
#: Characters of a line in a pair.
PIECE = 200


def simple_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, input, target, source): all lines of all documents in pieces of PIECE characters; inputs of every seventh document have a tag."""
    rows = lines.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "source").where("line <> ''")
    starts = F.sequence(F.lit(0), F.floor((F.char_length("line") - 1) / PIECE).cast("int"))
    pieces = rows.select("doc_id", "source", "line_no", F.posexplode(F.transform(starts, lambda k: F.substring("line", k * PIECE + 1, F.lit(PIECE)))).alias("piece", "target"))
    tagged = F.when(c("doc_id") % 7 == 0, F.concat(F.lit("<mark>"), "target", F.lit("</mark>"))).otherwise(F.regexp_replace("target", "[ae]", "o"))
    return pieces.select(F.concat_ws("-", *[c(x).cast("string") for x in ("doc_id", "line_no", "piece")]).alias("key"), tagged.alias("input"), "target", "source")


_PAIRS = (
    f"{S.lines(key='doc_id, source')}, q AS (SELECT doc_id, source, line_no, line, unnest(range(CAST(ceil(length(line) / {PIECE}) AS BIGINT))) AS piece FROM lines WHERE line <> ''), "
    f"r AS (SELECT doc_id, concat_ws('-', doc_id, line_no, piece) AS key, source, substring(line, piece * {PIECE} + 1, {PIECE}) AS target FROM q), "
    "p AS (SELECT key, CASE WHEN doc_id % 7 = 0 THEN '<mark>' || target || '</mark>' ELSE regexp_replace(target, '[ae]', 'o', 'g') END AS input, target, source FROM r)"
)


@query(f"WITH {_PAIRS} SELECT source, count(*) AS pairs FROM p GROUP BY source")
def register_mix(spark, sf_dir):
    return pairs.register_mix(simple_pairs(spark, sf_dir))


@query(
    f"WITH {_PAIRS} SELECT count(*) AS total_pairs, CAST(min(length(target)) AS INTEGER) AS chars_min, CAST(max(length(target)) AS INTEGER) AS chars_max, round(avg(length(target)), 1) AS chars_mean, median(length(target)) AS chars_median, "
    "CAST(min(strlen(target)) AS INTEGER) AS bytes_min, CAST(max(strlen(target)) AS INTEGER) AS bytes_max, round(avg(strlen(target)), 1) AS bytes_mean, median(strlen(target)) AS bytes_median, "
    "count(*) FILTER (WHERE strlen(target) <= 512) AS fits_512, count(*) FILTER (WHERE strlen(target) <= 1024) AS fits_1024, count(*) FILTER (WHERE input LIKE '%<mark>%') AS tagged, "
    "round(100 * count(*) FILTER (WHERE input LIKE '%<mark>%') / count(*), 1) AS tagged_pct FROM p"
)
def pair_stats(spark, sf_dir):
    return pairs.stats(simple_pairs(spark, sf_dir), "key").drop("avg_edits")


@query(
    f"WITH {_PAIRS}, a AS (SELECT {S.rep('input', _ASCII)} AS x, {S.rep('target', _ASCII)} AS y FROM p) "
    "SELECT count(*) AS total_pairs, round(avg(levenshtein(regexp_replace(x, '</?mark>', '', 'g'), y)), 1) AS avg_edits FROM a"
)
def pair_edits(spark, sf_dir):
    ascii_ = simple_pairs(spark, sf_dir).withColumns({n: T.replace(c(n), _ASCII) for n in ("input", "target")})  # the SQL counts bytes
    return pairs.stats(ascii_, "key").select("total_pairs", "avg_edits")


@query(
    f"WITH {_PAIRS} SELECT count(*) AS total, count(*) FILTER (WHERE {S.has('input', T.ANY_TAG)}) AS html_input, count(*) FILTER (WHERE {S.has('target', T.ANY_TAG)}) AS html_target, "
    f"count(*) FILTER (WHERE NOT {S.script('input')}) AS no_script FROM p"
)
def pair_audit(spark, sf_dir):
    return pairs.audit(simple_pairs(spark, sf_dir), LATIN)


@query("SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))")
def resume_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    done = docs.join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    return pairs.unfinished(docs.select("text"), done, "text")


@query(
    f"WITH {_PAIRS}, a AS (SELECT key, {S.rep('input', _ASCII)} AS x, {S.rep('target', _ASCII)} AS y FROM p) SELECT key, CAST(levenshtein(x, y) AS INTEGER) AS edits, levenshtein(x, y) >= 2 AS enough FROM a"
)
def edit_distance(spark, sf_dir):
    a, b = T.replace(c("input"), _ASCII), T.replace(c("target"), _ASCII)
    return simple_pairs(spark, sf_dir).select("key", udfs.edits(a, b).alias("edits"), T.edits_at_least(a, b, 2).alias("enough"))


@query()
def cer_wer(spark, sf_dir):
    clean = turns(spark, sf_dir).where(F.char_length("text") > 0).select("key", "text")
    return metrics.score(clean.select("key", noise.corrupt(c("text"), c("key")).alias("text")), clean, "key")


@query(
    f"WITH {_PAIRS}, t AS (SELECT key, row_number() OVER (ORDER BY md5('42|' || key), key) AS k FROM p), v AS (SELECT key, row_number() OVER (ORDER BY md5('43|' || key), key) AS k FROM t WHERE k <= 500) "
    "SELECT key, CASE WHEN k <= 50 THEN 'validation' ELSE 'train' END AS split FROM v"
)
def pack_pairs(spark, sf_dir):
    return pairs.pack(simple_pairs(spark, sf_dir), 500, 0.1, 42, "key").select("key", "split")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE k > floor(n * 0.4)")
def remaining_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.remaining(docs, sampling.take(docs, int(docs.count() * 0.4), 42, "doc_id"), "doc_id")


@query(
    "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9|' || doc_id), doc_id) AS k FROM documents), "
    f"d AS (SELECT copy, CAST(floor({S.draw(9, 'copy', chr(39) + 'draw' + chr(39))} * (SELECT count(*) FROM documents)) AS BIGINT) + 1 AS k FROM range(1, 501) t(copy)) SELECT r.doc_id, d.copy FROM d JOIN r ON d.k = r.k"
)
def draws_with_replacement(spark, sf_dir):
    return sampling.with_replacement(table(spark, sf_dir, "documents").select("doc_id"), 500, 9, "doc_id").select("doc_id", "copy")


@query(
    "WITH m AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k FROM documents WHERE lang = 'en'), n AS (SELECT count(*) AS n, floor(count(*) * 0.27) AS p FROM documents), "
    "e AS (SELECT CAST(floor(n * 0.40) AS BIGINT) AS m, CAST(floor(p / 2) AS BIGINT) AS half, CAST(p - floor(p / 2) AS BIGINT) AS rest, CAST(floor(n * 0.33) AS BIGINT) AS c FROM n), "
    "k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('43|' || doc_id), doc_id) AS k FROM documents WHERE lang = 'de'), "
    f"d AS (SELECT CAST(copy AS BIGINT) AS copy, CAST(floor({S.draw(43, 'copy', chr(39) + 'draw' + chr(39))} * (SELECT count(*) FROM k)) AS BIGINT) + 1 AS k FROM e, unnest(range(1, e.rest + 1)) t(copy)) "
    "SELECT doc_id, 1 AS copy, 'modern' AS register FROM m, e WHERE m.k <= e.m + CASE WHEN (SELECT count(*) FROM m) > e.m + e.half THEN e.half ELSE 0 END "
    f"UNION ALL {_oversampled('lang = ' + chr(39) + 'de' + chr(39), 0.33, 'classical')} UNION ALL SELECT k.doc_id, CAST(d.copy + e.c AS INTEGER), 'classical' FROM d JOIN k ON d.k = k.k, e"
)
def redistribute(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    modern, classical = (docs.where(f"lang = '{x}'").select("doc_id") for x in ("en", "de"))
    return sampling.balance(modern, classical, classical.limit(0), docs.count(), 42, "doc_id").select("doc_id", "copy", "register")


@query(
    f"WITH {_PAIRS} SELECT key FROM p WHERE input <> target AND strlen(input) <= 1024 AND strlen(target) <= 1024"
)
def usable_pairs(spark, sf_dir):
    return pairs.usable(simple_pairs(spark, sf_dir)).select("key")


@query(f"SELECT key, text FROM (SELECT concat_ws('-', conv_id, turn) AS key, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS k, text FROM conversations) WHERE k = 1")
def first_of_each(spark, sf_dir):
    return lines.keep_first(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn").select(F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string")).alias("key"), "text")
