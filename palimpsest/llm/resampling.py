"""Target-distribution importance resampling: documents are drawn by how much their features look like those of a target table.

Identical texts are collapsed by grouping the full text; words, features and weights are made once for each different text and corpus
counts take them as often as the text stands. Weights are joined back to the documents by two hashes of the text, and only then comes what
is each document's own: Gumbel noise from its id, the score, the rank. All of it is DataFrame functions; what is shuffled are texts once, then
hashes and numbers. The bucket table (a parameter's size, whatever the corpus holds) is the one thing that passes the driver.

Ranks come from one range partitioning: places inside a partition are counted there, and the sizes of the partitions before it are added.

Null and empty texts have no features: weight 0, never drawn. A null doc_id hashes as an empty one. Repeated rows are rows: they count, and
share features, weight and, if their ids agree, the noise; equal scores go by doc_id (null last) and then by weight and features, so that
interchangeable rows alone are ranked arbitrarily. A very long text is a row like any other. An empty table gives an empty result; without
any target text T is 0 and all gains follow from the documents. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linededup import LOWER, UPPER, hashes
from .shared import discard, materialize

#: Buckets of features, longest run of words that is one, documents of fewer words are not drawn, percent that is drawn, seed of the noise.
BUCKETS, WIDTH, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def features_of(words: Column, width: int) -> Column:
    """All runs of 1 to ``width`` words."""

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[words[i + k] for k in range(n)]))

    runs = [runs_of(n) for n in range(2, width + 1)]
    none = F.array().cast("array<string>")
    return F.concat(words, *[F.when(F.size(words) >= n, r).otherwise(none) for n, r in enumerate(runs, 2)]) if runs else words


def buckets_of(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """``texts`` (text and others) with n_words and the buckets of the features instead of the text."""
    words = F.transform(F.array(words_of(F.col("text"))), lambda w: F.struct(F.size(w).alias("n_words"), F.transform(features_of(w, width), lambda f: (F.crc32(f) % buckets).cast("int")).alias("buckets")))[0]
    return texts.withColumn("made_", words).select(*[c for c in texts.columns if c != "text"], "made_.n_words", "made_.buckets")


def _held(features: DataFrame, times: Column) -> DataFrame:
    return features.select(times.alias("times"), F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("times").alias("held"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket from (bucket, held) of the corpus and of the target; the bucket table is of a fixed size."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(source.select("bucket", F.col("held").alias("s")), "bucket", "left").join(target.select("bucket", F.col("held").alias("t")), "bucket", "left").na.fill(0)
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, ss, tt = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    gain = F.floor(1000 * F.log((t + 1) * (ss + buckets) / ((s + 1) * (tt + buckets))))
    rows = counts.crossJoin(F.broadcast(sums)).select("bucket", gain.alias("gain")).collect()  # one row of sums, ``buckets`` rows of gains
    return [r.gain for r in sorted(rows)]


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row per row of ``docs``."""
    named = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    different = named.groupBy("text").agg(F.count("*").alias("times"))
    t1, t2 = hashes(F.col("text"))
    features = materialize(buckets_of(different.select("text", t1.alias("t1"), t2.alias("t2"), "times"), buckets, width), "features")
    wanted = buckets_of(target.select(F.col("text").cast("string").alias("text")), buckets, width)
    table = gains(_held(features, F.col("times")), _held(wanted, F.lit(1)), buckets)
    gain = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to one constant array
    weight = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(gain, b))
    weighed = features.select("t1", "t2", F.col("n_words").cast("long").alias("n_words"), F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    rows = named.select("doc_id", t1.alias("t1"), t2.alias("t2"))
    out = materialize(rows.join(weighed, ["t1", "t2"]).select("doc_id", "n_words", "n_features", "weight"), "weights")
    discard(features)
    return out


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): of the documents of enough words, ``percent`` in a hundred have a rank."""
    spark = weighed.sparkSession
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") < min_words).alias("short"))
    order = [F.asc("short"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("tie_")]
    dealt = scored.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(dealt.drop("tie_").withColumn("place_", F.monotonically_increasing_id()), "scores")
    parts = placed.groupBy(F.shiftright("place_", 33).alias("part")).agg(F.count("*").alias("n"), F.count_if(~F.col("short")).alias("able")).collect()  # a row a partition
    before, offsets = 0, []
    for r in sorted(parts):
        offsets.append((r.part, before))
        before += r.n
    drawn = percent * sum(r.able for r in parts) // 100
    offsets = spark.createDataFrame(offsets or [(0, 0)], "part long, before long")
    place = F.col("before") + F.col("place_").bitwiseAND((1 << 33) - 1) + 1
    # As many rows as partitions, whatever they hold.
    joined = placed.withColumn("part", F.shiftright("place_", 33)).join(F.broadcast(offsets), "part", "left")
    return joined.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` drawn towards ``benchmark``: doc_id, n_features, weight, score, rank."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return draw(weigh(docs, target))


ORACLE = f"""
WITH crcs AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
held AS (SELECT r, unnest(words) AS word FROM doc),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS word FROM benchmark),
bucket AS (
  SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(crc[1 + (xor(c, b) & 255)], c >> 8), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS b
  FROM (SELECT word FROM held UNION SELECT word FROM wanted), crcs
),
s AS (SELECT b, count(*) AS s FROM held JOIN bucket USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM wanted JOIN bucket USING (word) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM held) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT b FROM bucket) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
),
weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM held JOIN bucket USING (word) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM doc LEFT JOIN weighed USING (r)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {MIN_WORDS}) // 100 THEN place END AS rank FROM ranked
"""
