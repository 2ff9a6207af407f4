"""A training-corpus pipeline made of the operators in ``palimpsest.llm``.

Each stage takes what its predecessor kept and gives a table; all but the last give the columns of ``documents``.

1. quality: documents that the classifier rejects go (learned from ``labels`` whose CRC modulo 5 is not 0).
2. near_duplicates: of each group one document stays, that with the smallest doc_id, and of rows with its id and text
   one; rows without doc_id stay, but of those of equal text one.
3. repeats: passages of more than 50 words or of 400 bytes whose strings of 101 bytes (51 words have no fewer) all stand
   twice or more are cut out, characters cut in two go whole; documents stay even if nothing is left, and n_chars
   follows the text.
4. decontaminate: documents in which a window of ``benchmark`` occurs go.
5. tokens: ids, their number and the digests of ids and decoded bytes of each document.

Null and empty texts pass all stages as empty texts; empty tables give empty tables; further columns are kept. Very long texts pass whole. Ties: of
near duplicates the smallest doc_id stays, of repeated rows one; a score at the classifier's threshold is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontaminate, minhash, quality, suffixes
from palimpsest.llm.shared import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learned_from(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    # Ids that stand more than once: their rows alone are brought together, pre-aggregated by id and text.
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", F.lit(True).alias("again"))
    if again.isEmpty():
        return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    left = docs.join(others, "doc_id", "left_anti").join(again.select(F.col("doc_id").alias("id_"), "again"), F.col("doc_id").eqNullSafe(F.col("id_")), "left")
    rest = [F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")]
    one = left.where("again").groupBy(F.col("doc_id").alias("id_"), F.xxhash64("text").alias("th_"), F.col("text").alias("text_")).agg(*rest).select("row.*")
    return left.where("again is null").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffixes.drop_repeats(docs, suffixes.PASSAGE_BYTES)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *bpe.vocabulary())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("repeats", cut_repeats),
    ("decontaminate", keep_unleaked),
    ("tokens", tokenize),
]

#: A fitted network and a tokenizer's merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
