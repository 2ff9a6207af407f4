"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A store holds runs: tables of (h, g, n), two 64-bit hashes of a line's key and the number of documents that hold it, bucketed and sorted
by the hashes. A new batch's keys are counted, merge-anti-joined with the runs, which takes out what is settled there (keys that a run
counts in ``min_docs`` documents or more), and what is left becomes a run of level 0. When a level has FANOUT runs they are merged into
one run of the next level, so a store of n batches has O(log n) runs and each count is rewritten as often. Buckets agree between runs and
batches: a batch is shuffled once, by its counts, and runs are never shuffled again to be joined or merged.

A key is a line without white space at its ends, with A-Z in lower case; it is frequent when the runs count it in ``min_docs`` documents
altogether (counts of a settled key stop growing, as its later batches are taken out). Two keys are one only if both hashes agree.

Null and empty texts are one empty line; keys of fewer than MIN_CHARS code points are never frequent; a line that a document repeats counts
once for it; each row is a document, so repeated rows and rows without doc_id count and are answered one by one; very long texts are a row
like any other and work is linear in their lines. An empty table gives an empty result and an empty run. Further columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WRITING, discard, materialize, new_path, settings

#: Documents that make a key frequent, and the least code points of such a key.
MIN_DOCS, MIN_CHARS = 10, 1
#: Runs of a level that are merged into one of the next; batches that the query makes of a table's files.
FANOUT, BATCHES = 4, 8
#: White space that is stripped.
SPACE = " \t\n\x0b\f\r"
#: While a run is written: those of all tables, and runs of one file a bucket are read as sorted, so that a merge sorts the batch alone.
MERGING = WRITING | {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hashes(value: Column) -> list[Column]:
    """Two hashes of different seeds."""
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text and the hashes of its keys by place: null where a key is too short."""

    def both(line: Column) -> Column:
        return F.transform(F.array(key_of(line)), lambda k: F.when(F.char_length(k) >= min_chars, F.struct(*[x.alias(n) for x, n in zip(hashes(k), "hg", strict=True)])))[0]

    return docs.select("doc_id", "text", F.transform(lines_of(F.col("text")), both).alias("keys"))


def counted(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, g, n): in how many of the documents each key stands."""
    each = _keyed(docs, min_chars).select(F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    # The filter holds always; it keeps the optimizer from moving anti-joins below the counts, where a hot key would be many rows.
    return each.groupBy("key.h", "key.g").agg(F.count("*").alias("n")).where("n > 0")


class LineRuns:
    """A store of runs below ``path``; opened again it goes on where its newest manifest left it."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, fanout: int = FANOUT):
        self.spark, self.path, self.min_docs, self.min_chars, self.fanout = spark, path.rstrip("/"), min_docs, min_chars, fanout
        self.version, self.batches, self.runs = 0, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self._exists(f"{self.path}/manifest"):
            newest = spark.read.text(f"{self.path}/manifest/*/part-*").select(F.max_by("value", F.get_json_object("value", "$.version").cast("int"))).first()[0]
            state = json.loads(newest)
            if (state["min_docs"], state["min_chars"]) != (min_docs, min_chars):
                raise ValueError(f"{path} was made for {state['min_docs']} documents and {state['min_chars']} code points")
            self.version, self.batches, self.buckets = state["version"], state["batches"], state["buckets"]
            self.runs = [(level, name) for level, name in state["runs"]]
            for _, name in self.runs:
                self.spark.sql(
                    f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, g BIGINT, n BIGINT) USING parquet CLUSTERED BY (h, g) SORTED BY (h, g) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
                )

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _save(self) -> None:
        self.version += 1
        state = {"version": self.version, "batches": self.batches, "buckets": self.buckets, "runs": self.runs, "min_docs": self.min_docs, "min_chars": self.min_chars}
        self.spark.range(1).select(F.lit(json.dumps(state)).alias("value")).write.mode("overwrite").text(f"{self.path}/manifest/{self.version:09d}")

    def _write(self, counts: DataFrame, tag: str) -> str:
        """One sorted run: each bucket is one file, for rows come dealt by the buckets' own hash."""
        name = f"line_run_{new_path(self.spark, tag).rsplit('-', 1)[1]}"
        with settings(self.spark, MERGING):
            counts.repartition(self.buckets, "h", "g").write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """What no run counts in ``min_docs`` documents: one merge anti-join a run."""
        for _, name in self.runs:
            counts = counts.join(self.run(name).where(F.col("n") >= self.min_docs).hint("merge"), ["h", "g"], "left_anti")
        return counts

    def add(self, docs: DataFrame, batch: str) -> bool:
        """Count a batch of documents in; a batch of a name that is already in is left out, so a repeated call does no harm."""
        if batch in self.batches:
            return False
        self.runs.append((0, self._write(self.unsettled(counted(docs, self.min_chars)), "level0")))
        self.batches.append(batch)
        self._save()
        while level := self._full_level():
            self._compact(*level)
        return True

    def _full_level(self) -> tuple[int, list[str]] | None:
        for level in sorted({r[0] for r in self.runs}):
            names = [n for x, n in self.runs if x == level]
            if len(names) >= self.fanout:
                return level, names
        return None

    def _merged(self, names: list[str]) -> DataFrame:
        # The filter holds always: a union of bare Parquet scans stays columnar, and Spark 4.1 then puts their buckets one after
        # another though it counts on equal buckets in one partition; rows it brings together.
        out, *rest = (self.run(name).where("n > 0") for name in names)
        for run in rest:
            out = out.unionByName(run)
        return out.groupBy("h", "g").agg(F.sum("n").alias("n"))

    def _compact(self, level: int, names: list[str]) -> None:
        self.runs = [r for r in self.runs if r[1] not in names] + [(level + 1, self._write(self._merged(names), f"level{level + 1}"))]
        self._save()
        self._drop(names)  # only once the manifest names them no more

    def _drop(self, names: list[str]) -> None:
        for name in names:
            files = self.run(name)
            discard(files)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def frequent(self) -> DataFrame:
        """(h, g) of the keys that the runs count in ``min_docs`` documents altogether."""
        if not self.runs:
            return self.spark.createDataFrame([], "h long, g long")
        return self._merged([n for _, n in self.runs]).where(F.col("n") >= self.min_docs).select("h", "g")

    def close(self) -> None:
        """Delete the runs; the store is empty after it."""
        self._drop([n for _, n in self.runs])
        self.runs, self.batches = [], []
        self._save()


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), a row per row: the text without the lines whose keys are in ``frequent``.

    Places of such lines are found for each doc_id and text (rows that share both have the same places) and joined back; both joins are
    broadcast by Spark only where the written table is under its threshold, otherwise merged, and a hot key is left to the skew join.
    """
    named = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    t1, t2 = hashes(F.coalesce("text", F.lit("")))
    each = _keyed(named, min_chars).select("doc_id", t1.alias("t1"), t2.alias("t2"), F.posexplode("keys").alias("place", "key")).where("key is not null")
    met = each.select("doc_id", "t1", "t2", "place", F.col("key.h").alias("h"), F.col("key.g").alias("g")).join(frequent, ["h", "g"], "left_semi")
    hits = materialize(met.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("place")).alias("places")), "line-hits")
    hits = hits.select(F.col("doc_id").alias("of"), "t1", "t2", "places")
    split = named.withColumns({"t1": t1, "t2": t2, "n_lines": F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1})
    joined = split.join(hits, [split.t1 == hits.t1, split.t2 == hits.t2, split.doc_id.eqNullSafe(hits.of)], "left").select("doc_id", "text", split.n_lines, "places")
    # What stays between two dropped places is taken line by line: linear in the lines, however many are dropped.
    bounds = F.concat(F.array(F.lit(-1)), F.col("places"), F.array(F.col("n_lines").cast("int")))
    none = F.array().cast("array<string>")
    between = F.transform(
        F.array(F.struct(lines_of(F.col("text")).alias("lines"), bounds.alias("at"))),
        lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.size(s["at"]) - 1), lambda i: F.when(
            s["at"][i] - s["at"][i - 1] > 1, F.transform(F.sequence(s["at"][i - 1] + 1, s["at"][i] - 1), lambda j: s["lines"][j])).otherwise(none))),
    )[0]
    kept = F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(between, "\n"))
    return joined.select("doc_id", kept.alias("text"), F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def batches_of(docs: DataFrame, n: int = BATCHES) -> list[list[str]]:
    """The files behind a table dealt to at most ``n`` batches, each file read once."""
    files = sorted(docs.inputFiles())
    return [files[k::n] for k in range(min(n, len(files)))]


def dedup_table(spark: SparkSession, path: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The lines of a Parquet table counted batch by batch into a store of their own, then the frequent ones dropped."""
    docs = spark.read.parquet(path)
    store = LineRuns(spark, new_path(spark, "line-runs"), min_docs, min_chars)
    for k, files in enumerate(batches_of(docs)):
        store.add(spark.read.schema(docs.schema).parquet(*files), str(k))
    frequent = materialize(store.frequent(), "frequent-lines")
    store.close()
    return drop_lines(docs, frequent, min_chars)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the lines that 10 of them or more hold: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = dedup_table(spark, f"{sf_dir}/documents.parquet")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (SELECT r, line, place, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM each),
frequent AS (SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
marked AS (SELECT r, line, place, key IN (SELECT key FROM frequent) AS gone FROM keyed)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM docs JOIN (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept FROM marked GROUP BY r
) USING (r)
"""
