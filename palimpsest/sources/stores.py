"""Tables kept in a shared folder: made once, or step by step, so that a run that was stopped goes on where it was."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the one named by ``spark.checkpoint.dir``; a local session that names none is given one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/palimpsest/{tag}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    files, where = _files(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def once(path: str, make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The table at ``path``, made and written if it is not there whole."""
    if not whole(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def numbered(spark: SparkSession, path: str, name: str = "step") -> list[int]:
    """The numbers of the whole tables ``name=number`` below ``path``."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    found = sorted(int(m[1]) for m in (re.fullmatch(rf"{name}=(\d+)", n) for n in names) if m)
    return [k for k in found if whole(spark, f"{path}/{name}={k}")]


def read_steps(spark: SparkSession, path: str, steps: list[int], name: str = "step") -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[f"{path}/{name}={k}" for k in steps])


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a new folder and read back, so that what reads it twice makes it once."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(path: str, rows: DataFrame, key: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make`` of each key's rows, once ever: what the folder holds already is not made again, what is new is a step of its own.

    ``make`` must give a row at least for each key; keys without one are made again by the next call. ``rows`` is read once.
    """
    spark = rows.sparkSession
    steps = numbered(spark, path)
    todo = rows.join(read_steps(spark, path, steps).select(*key).distinct(), key, "left_anti") if steps else rows
    new = steps[-1] + 1 if steps else 0
    make(todo).write.mode("overwrite").parquet(f"{path}/step={new}")
    if steps and read_steps(spark, path, [new]).isEmpty():  # nothing was new
        files, where = _files(spark, f"{path}/step={new}")
        files.delete(where, True)
    else:
        steps.append(new)
    return read_steps(spark, path, steps).drop("step")
