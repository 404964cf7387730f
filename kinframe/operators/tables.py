"""Shared helpers: cutting lineage in loops, and order-aware aggregates."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only in local mode, where it may be unset, is an own one made and set. A folder
    without a scheme is on the default file system.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kinframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, merged: bool = True) -> DataFrame:
    """``df`` as a table in the shared folder.

    A written table survives lost executors and is computed once. Joins with it are merged,
    so that no round of a loop sends it to the driver; only with ``merged=False`` may those
    choose to broadcast it by its size. Loops delete those that they no longer read
    (``drop``); the others are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/kinframe-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.hint("merge") if merged else out
    out._written_to = path
    return out


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The same, with the number of rows, which is counted as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)
        _written.remove((df.sparkSession, df._written_to))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone with its files' owner
            return


def filled(c: Column) -> Column:
    """Null for the empty string: both mean unknown in texts."""
    return F.when(c != "", c)


def first_known(value: Column, order: Column) -> Column:
    """Aggregate: the first non-null, non-empty value in an explicit order."""
    return F.min_by(value, F.when(value.isNotNull(), order))
