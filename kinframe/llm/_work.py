"""Shared-folder tables and small helpers used by the operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes that a worker handles at once. Spark itself bounds the bytes of the batches
#: it sends (spark.sql.execution.arrow.maxBytesPerBatch); no setting stays changed.
PIECE_ROWS = 512
PIECE_BYTES = 4 << 20

_made: list[tuple[SparkSession, str]] = []


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; a path without one is on Hadoop's default file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where it may be unset, is an own folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kinframe-")
        spark.conf.set("spark.checkpoint.dir", base)
        _made.append((spark, base))
    return qualified(spark, base.rstrip("/"))


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; what is there is deleted when the driver ends unless ``keep``."""
    path = f"{work_dir(spark)}/kinframe-{uuid.uuid4().hex}/{name}"
    if not keep:
        _made.append((spark, path))
    return path


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Short batches for what is planned and run inside, to spare executors' memory; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(PIECE_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def put(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    with short_batches(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``put`` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._written_to)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def marks(df: DataFrame, name: str) -> DataFrame:
    """(mark_at, mark_bits): the hashes of a column of ids in 2^24 bits, 64 in a row.

    It has 2^18 rows at most, whatever the size of ``df``, so it may be broadcast.
    """
    at, bit = _mark(name)
    return df.select(at.alias("mark_at"), bit.alias("bit")).groupBy("mark_at").agg(F.bit_or("bit").alias("mark_bits"))


def among(df: DataFrame, name: str, told: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose value may be among those that ``marks`` was made of; by ``left_anti`` those whose value isn't.

    Rows that share a mark by chance come along, so a join has to follow; what surely has no
    match needn't be shuffled for it.
    """
    at, bit = _mark(name)
    return df.join(F.broadcast(told), (at == F.col("mark_at")) & (bit.bitwiseAND(F.col("mark_bits")) != 0), how)


def _mark(name: str) -> tuple[Column, Column]:
    value = f"xxhash64(cast({name} AS bigint))"  # alike for whole numbers of any type
    return F.expr(f"shiftrightunsigned({value}, 6) & {(1 << 18) - 1}L"), F.expr(f"shiftleft(1L, cast({value} & 63 AS int))")


def pieces(batches: Iterator) -> Iterator:
    """The batches in pieces of at most ``PIECE_ROWS`` rows and about ``PIECE_BYTES`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            yield batch
            continue
        todo = [(lo, min(PIECE_ROWS, n - lo)) for lo in range(0, n, PIECE_ROWS)][::-1]
        while todo:
            lo, many = todo.pop()
            piece = batch.slice(lo, many)
            if many > 1 and piece.nbytes > PIECE_BYTES:
                half = many // 2
                todo += [(lo + half, many - half), (lo, half)]
            else:
                yield piece


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, over pieces; at its end the worker gives unused memory back to the system."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(pieces(batches))
        finally:
            _release()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for applyInArrow, after groups that held much."""

    def wrapped(group):
        out = run(group)
        if group.nbytes > 4 << 20:
            _release()
        return out

    return wrapped


def _release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session is gone with its files' owner
            return
