"""Incremental ingest: a stream of outline files merged into a master table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinframe.operators import merge
from kinframe.operators.outline import clean, collapse, edges_of, keyed, stitch, titled
from kinframe.sources.lines import split_lines


def merge_batch(master: tuple[DataFrame, DataFrame] | None, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Master nodes and edges (by key) with the outlines of a batch merged in; least generations."""
    people = keyed(clean(stitch(lines)))
    nodes, edges = titled(collapse(people)).drop("first_seen"), edges_of(people)
    if master is None:
        merged, all_edges = nodes, edges
    else:
        both = master[0].withColumn("file_ord", F.lit(0)).unionByName(nodes.withColumn("file_ord", F.lit(1)), allowMissingColumns=True)
        merged, all_edges = titled(merge.merge_nodes(both, gen="min")), master[1].unionByName(edges).distinct()
    folded, remap = merge.fold_yearless(merged)
    return folded, merge.remap_edges(all_edges, remap)


def _versions(spark: SparkSession, master: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(master)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{master}/{n}/edges/_SUCCESS"))]
    return sorted(done)


def read_master(spark: SparkSession, master: str) -> tuple[DataFrame, DataFrame] | None:
    """The latest complete version of the master, or None."""
    done = _versions(spark, master)
    if not done:
        return None
    return spark.read.parquet(f"{master}/v{done[-1]}/nodes"), spark.read.parquet(f"{master}/v{done[-1]}/edges")


def write_batch(lines: DataFrame, batch_id: int, master: str) -> None:
    """Write version ``batch_id + 1`` of the master. A repeated batch rewrites its own version."""
    spark = lines.sparkSession
    done = [v for v in _versions(spark, master) if v <= batch_id]
    before = (spark.read.parquet(f"{master}/v{done[-1]}/nodes"), spark.read.parquet(f"{master}/v{done[-1]}/edges")) if done else None
    nodes, edges = merge_batch(before, lines)
    nodes.write.mode("overwrite").parquet(f"{master}/v{batch_id + 1}/nodes")
    edges.write.mode("overwrite").parquet(f"{master}/v{batch_id + 1}/edges")


def ingest(spark: SparkSession, folder: str, master: str, checkpoint: str) -> StreamingQuery:
    """Process the files that are new in a folder once; the checkpoint is the manifest."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("src"), "value")
    step = lambda batch, n: write_batch(split_lines(batch), n, master)
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
