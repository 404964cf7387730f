"""A master of hash buckets: a batch rewrites only the buckets that it touches, in one atomic step.

Every table of a master is dealt into a fixed number of buckets. A commit reads the buckets
that a batch has rows for, merges them with the batch, and writes them to a folder of its own;
then a manifest (one small JSON file per version: the folders of each table's buckets) is put in
place by a rename. Readers take the newest manifest, so they see all tables of a version or
none: a batch that is killed before the rename leaves the last version as it was. A batch that
is run again finds its number in the manifest and does nothing.

A manifest has an entry per bucket, whatever the number of rows; choose the buckets so that one
of them is a file or a few.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.operators import merge
from kinframe.operators.outline import clean, collapse, edges_of, keyed, stitch, titled
from kinframe.operators.tables import cut, drop
from kinframe.sources.lines import split_lines

BUCKETS = 64
_BUCKET = "_bucket"


class Change(NamedTuple):
    """Rows of a batch, the column that decides their bucket, and how they are merged with those there."""

    rows: DataFrame
    by: Column
    merge: Callable[[DataFrame, DataFrame], DataFrame]


class BucketStore:
    """Versions of a master under ``path``; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where = self._path(f"{self.path}/manifest")
        if not self.files.exists(where):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the newest: batch, buckets, tables {name: {bucket: folder}}, schemas."""
        known = self.versions()
        if not known:
            return None
        stream = self.files.open(self._path(f"{self.path}/manifest/{known[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        found = self.manifest(version)
        return self._read(found, table) if found else None

    def _read(self, found: dict, table: str, only: list[int] | None = None) -> DataFrame | None:
        schema = found["schemas"].get(table)
        if schema is None:
            return None
        folders = [f"{self.path}/{folder}" for b, folder in found["tables"][table].items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def commit(self, batch: int, changes: dict[str, Change]) -> list[str]:
        """Merge a batch's changes and make them the newest version; the folders that were written."""
        found = self.manifest() or {"batch": -1, "buckets": self.buckets, "tables": {}, "schemas": {}}
        if batch <= found["batch"]:
            return []
        if found["buckets"] != self.buckets:
            raise ValueError(f"the master has {found['buckets']} buckets")
        home = f"data/{batch}-{uuid.uuid4().hex[:12]}"
        made = []
        for table, change in changes.items():
            name = "_" + table
            rows = cut(change.rows.withColumn(_BUCKET, F.pmod(F.xxhash64(change.by), F.lit(self.buckets)).cast("int")))
            touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())  # at most as many as there are buckets
            if not touched:
                continue
            there = self._read(found, table, touched)
            new = rows.drop(_BUCKET)
            merged = new if there is None else change.merge(there, new)
            # rows keep their bucket, as merging doesn't change what decides it
            dealt = merged.withColumn(_BUCKET, F.pmod(F.xxhash64(change.by), F.lit(self.buckets)).cast("int"))
            dealt.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{home}/{name}")
            folders = found["tables"].setdefault(table, {})
            for b in touched:
                folder = f"{home}/{name}/{_BUCKET}={b}"
                if self.files.exists(self._path(f"{self.path}/{folder}")):
                    folders[str(b)] = folder
                    made.append(folder)
                else:
                    folders.pop(str(b), None)
            found["schemas"][table] = ", ".join(f"`{c}` {kind}" for c, kind in merged.dtypes)
            drop(rows)
        known = self.versions()
        self._swap((known[-1] if known else 0) + 1, found | {"batch": batch})
        return made

    def _swap(self, version: int, found: dict) -> None:
        to = self._path(f"{self.path}/manifest/{version}.json")
        at = self._path(f"{self.path}/manifest/.{version}-{uuid.uuid4().hex}")
        out = self.files.create(at, False)
        try:
            out.write(bytearray(json.dumps(found).encode()))
        finally:
            out.close()
        if self.files.exists(to) or not self.files.rename(at, to):
            raise RuntimeError(f"version {version} of {self.path} was written by another")

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the newest ``keep``, and folders that these don't name; the number of folders deleted."""
        known = self.versions()
        used = set()
        for v in known[-keep:]:
            for folders in self.manifest(v)["tables"].values():
                used |= set(folders.values())
        for v in known[:-keep]:
            self.files.delete(self._path(f"{self.path}/manifest/{v}.json"), False)
        gone = 0
        for status in self.files.globStatus(self._path(f"{self.path}/data/*/*/{_BUCKET}=*")) or []:
            parts = status.getPath().toString().split("/")
            if "/".join(parts[-4:]) not in used:
                self.files.delete(status.getPath(), True)
                gone += 1
        return gone


# ---- the master of outlines -------------------------------------------------


def _prefix() -> Column:
    """A person's name in a key: ``name|?`` and ``name|year`` are in one bucket."""
    return F.regexp_extract("key", r"^(.*)\|", 1)


def merge_into(store: BucketStore, lines: DataFrame, batch: int) -> list[str]:
    """Merge the outlines of a batch into a master; the folders that were written.

    Nodes are kept by their own keys and edges between those, as later batches may bring the
    years that a key lacks; ``read_merged`` folds them.
    """
    people = cut(keyed(clean(stitch(lines))))
    nodes = collapse(people).drop("first_seen")
    least = lambda a, b: merge.merge_nodes(a.withColumn("file_ord", F.lit(0)).unionByName(b.withColumn("file_ord", F.lit(1))), gen="min").select(nodes.columns)
    made = store.commit(batch, {
        "nodes": Change(nodes, _prefix(), least),
        "edges": Change(edges_of(people), F.col("s"), lambda a, b: a.unionByName(b).distinct()),
    })
    drop(people)
    return made


def read_merged(store: BucketStore, version: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Nodes (titled, without years folded) and edges of a version, as ``merge_batch`` has them; None before the first."""
    found = store.manifest(version)
    if found is None or "nodes" not in found["schemas"]:
        return None
    nodes, edges = store._read(found, "nodes"), store._read(found, "edges")
    folded, remap = merge.fold_yearless(titled(nodes))
    if edges is None:
        edges = store.spark.createDataFrame([], "s string, t string")
    return folded, merge.remap_edges(edges, remap)


def ingest_buckets(spark: SparkSession, folder: str, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Process the files that are new in a folder once, each batch as one version of the master."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("src"), "value")

    def step(batch: DataFrame, n: int) -> None:
        merge_into(BucketStore(spark, path, buckets), split_lines(batch), n)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
