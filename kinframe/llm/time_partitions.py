"""Adaptive time partitions: a folder of files whose time ranges follow the rows, kept up incrementally.

The moments' years, from the first to the last, are siblings. A node with more than ``most``
rows is split into all its months, days or hours. In time order each sibling of at most
``most`` rows, even an empty one, joins the run of the sibling just before it if the run
stays within ``most``, else it starts one. Runs with rows are leaves, as are hours above
``most`` and the rows without a moment (leaf ``null``). A leaf's rows, in order, fill parts
of ``most`` rows, one Parquet file each: ``<leaf>/part-00001-....parquet``.

Beside the files a store keeps the counts per hour, the leaves, the fingerprints of parts and
the list of files. ``add`` adds the histogram of the late rows to the counts, plans anew only
siblings whose parent has late rows, reads only the files of leaves that change, sorts them
together with the late rows, and writes only parts whose fingerprints differ. A leaf of one
part changes just when its count does, as rows are only ever added; parts of longer leaves
are compared by a fingerprint of all their columns.

What passes the driver or is broadcast is bounded by the method, whatever the number of rows:
if ``most`` is at least the whole table's rows / k, fewer than k nodes of a level are split, so
there are at most 12 k months, 31 k days and 24 k hours, besides the calendar's years. Rows are ordered
within leaves by range partitions, so a leaf of any size is spread; one file is one task's,
as it is to be one file, and is written and read as a stream.

Defined results: moments are compared without a zone; rows with a null moment are in leaf
``null``; null sort columns come first; repeated rows are all kept; rows equal in the sort
columns are ordered by their other columns, so files don't depend on the order of the input;
null ids count as empty strings in ``ids_sha256``; columns may have any names; an empty table
gives no files. Columns of map type can't be ordered and are refused by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinframe.llm._work import delete, fresh_path, put, qualified, tidy

LEVELS = ("year", "month", "day", "hour")
_LEAF = "leaf string, level int, parent long, first long, last long, n long"
_FILE = "leaf string, part long, path string, tail string"
_DIGEST = "key long, columns string, n_rows long, n_new long, ids_sha256 string"


def _hour(moment: Column) -> Column:
    """The hour of a moment as the number yyyymmddhh."""
    return ((F.year(moment).cast("long") * 100 + F.month(moment)) * 100 + F.dayofmonth(moment)) * 100 + F.hour(moment)


def _at(hour: Column, level: int) -> Column:
    """The year, month, day or hour of an hour."""
    return F.floor(hour / F.lit(100 ** (3 - level))).cast("long")


def _name(level: Column, first: Column, last: Column) -> Column:
    """``2005-2007``, ``2024/01-02``, ``2024/03/05-06`` or ``2024/03/05/07-07``."""
    digits = lambda c, width: F.lpad(c.cast("string"), width, "0")
    month = lambda c: F.concat(digits(F.floor(c / 100), 4), F.lit("/"))
    day = lambda c: F.concat(month(F.floor(c / 100)), digits(F.floor(c / 100) % 100, 2), F.lit("/"))
    hour = F.concat(day(F.floor(first / 100)), digits(F.floor(first / 100) % 100, 2), F.lit("/"))
    path = F.when(level == 1, month(first)).when(level == 2, day(first)).when(level == 3, hour).otherwise("")
    two = lambda c: F.when(level == 0, digits(c, 4)).otherwise(digits(c % 100, 2))
    return F.concat(path, two(first), F.lit("-"), two(last))


def runs(siblings: DataFrame, most: int, last_level: bool) -> DataFrame:
    """(parent, first, last, n) of the leaves among siblings (parent, member, n), a fold per parent.

    A sibling above ``most`` ends a run and is a leaf only on the last level.
    """
    kind = "array<struct<first:bigint,last:bigint,n:bigint>>"

    def step(made: Column, x: Column) -> Column:
        before = F.try_element_at(made, F.lit(-1))
        fits = (before["n"] <= most) & (x["n"] <= most) & (before["n"] + x["n"] <= most)
        longer = F.struct(before["first"].alias("first"), x["member"].alias("last"), (before["n"] + x["n"]).alias("n"))
        alone = F.struct(x["member"].alias("first"), x["member"].alias("last"), x["n"].alias("n"))
        return F.when(fits, F.concat(F.slice(made, F.lit(1), F.size(made) - 1), F.array(longer))).otherwise(F.concat(made, F.array(alone))).cast(kind)

    ordered = siblings.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("member", "n"))).alias("all"))
    made = ordered.select("parent", F.inline(F.aggregate("all", F.array().cast(kind), step)))
    return made.where("n > 0" if last_level else f"n > 0 AND n <= {most}")


def _siblings(counts: DataFrame, level: int, most: int, changed: DataFrame | None) -> DataFrame:
    """(parent, member, n): the years, or the children of the nodes above ``most``; only of changed parents, if given."""
    here = counts.where("hour IS NOT NULL").groupBy(_at(F.col("hour"), level).alias("member")).agg(F.sum("n").alias("n"))
    if level == 0:
        nodes = here.agg(F.min("member").alias("a"), F.max("member").alias("b")).where("a IS NOT NULL").select(F.lit(0).cast("long").alias("parent"), F.explode(F.sequence("a", "b")).alias("member"))
    else:
        above = counts.where("hour IS NOT NULL").groupBy(_at(F.col("hour"), level - 1).alias("parent")).agg(F.sum("n").alias("n")).where(F.col("n") > most).select("parent")
        if changed is not None:
            above = above.join(changed.where("hour IS NOT NULL").select(_at(F.col("hour"), level - 1).alias("parent")).distinct(), "parent", "left_semi")
        p = F.col("parent")
        days = F.dayofmonth(F.last_day(F.make_date(F.floor(p / 100).cast("int"), (p % 100).cast("int"), F.lit(1))))
        children = {1: F.sequence(F.lit(1), F.lit(12)), 2: F.sequence(F.lit(1), days), 3: F.sequence(F.lit(0), F.lit(23))}[level]
        nodes = above.select("parent", F.explode(children).alias("i")).select("parent", (p * 100 + F.col("i")).alias("member"))
    return nodes.join(here, "member", "left").select("parent", "member", F.coalesce("n", F.lit(0)).alias("n"))


def plan(counts: DataFrame, most: int, changed: DataFrame | None = None) -> DataFrame:
    """Leaves of counts (hour, n), with the rows without a moment; of changed siblings alone, if ``changed`` counts are given."""
    found = None
    for level in range(len(LEVELS)):
        own = runs(_siblings(counts, level, most, changed), most, level == 3).withColumn("level", F.lit(level))
        found = own if found is None else found.unionByName(own)
    named = found.select(_name(F.col("level"), F.col("first"), F.col("last")).alias("leaf"), "level", "parent", "first", "last", "n")
    nothing = F.lit(None).cast("long")
    unknown = counts.where("hour IS NULL").groupBy().agg(F.sum("n").alias("n")).where("n > 0")
    return named.unionByName(unknown.select(F.lit("null").alias("leaf"), F.lit(-1).alias("level"), nothing.alias("parent"), nothing.alias("first"), nothing.alias("last"), "n"))


class TimePartitions:
    """A store of rows in adaptive time partitions under ``base``.

    ``moment`` gives the time of a row, ``order`` the columns that order rows of one
    moment, ``most`` the rows of a leaf and of a file.
    """

    def __init__(self, spark: SparkSession, schema, moment: Column, order: tuple[str, ...], most: int, base: str | None = None, id_col: str = "click_id") -> None:
        self.spark, self.schema, self.most, self.id_col = spark, schema, most, id_col
        self.moment, self.order = moment.cast("timestamp_ntz"), order
        self.base = qualified(spark, base or fresh_path(spark, "time", keep=True))
        self.version = 0
        self.counts = self.leaves = self.prints = None
        self.files: list[tuple[str, int, str, str]] = []  # one entry per file, so bounded as the leaves are
        self.told: DataFrame | None = None

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return put(df, name, f"{self.base}/state/{self.version}/{name}")

    def add(self, rows: DataFrame, is_new: Column | None = None) -> None:
        """Add rows; the first call makes the layout. The files there stay unless their rows change.

        ``is_new`` tells these rows from those added before (default: all rows count as new).
        """
        self.version += 1
        before, old_leaves, old_prints = self.counts, self.leaves, self.prints
        late = rows.select([F.col(f"`{c}`") for c in self.schema.names])
        histogram = late.groupBy(_hour(self.moment).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
        if before is None:
            self.counts = self._keep(histogram, "counts")
            self.leaves = self._keep(plan(self.counts, self.most), "leaves")
            changed, read = self.leaves, []
        else:
            fresh = self._keep(histogram, "late")
            self.counts = self._keep(before.union(fresh).groupBy("hour").agg(F.sum("n").alias("n")), "counts")
            self.leaves = self._keep(self._replanned(old_leaves, fresh), "leaves")
            same = old_leaves.select("leaf", "n")
            staying = {r.leaf for r in self.leaves.join(same, ["leaf", "n"], "left_semi").select("leaf").collect()}
            changed = self.leaves.join(same, ["leaf", "n"], "left_anti")
            read = [f for f in self.files if f[0] not in staying]
        self._rewrite(late, changed, read, old_prints, F.lit(True) if is_new is None else is_new)

    def _replanned(self, old: DataFrame, fresh: DataFrame) -> DataFrame:
        """The old leaves below parents without late rows, and new ones for all others."""
        touched = None
        for level in range(len(LEVELS)):
            parent = F.lit(0).cast("long") if level == 0 else _at(F.col("hour"), level - 1)
            own = fresh.where("hour IS NOT NULL").select(F.lit(level).alias("level"), parent.alias("parent")).distinct()
            touched = own if touched is None else touched.union(own)
        kept = old.where("level >= 0").join(touched, ["level", "parent"], "left_anti").select(old.columns)
        # the years are planned anew if anything is late at all
        new = plan(self.counts, self.most, fresh).join(touched, ["level", "parent"], "left_semi").select(old.columns)
        unknown = plan(self.counts.where("hour IS NULL"), self.most).where("level = -1").select(old.columns)
        return kept.union(new).union(unknown)

    def _rewrite(self, late: DataFrame, changed: DataFrame, read: list[tuple], old_prints: DataFrame | None, is_new: Column) -> None:
        import uuid

        spark, names = self.spark, [F.col(f"`{c}`") for c in self.schema.names]
        row = F.struct(*names).alias("row")
        rows = late.select(row, self.moment.alias("moment"), F.lit(True).alias("late"))
        if read:
            stored = spark.read.schema(self.schema).parquet(*[f[2] for f in read])
            rows = stored.select(row, self.moment.alias("moment"), F.lit(False).alias("late")).unionByName(rows)
        rows = self._placed(rows, changed)
        whole = rows.where("NOT long").select("row", "moment", "late", "leaf", F.lit(1).cast("long").alias("part"))
        long, prints = self._parts(rows.where("long"))
        self.prints = prints if old_prints is None else self._keep(prints.unionByName(old_prints.join(changed.select("leaf"), "leaf", "left_anti")), "prints")
        staying: set[tuple[str, int]] = set()
        if old_prints is not None:
            again = prints.join(old_prints, ["leaf", "part", "n", "high", "low", "other"], "left_semi")
            staying = {(r.leaf, r.part) for r in again.select("leaf", "part").collect()}
            long = long.join(F.broadcast(again.select("leaf", "part")), ["leaf", "part"], "left_anti")  # as many as there are files
        file = "file"
        while file in {c.lower() for c in self.schema.names}:
            file += "_"
        both = whole.unionByName(long.select(whole.columns)).withColumn("key", F.concat(F.translate("leaf", "/", "_"), F.lit("."), F.col("part")))
        ordered = both.repartition("key").sortWithinPartitions("key", "moment", *self._ordering())
        stage = f"{self.base}/stage/{self.version}"
        ordered.select(F.col("key").alias(file), "row.*").write.partitionBy(file).parquet(stage)

        path = spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())
        run, made = uuid.uuid4().hex[:12], []
        for status in store.globStatus(path(f"{stage}/{file}=*/*.parquet")) or []:
            leaf, _, part = status.getPath().getParent().getName().partition("=")[2].rpartition(".")
            leaf = leaf.replace("_", "/")
            tail = f"{leaf}/part-{int(part):05d}-{run}.parquet"
            to = path(f"{self.base}/data/{tail}")
            store.mkdirs(to.getParent())
            if not store.rename(status.getPath(), to):
                raise OSError(f"can't move {status.getPath()} to {to}")
            made.append((leaf, int(part), f"{self.base}/data/{tail}", tail))
        delete(spark, stage)
        gone = {f[:2] for f in read} - staying
        kept = [f for f in self.files if f[:2] not in gone]
        for f in self.files:
            if f[:2] in gone:
                store.delete(path(f[2]), False)
        self.files = kept + made
        self._tell(made, kept, is_new)

    def _ordering(self) -> list[str]:
        own = list(dict.fromkeys([*self.order, *self.schema.names]))
        return [f"row.`{c}`" for c in own]

    def _placed(self, rows: DataFrame, leaves: DataFrame) -> DataFrame:
        """Rows with their leaf among the given ones, and whether it has several parts."""
        hour = _hour(F.col("moment"))
        for level in range(len(LEVELS)):
            own = leaves.where(F.col("level") == level).select(F.explode(F.sequence("first", "last")).alias(f"at{level}"), F.struct("leaf", (F.col("n") > self.most).alias("long")).alias(f"leaf{level}"))
            rows = rows.withColumn(f"at{level}", _at(hour, level)).join(F.broadcast(own), f"at{level}", "left")  # bounded by the method
        unknown = F.broadcast(leaves.where("level = -1").select((F.col("n") > self.most).alias("many")))  # one row at most
        found = rows.withColumn("found", F.coalesce(*(f"leaf{level}" for level in range(len(LEVELS))))).join(unknown, F.col("moment").isNull(), "left")
        leaf = F.when(F.col("moment").isNull(), "null").otherwise(F.col("found.leaf"))
        long = F.when(F.col("moment").isNull(), F.col("many")).otherwise(F.col("found.long"))
        return found.select("row", "moment", "late", leaf.alias("leaf"), long.alias("long"))

    def _parts(self, long: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of leaves above ``most`` with their parts, and the parts' fingerprints (leaf, part, n, high, low, other)."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        tie = F.xxhash64(F.monotonically_increasing_id())  # spreads rows that are equal in all columns
        keys = ["leaf", "moment", *self._ordering(), "tie"]
        dealt = long.withColumn("tie", tie).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie", "long")
        dealt = self._keep(dealt.withColumn("dealt", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "long")
        stretch = dealt.groupBy("leaf", "dealt").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
        own = Window.partitionBy("leaf").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
        stretch = stretch.select("leaf", "dealt", (F.coalesce(F.sum("n").over(own), F.lit(0)) - F.col("low")).alias("shift"))
        ranked = dealt.join(stretch, ["leaf", "dealt"]).withColumn("part", F.floor((F.col("at") + F.col("shift")) / self.most) + 1)
        h = F.xxhash64(*(f"row.`{c}`" for c in self.schema.names))
        marked = ranked.withColumn("h", h)
        prints = marked.groupBy("leaf", "part").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("other"),
        )
        return ranked, self._keep(prints, "part-prints")

    def _tell(self, made: list[tuple], kept: list[tuple], is_new: Column) -> None:
        """The report of the files: new ones are read back in file order, the others as told before."""
        spark = self.spark
        before = self.told
        files = spark.createDataFrame(made, _FILE)
        if made:
            digests = _digests(spark.read.schema(self.schema).parquet(*[f[2] for f in made]), self.id_col, is_new)
        else:
            digests = spark.createDataFrame([], _DIGEST)
        told = files.withColumn("key", F.xxhash64("tail")).join(digests, "key").select("leaf", "columns", "ids_sha256", "path", "part", "n_rows", "n_new", F.lit(True).alias("rewritten"))
        if before is not None:
            stay = spark.createDataFrame(kept, _FILE).select("path")
            told = told.unionByName(before.join(stay, "path", "left_semi").withColumns({"n_new": F.lit(0).cast("long"), "rewritten": F.lit(False)}).select(told.columns))
        self.told = self._keep(told, "files")

    def report(self) -> DataFrame:
        """Per file: leaf, columns, ids_sha256, path, part, n_rows, n_new (rows of the last call) and rewritten."""
        return self.told


def _digests(stored: DataFrame, id_col: str, is_new: Column) -> DataFrame:
    """(key, columns, n_rows, n_new, ids_sha256) per file, whose ids are streamed in file order."""
    import pyarrow as pa

    columns = ",".join(c for c in stored.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key, n, new, digest = None, 0, 0, None
        out: list[tuple] = []
        for batch in batches:
            keys, ids, fresh = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if digest is None or keys[lo] != key:
                    if digest is not None:
                        out.append((key, columns, n, new, digest.hexdigest()))
                    key, n, new, digest = int(keys[lo]), 0, 0, hashlib.sha256()
                digest.update(("," * (n > 0) + ",".join(["" if x is None else str(x) for x in ids[lo:hi]])).encode())
                n, new = n + hi - lo, new + int(fresh[lo:hi].sum())
        if digest is not None:
            out.append((key, columns, n, new, digest.hexdigest()))
        values = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(values, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "columns", "n_rows", "n_new", "ids_sha256"])

    tail = F.substring_index(F.col("_metadata.file_path"), "/data/", -1)
    ids = stored.select(F.xxhash64(tail).alias("key"), F.col(f"`{id_col}`").alias("id"), F.col("_metadata.row_index").alias("at"), F.coalesce(is_new, F.lit(False)).alias("fresh"))
    ordered = ids.repartition("key").sortWithinPartitions("key", "at").select("key", "id", "fresh")
    return ordered.mapInArrow(tidy(run), _DIGEST)


def shifted_moment(ts: Column, id_col: Column) -> Column:
    """``ts``, moved back (k+6)**3 days if k < 16, floored to Monday 00:00 if k > 111; k = crc32(id as text) mod 128."""
    k = F.crc32(id_col.cast("string").cast("binary")) % 128
    ts = ts.cast("timestamp_ntz")
    back = ((k + 6) * (k + 6) * (k + 6)).cast("int")
    day = F.to_date(ts)
    monday = F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")
    return F.when(k < 16, ts - F.make_dt_interval(days=back)).when(k > 111, monday).otherwise(ts)


def clicks_in_time(clicks: DataFrame, share: int = 650, until: str = "2024-03-01 00:00:00", base: str | None = None) -> DataFrame:
    """The rows that arrived before ``until`` as a new store, then all rows; one row per final file.

    Leaves and files hold at most 1 + floor(rows / ``share``) rows.
    """
    most = 1 + clicks.count() // share
    early = F.coalesce(F.col("arrived_at").cast("timestamp_ntz") < F.lit(until).cast("timestamp_ntz"), F.lit(False))
    store = TimePartitions(clicks.sparkSession, clicks.schema, shifted_moment(F.col("ts"), F.col("click_id")), ("arrived_at", "click_id"), most, base)
    store.add(clicks.where(early))
    store.add(clicks.where(~early), is_new=~early)
    return store.report()
