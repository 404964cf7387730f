"""As-of links: the last row before this one with a wanted level or header.

With ``stretch`` a source of any length is shared by many tasks: positions (then whole
numbers) are cut into stretches of so many, windows look no further than their stretch,
and the last value of each stretch, one row per stretch, is carried to the later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a stretch where readers cut their sources.
STRETCH = 1 << 20


def last_seen(rows: DataFrame, value: Column, keys: list[str], position: str, name: str, to: int = 0, stretch: int | None = STRETCH) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` of the same keys, up to the row ``to`` places off.

    A scan in segments: windows look no further than a stretch of positions, and the last value
    of each stretch is carried to the later ones, so the rows of one source are shared by tasks.
    Null keys are a source of their own; rows without a position come before all others.
    """
    placed = rows.withColumn("_told", value).withColumn("_at", F.coalesce(F.col(position), F.lit(-(2**40))))
    return _last_before(placed, "_told", keys, "_at", to, stretch).drop("_told", "_at").withColumnRenamed("_seen", name)


def _last_before(rows: DataFrame, value: str, keys: list[str], position: str, to: int, stretch: int | None) -> DataFrame:
    """Adds ``_seen``: the last non-null value of the same keys, up to the row ``to`` places off."""
    if stretch is None:
        w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, to)
        return rows.withColumn("_seen", F.last(value, ignorenulls=True).over(w))
    cut = rows.withColumn("_s", F.floor(F.col(position) / stretch))
    here = Window.partitionBy(*keys, "_s").orderBy(position).rowsBetween(Window.unboundedPreceding, to)
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    lasts = cut.groupBy(*keys, "_s").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_v"))
    carried = lasts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_s").alias("_t"), F.last("_v", ignorenulls=True).over(before).alias("_carried"))
    same = F.col("_s") == F.col("_t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = cut.withColumn("_seen", F.last(value, ignorenulls=True).over(here)).join(carried, same)
    return found.withColumn("_seen", F.coalesce("_seen", "_carried")).drop("_s", "_t", "_carried", *(f"_k{i}" for i in range(len(keys))))


def asof_parent(rows: DataFrame, source: str = "src", position: str = "pos", level: str = "gen", key: str = "key", stretch: int | None = None) -> DataFrame:
    """Link each row to the last earlier row of the level below, in the same source.

    Adds ``child_key``. Each row is a definition at its level and a lookup one level
    down, so a window per (source, level) finds the link with one shuffle; stale rows
    of a level stay visible, as nothing ever clears them.
    """
    either = F.array(F.struct(F.col(level).alias("lvl"), F.col(key).alias("told")), F.struct((F.col(level) - 1).alias("lvl"), F.lit(None).cast(dict(rows.dtypes)[key]).alias("told")))
    both = rows.withColumn("_l", F.explode(either))
    both = both.withColumns({"_lvl": F.col("_l.lvl"), "_told": F.col("_l.told")}).drop("_l")
    linked = _last_before(both, "_told", [source, "_lvl"], position, -1, stretch)
    linked = linked.where(F.col("_lvl") == F.col(level) - 1).withColumnRenamed("_seen", "child_key").drop("_lvl", "_told")
    return linked.withColumn("child_key", F.when((F.col(level) > 1) & (F.col("child_key") != F.col(key)), F.col("child_key")))


def asof_header(rows: DataFrame, value: Column, source: str = "src", position: str = "pos", name: str = "header", stretch: int | None = None) -> DataFrame:
    """The value of the last header at or before each row (``value`` is null elsewhere)."""
    return _last_before(rows.withColumn("_told", value), "_told", [source], position, 0, stretch).drop("_told").withColumnRenamed("_seen", name)
