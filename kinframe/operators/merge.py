"""Merging graphs of several sources: keyed reduction, twins, offsets, anchors, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions import rules
from kinframe.operators.tables import cut, filled, first_known


def _text(c: str, order: Column) -> Column:
    return F.coalesce(first_known(filled(F.col(c)), order), F.lit("")).alias(c)


def merge_nodes(nodes: DataFrame, gen: str = "first") -> DataFrame:
    """Nodes of all files (file_ord, key, ...) as one node per key, left to right.

    ``gen``: ``first`` keeps the generation of the first file, ``min`` the least one.
    """
    order = F.col("file_ord")
    return nodes.groupBy("key").agg(
        F.min_by("name", order).alias("name"),
        (F.min_by("gen", order) if gen == "first" else F.min("gen")).alias("gen"),
        first_known(F.col("birth"), order).alias("birth"),
        first_known(F.col("death"), order).alias("death"),
        *(_text(c, order) for c in ("country", "region", "house") if c in nodes.columns),
        F.sum("mult").alias("mult"),
    )


def backfill(nodes: DataFrame) -> DataFrame:
    """Missing category, house and region from the name; known typos of categories repaired."""
    typos = F.create_map(*(F.lit(x) for pair in rules.CATEGORY_TYPOS.items() for x in pair))
    cat = F.coalesce(F.try_element_at(typos, F.col("cat")), F.col("cat"))
    cat = F.when(cat.isNull() | cat.isin("", "untitled"), rules.classify_wide(F.col("name"))).otherwise(cat)
    return nodes.withColumns({
        "cat": cat,
        "house": F.coalesce(filled(F.col("house")), rules.house_of(F.col("name"))),
        "region": F.coalesce(filled(F.col("region")), rules.region_of(F.col("name"))),
    })


def anchored_merge(nodes: DataFrame, anchor: str) -> DataFrame:
    """One node per key; the generation of the anchor source is final, else the least.

    A category other than untitled wins; the sources of a node are gathered.
    """
    order = F.col("file_ord")
    mine = F.col("source") == anchor
    return nodes.groupBy("key").agg(
        F.min_by("name", order).alias("name"),
        F.coalesce(F.min(F.when(mine, F.col("gen"))), F.min("gen")).alias("gen"),
        first_known(F.col("birth"), order).alias("birth"),
        F.coalesce(F.min_by("cat", F.when(F.col("cat") != "untitled", order)), F.lit("untitled")).alias("cat"),
        _text("house", order),
        F.sum("mult").alias("mult"),
        F.sort_array(F.collect_set("source")).alias("sources"),
    )


def fold_yearless(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold ``name|?`` into the ``name|year`` node with the highest count (smallest key on ties).

    Returns nodes and the remap (dup, canon) of keys for the edges.
    """
    mergeable, yearless = ~F.col("key").startswith("_u"), F.col("key").endswith("|?")
    # a window, not a join with the groups' best: what the nodes are made of is worked out once
    group = Window.partitionBy(F.when(mergeable, F.regexp_extract("key", r"^(.*)\|", 1)), F.when(~mergeable, F.col("key")))
    best = F.min_by("key", F.when(mergeable & ~yearless, F.struct(-F.col("mult"), "key"))).over(group)
    named = nodes.withColumn("canon", F.when(mergeable & yearless, best))
    remap = named.where("canon IS NOT NULL").select(F.col("key").alias("dup"), "canon")
    pointed = named.withColumn("to", F.coalesce("canon", "key"))
    own = F.when(F.col("key") == F.col("to"), F.lit(0)).otherwise(1)
    fixed = [c for c in nodes.columns if c not in ("key", "mult", "gen", "birth", "death")]
    folded = pointed.groupBy("to").agg(
        *(F.min_by(c, own).alias(c) for c in fixed), F.min("gen").alias("gen"), first_known(F.col("birth"), own).alias("birth"), first_known(F.col("death"), own).alias("death"), F.sum("mult").alias("mult"),
    ).withColumnRenamed("to", "key")
    return folded.select(nodes.columns), remap


def remap_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with replaced ends; loops dropped, edges distinct."""
    for end in ("s", "t"):
        edges = edges.join(remap.withColumnRenamed("dup", end), end, "left").withColumn(end, F.coalesce("canon", end)).drop("canon")
    return edges.where("s <> t").select("s", "t").distinct()


def anchor_offsets(base: DataFrame, others: DataFrame) -> DataFrame:
    """(file_ord, offset): shift that aligns each file with the base by a shared person.

    The shared name with the least generation in the base decides (smallest name on ties).
    """
    shared = others.select("file_ord", "key", F.col("gen").alias("own")).join(base.groupBy("key").agg(F.min("gen").alias("gen")), "key")
    return shared.groupBy("file_ord").agg(F.min_by(F.col("gen") - F.col("own"), F.struct("gen", "key", "own")).alias("offset"))


def merge_files(files: list[DataFrame]) -> DataFrame:
    """Left-to-right merge of node tables whose generations are aligned one after another.

    The offset of a file depends on what was merged before, so this is a loop over
    files; each step is a join and a grouping. The least generation becomes 0.
    """
    merged = files[0].withColumn("file_ord", F.lit(0))
    for k, more in enumerate(files[1:], 1):
        new = more.withColumn("file_ord", F.lit(k))
        offset = anchor_offsets(merged, new)
        new = new.join(F.broadcast(offset), "file_ord", "left").withColumn("gen", F.col("gen") + F.coalesce("offset", F.lit(0))).drop("offset")  # one row
        merged = cut(merge_nodes(merged.unionByName(new, allowMissingColumns=True)).withColumn("file_ord", F.lit(0)))
    return align(merged.drop("file_ord"))


def align(nodes: DataFrame, least: int = 0) -> DataFrame:
    """Generations shifted so that the least is ``least``."""
    low = nodes.agg(F.min("gen").alias("low"))
    return nodes.crossJoin(F.broadcast(low)).withColumn("gen", F.col("gen") - F.col("low") + least).drop("low")  # one row


def union_on_subject(paternal: tuple[DataFrame, DataFrame], maternal: tuple[DataFrame, DataFrame], subject: int = 0, gap: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Two graphs joined at the subject; the other ids of the second are moved past the first."""
    top = paternal[0].agg((F.max("id") + gap).alias("shift"))
    moved = lambda df, c: df.crossJoin(F.broadcast(top)).withColumn(c, F.when(F.col(c) == subject, F.col(c)).otherwise(F.col(c) + F.col("shift"))).drop("shift")  # noqa: E731  one row
    nodes = paternal[0].unionByName(moved(maternal[0], "id").where(F.col("id") != subject), allowMissingColumns=True)
    edges = paternal[1].select("s", "t").unionByName(moved(moved(maternal[1].select("s", "t"), "s"), "t")).distinct()
    return nodes, edges


def shared_nodes(nodes: DataFrame, most: int = 20) -> DataFrame:
    """Report of people found more than once, nearest generations first."""
    return nodes.where("mult > 1").orderBy("gen", "name").limit(most)


def increment(known: DataFrame, batch: DataFrame) -> DataFrame:
    """New and known keys of a batch: (key, is_new)."""
    return batch.select("key").distinct().join(known.select("key", F.lit(False).alias("seen")), "key", "left").select("key", F.col("seen").isNull().alias("is_new"))


def cap_per_group(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
