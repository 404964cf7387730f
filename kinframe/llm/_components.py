"""Distributed connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm._work import delete, fresh_path, put


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every end of an edge.

    In each round every vertex hooks onto the neighbour (or itself) whose hash is
    least, edges are rewritten between the hooks and duplicates dropped, until no
    edge is left; a star goes in one round, a path in O(log n) expected. Hooks are
    minima with partial aggregation and joins that adaptive execution can split, so
    one vertex may hold any share of the edges. Rounds are cut by written tables.
    """
    spark = edges.sparkSession
    edges = put(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    levels: list[DataFrame] = []
    spent: list[str] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        hook = F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("id")))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("id"))
        hooks = put(both.groupBy("u").agg(hook.alias("m")).select("u", F.least("m", own)["id"].alias("to")), "hooks")
        levels.append(hooks)
        path = fresh_path(spark, "edges")
        edges = put(
            edges.join(hooks, "u").select("v", F.col("to").alias("p"))
            .join(hooks.withColumnRenamed("u", "v"), "v")
            .select(F.least("p", "to").alias("u"), F.greatest("p", "to").alias("v"))
            .where("u <> v").distinct(),
            "edges", path,
        )
        spent.append(path)
    if not levels:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found = levels[0].select(F.col("u").alias("id"), F.col("to").alias("root"))
    for hooks in levels[1:]:
        found = found.join(hooks.withColumnRenamed("u", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    found = put(found, "roots")
    least = found.groupBy("root").agg(F.least(F.min("id"), F.min("root")).alias("component"))
    found = put(found.join(least, "root").select("id", "component"), "components")
    for path in spent:
        delete(spark, path)
    return found
