"""Searches of deep graphs: lines of single steps are spanned by pointer jumping, the rest is searched level by level.

A node that one step alone leads to has nothing to choose: its depth, rank and path counts are
those of the node before it, one step on. All such nodes are led to the last node before them
that has a choice, their head, in rounds with the logarithm of the longest line; what is left
is a graph of heads with long steps. Its levels are the junctions on a line, not its people: a
chain of 100,000 takes 17 rounds. A graph in which most nodes have two ways in (a pedigree
searched downwards) is hardly shortened; ``graph.bfs`` and the like are the plainer choice there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinframe.operators.graph import LOOK_FOR_CYCLES, TOGETHER, _all, _refuse_cycles
from kinframe.operators.tables import cut, cut_counted, drop


def _step(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct steps (a, b); null ends lead nowhere."""
    return cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())


def spans(step: DataFrame, stops: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """(id, head, place, endless) of the nodes with a single step in: the node before their line, and how far behind it.

    ``stops`` (id) are heads whatever leads to them; with ``among`` (id) all others are heads as
    well. ``endless`` marks what lies on a ring of single steps or below one: it has no head. The
    number of rounds is the logarithm of the longest line (with rings: of the number of nodes on
    and below them).
    """
    single = step.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("head"), F.count(F.lit(1)).alias("n")).where("n = 1")
    if stops is not None:
        single = single.join(stops.select("id"), "id", "left_anti")
    if among is not None:
        single = single.join(among.select("id"), "id", "left_semi")
    now = cut(single.select("id", "head", F.lit(1).cast("long").alias("place"), F.lit(True).alias("endless")))
    before, reach = None, 1
    while True:
        ahead = now.select(F.col("id").alias("head"), F.col("head").alias("next"), F.col("place").alias("more"))
        seen, goes = Observation(), F.col("next").isNotNull()
        jumped = now.drop("endless").join(ahead, "head", "left").observe(seen, F.count_if(goes).alias("open"))
        after = cut(jumped.select("id", F.coalesce("next", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), goes.alias("endless")))
        drop(now)
        now, reach, still = after, 2 * reach, seen.get["open"]
        if not still or still == before and reach >= still:
            return now
        before = still


def _hops(step: DataFrame, line: DataFrame) -> DataFrame:
    """Long steps (head, b, w) to the nodes that aren't on a line; the head is null behind a ring."""
    into = step.join(line.select(F.col("id").alias("b")), "b", "left_anti")
    told = into.join(line.select(F.col("id").alias("a"), "head", "place", "endless"), "a", "left")
    return told.select(F.when(F.col("endless"), None).otherwise(F.coalesce("head", "a")).alias("head"), "b", (F.coalesce("place", F.lit(0)) + 1).alias("w"))


def deep_bfs(edges: DataFrame, roots: DataFrame, up: bool = True) -> DataFrame:
    """(id, depth, pred) of everything reached from the roots (id), as ``graph.bfs`` without a bound.

    Junctions take the least depth over the long steps into them, again and again until none
    gets less; nodes on lines follow from their heads. ``pred`` is the smallest of the nodes
    one level before.
    """
    step = _step(edges, *(("t", "s") if up else ("s", "t")))
    start = cut(roots.select("id").where("id IS NOT NULL").distinct())
    line = spans(step, start)
    hops = cut(_hops(step, line).where("head IS NOT NULL").groupBy("head", "b").agg(F.min("w").alias("w")))
    least = lambda parts: _all(parts).groupBy("id").agg(F.min("depth").alias("depth"))
    news = cut(start.withColumn("depth", F.lit(0).cast("long")))
    known, many = [news], 1
    while many:
        met = news.withColumnRenamed("id", "head").join(hops, "head").groupBy(F.col("b").alias("id")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        had = least(known).withColumnRenamed("depth", "had")
        news, many = cut_counted(met.join(had, "id", "left").where("had IS NULL OR depth < had").select("id", "depth"))
        known.append(news)
        if len(known) > TOGETHER:
            known = [cut(least(known))]
    heads = cut(least(known))
    behind = line.where("NOT endless").join(heads.withColumnRenamed("id", "head"), "head").select("id", (F.col("depth") + F.col("place")).alias("depth"))
    found = cut(heads.unionByName(behind))
    came = step.join(found.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min_by("a", F.struct("depth", "a")).alias("pred"))
    came = came.join(start, "id", "left_anti")
    return found.join(came, "id", "left").select("id", F.col("depth").cast("int").alias("depth"), "pred")


def deep_counts(edges: DataFrame, root: int) -> DataFrame:
    """(id, depth, ways) of every generation above the root, as ``graph.path_counts`` without a bound.

    Long steps of one length between the same two nodes are counted together; a junction
    passes on what each round brought it. A cycle above the root raises.
    """
    step = _step(edges, "t", "s")
    start = edges.sparkSession.createDataFrame([(root,)], "id long")
    line = spans(step, start)
    hops = cut(_hops(step, line).where("head IS NOT NULL").groupBy("head", "b", "w").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n")))
    whole = lambda c: F.sum(c).cast("decimal(38,0)").alias("ways")
    together = lambda parts: _all(parts).groupBy("id", "depth").agg(whole("ways"))
    news = start.select("id", F.lit(0).cast("long").alias("depth"), F.lit(1).cast("decimal(38,0)").alias("ways"))
    known, many, rounds = [news], 1, 0
    while many:
        met = news.withColumnRenamed("id", "head").join(hops, "head").groupBy(F.col("b").alias("id"), (F.col("depth") + F.col("w")).alias("depth"))
        news, many = cut_counted(met.agg(whole((F.col("ways") * F.col("n")).cast("decimal(38,0)"))))
        known.append(news)
        rounds += 1
        if many and rounds == LOOK_FOR_CYCLES:
            _refuse_cycles(hops.select(F.col("head").alias("id"), F.col("b").alias("to")).distinct(), news)
        if len(known) > TOGETHER:
            known = [cut(together(known))]
    heads = cut(together(known))
    behind = line.where("NOT endless").join(heads.withColumnRenamed("id", "head"), "head").select("id", (F.col("depth") + F.col("place")).alias("depth"), "ways")
    return heads.unionByName(behind).where("depth > 0").select("id", F.col("depth").cast("int").alias("depth"), "ways")


def deep_ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank, cyclic), as ``graph.topo_rank``: 0 without parents, else one more than the highest rank of the parents.

    Junctions are done when all long steps into them come from nodes that are; what never is
    lies on or below cycles, or below ids that are no nodes.
    """
    ids = cut(nodes.select("id").distinct())
    step = _step(edges, "s", "t")
    line = spans(step, among=ids)
    live = cut(_hops(step, line).groupBy("head", "b").agg(F.max("w").alias("w")))
    junctions = ids.join(line.select("id"), "id", "left_anti")
    ready, many = cut_counted(junctions.join(live.select(F.col("b").alias("id")), "id", "left_anti").withColumn("rank", F.lit(0).cast("long")))
    done: list[DataFrame] = []
    waiting: DataFrame | None = None
    while many:
        done.append(ready)
        own = ready.withColumnRenamed("id", "head")
        freed = live.join(own, "head").select(F.col("b").alias("id"), (F.col("rank") + F.col("w")).alias("rank"))
        rest = cut(live.join(own, "head", "left_anti"))
        if waiting is not None:
            freed = freed.unionByName(waiting.join(ready.select("id"), "id", "left_anti"))
        held = cut(freed.groupBy("id").agg(F.max("rank").alias("rank")))
        drop(live, *([waiting] if waiting is not None else []))
        live, waiting = rest, held
        ready, many = cut_counted(waiting.join(live.select(F.col("b").alias("id")), "id", "left_anti").join(ids, "id", "left_semi"))
        if len(done) > TOGETHER:
            done = [cut(_all(done))]
    if not done:
        return ids.select("id", F.lit(0).alias("rank"), F.lit(True).alias("cyclic"))
    heads = cut(_all(done))
    behind = line.where("NOT endless").join(heads.withColumnRenamed("id", "head"), "head").select("id", (F.col("rank") + F.col("place")).alias("rank"))
    ranked = cut(heads.unionByName(behind))
    last = ranked.agg(F.max("rank")).first()[0]
    left = ids.join(ranked, "id", "left_anti").select("id", F.lit(last + 1).alias("rank"), F.lit(True).alias("cyclic"))
    return ranked.withColumn("cyclic", F.lit(False)).unionByName(left).select("id", F.col("rank").cast("int").alias("rank"), "cyclic")
