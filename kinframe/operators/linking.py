"""Structure over many links: offsets by a weighted union-find, flat remaps, cycles.

All three take a number of rounds that grows with the logarithm of the longest line of links
(cycles: with the longest line inside a knot), whatever the number of rows; each round is a
few joins and groupings, cut by written tables, and only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from kinframe.operators.merge import align, merge_nodes
from kinframe.operators.tables import cut, cut_counted, drop


#: Steps of a search for cycles between written tables.
STEPS = 2
#: Place of rows without a file.
_LAST = 2**31 - 1

# ---- offsets ----------------------------------------------------------------


def offsets(links: DataFrame) -> DataFrame:
    """(id, root, offset) of every end of the links (a, b, shift): offset(a) = offset(b) + shift.

    A union-find with potentials. In each round every vertex hooks onto the neighbour (or
    itself) whose hash is least and keeps the shift to it; links are rewritten between the
    hooks, with the shifts of both ends taken in, until none is left. A path goes in O(log n)
    rounds, a star in one. The root is the least id of a component and has offset 0. Where links
    contradict each other the offsets are those of the spanning forest that the hooks make;
    ``contradictions`` names the links that don't agree. Links of an id with itself are ignored,
    null ends as well.
    """
    live = cut(links.select("a", "b", F.col("shift").cast("long").alias("shift")).where("a <> b").groupBy("a", "b").agg(F.min("shift").alias("shift")))
    ends = cut(live.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    levels: list[DataFrame] = []
    spent: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("shift")).alias("shift")))
        nearest = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"), F.col("shift").alias("up")))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("to"), F.lit(0).cast("long").alias("up"))
        hooks = cut(both.groupBy("a").agg(nearest.alias("m")).select(F.col("a").alias("id"), F.least("m", own).alias("m")).select("id", "m.to", "m.up"))
        levels.append(hooks)
        ha, hb = (hooks.select(F.col("id").alias(x), F.col("to").alias(f"{x}_to"), F.col("up").alias(f"{x}_up")) for x in ("a", "b"))
        # offset(a) = offset(a_to) + a_up, and so for b
        moved = live.join(ha, "a").join(hb, "b").select("a_to", "b_to", (F.col("shift") + F.col("b_up") - F.col("a_up")).alias("shift")).where("a_to <> b_to")
        one_way = F.col("a_to") < F.col("b_to")
        moved = moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"), F.when(one_way, F.col("shift")).otherwise(-F.col("shift")).alias("shift"))
        spent.append(live)
        live = cut(moved.groupBy("a", "b").agg(F.min("shift").alias("shift")))
    found = ends.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("offset"))
    for hooks in levels:
        step = hooks.select(F.col("id").alias("root"), "to", "up")
        found = found.join(step, "root", "left").select("id", F.coalesce("to", "root").alias("root"), (F.col("offset") + F.coalesce("up", F.lit(0))).alias("offset"))
    found = cut(found)
    least = found.groupBy("root").agg(F.min(F.struct("id", "offset")).alias("least"))
    out = cut(found.join(least, "root").select("id", F.col("least.id").alias("root"), (F.col("offset") - F.col("least.offset")).alias("offset")))
    drop(*spent, live, *levels, found, ends)
    return out


def contradictions(links: DataFrame, found: DataFrame) -> DataFrame:
    """The links that the offsets don't agree with, and the shift that these have instead (``is``)."""
    a = found.select(F.col("id").alias("a"), F.col("offset").alias("_a"))
    b = found.select(F.col("id").alias("b"), F.col("offset").alias("_b"))
    told = links.join(a, "a").join(b, "b").withColumn("is", F.col("_a") - F.col("_b"))
    return told.where("is <> shift").drop("_a", "_b")


def file_links(nodes: DataFrame) -> DataFrame:
    """(a, b, shift, people, agree): how each file ``a`` is to be shifted against an earlier file ``b``.

    Every person links all files it is in with the first of them, never each with each, so
    the links grow with the rows. Of the people of two files the one with the least
    generation in the earlier file decides (least key on ties); ``agree`` counts those that
    give the same shift.
    """
    own = nodes.where("key IS NOT NULL AND gen IS NOT NULL").groupBy("file_ord", "key").agg(F.min("gen").alias("gen"))
    # a window, not a join with the groups' first: rows are made and sorted once
    first = F.min(F.struct("file_ord", "gen")).over(Window.partitionBy("key"))
    met = own.withColumn("first", first).where(F.col("file_ord") > F.col("first.file_ord")).select(
        F.col("file_ord").alias("a"), F.col("first.file_ord").alias("b"), (F.col("first.gen") - F.col("gen")).cast("long").alias("shift"), F.col("first.gen").alias("gen"), "key")
    # summed by shift first: few rows per pair of files go on
    by_shift = met.groupBy("a", "b", "shift").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("gen", "key")).alias("least"))
    return by_shift.groupBy("a", "b").agg(F.min_by("shift", "least").alias("shift"), F.sum("n").alias("people"), F.min_by("n", "least").alias("agree"))


def file_offsets(nodes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(file_ord, root, offset) for every file; a file that shares nobody is its own root."""
    nodes = cut(nodes.select("file_ord", *(["key", "gen"] if links is None else [])))  # read for links and files
    found = offsets(file_links(nodes) if links is None else links)
    files = nodes.select("file_ord").where("file_ord IS NOT NULL").distinct()
    named = found.withColumnRenamed("id", "file_ord")
    return files.join(named, "file_ord", "left").select("file_ord", F.coalesce("root", "file_ord").alias("root"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def merge_many(nodes: DataFrame) -> DataFrame:
    """The node tables of all files (file_ord, key, gen, ...) aligned at once and merged, least generation 0.

    Equal to ``merge_files`` where that is defined: each file shares somebody with an earlier
    one of its component and the shared people agree. Files of different components keep their
    own generations until all are shifted together, as there. Rows with a null file stay
    unshifted and come last.
    """
    nodes = cut(nodes)  # read for offsets and for the merge
    shifted = nodes.join(file_offsets(nodes).select("file_ord", "offset"), "file_ord", "left")
    moved = shifted.withColumn("gen", (F.col("gen") + F.coalesce("offset", F.lit(0))).cast(dict(nodes.dtypes)["gen"])).drop("offset")
    moved = moved.withColumn("file_ord", F.coalesce("file_ord", F.lit(_LAST)))
    return align(cut(merge_nodes(moved)))


# ---- remaps -----------------------------------------------------------------


def flatten(remap: DataFrame) -> DataFrame:
    """A remap (dup, canon) with every dup led to its last canonical; members of a cycle to its least id.

    Pointer jumping: in each round every pointer is replaced by its target's, so the stretch
    that it spans doubles. The number of pointers whose target still points on falls as long
    as any chain is open; if it doesn't, the rest lead into cycles. Those go on until they
    span as many steps as there are of them, so that each has passed its whole cycle, carry
    the least id on the way, and take that of the member at which they end. Of several
    canonicals of one dup the least counts; rows with nulls, or that remap an id to itself,
    are ignored.
    """
    table = remap.select("dup", "canon").where("dup <> canon").groupBy("dup").agg(F.min("canon").alias("to"))
    now = cut(table.select("dup", "to", F.least("dup", "to").alias("low"), F.lit(True).alias("open")))
    before, steps = None, 1
    while True:
        ahead = now.select(F.col("dup").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        joined = now.drop("open").join(ahead, "to", "left")
        seen = Observation()
        goes = F.col("next").isNotNull()
        after = joined.observe(seen, F.count_if(goes).alias("open")).select("dup", F.coalesce("next", "to").alias("to"), F.least("low", F.coalesce("next_low", "low")).alias("low"), goes.alias("open"))
        after = cut(after)
        drop(now)
        now, steps, still = after, 2 * steps, seen.get["open"]
        if not still or still == before and steps >= still:
            break
        before = still
    ended = now.where(~F.col("open")).select("dup", F.col("to").alias("canon"))
    if not still:
        return ended.where("dup <> canon")
    around = now.where("open")
    at = around.select(F.col("dup").alias("to"), F.col("low").alias("canon"))
    return ended.unionByName(around.drop("low").join(at, "to").select("dup", "canon")).where("dup <> canon")


# ---- cycles -----------------------------------------------------------------


def cycles(edges: DataFrame) -> DataFrame:
    """(id, cycle): members of strongly connected components that hold a cycle; ``cycle`` is the least member.

    Trimming takes away, again and again, what has no edge in or none out: a graph without
    cycles vanishes. What is left is coloured: each node takes the largest id that reaches it
    (forward), and those that reach a colour's own node inside the colour are its component
    (backward). Components are taken out and the rest goes round again. An edge of a node
    with itself is a cycle of one. Edges with null ends are ignored.
    """
    live = cut(edges.select("s", "t").where("s IS NOT NULL AND t IS NOT NULL").distinct())
    loops = cut(live.where("s = t").select(F.col("s").alias("id"), F.col("s").alias("cycle")))
    found = [loops]
    live, many = _trimmed(live.where("s <> t"))
    while many:
        colour = _coloured(live)
        inside = cut(_with_colours(live, colour).where("cs = ct").select("s", "t", F.col("cs").alias("c")))
        part = cut(colour.where("id = c").select("id", "c"))
        reached, new = part, 1
        while new:
            back = inside.join(part.select(F.col("id").alias("t"), "c"), ["t", "c"]).select(F.col("s").alias("id"), "c").distinct()
            part, new = cut_counted(back.join(reached, ["id", "c"], "left_anti"))
            reached = cut(reached.unionByName(part))
        sized = reached.groupBy("c").agg(F.min("id").alias("cycle"), F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(cut(reached.join(sized, "c").select("id", "cycle")))
        out = reached.select("id")
        rest = live.join(out.withColumnRenamed("id", "s"), "s", "left_anti").join(out.withColumnRenamed("id", "t"), "t", "left_anti")
        drop(colour, inside)
        live, many = _trimmed(rest.select("s", "t"))
    # a node with an edge to itself may be in a larger knot too
    return _all(found).groupBy("id").agg(F.min("cycle").alias("cycle"))


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges whose ends have edges in and out, over and over until all have; and how many."""
    live, many = cut_counted(edges)
    while many:
        kept = live
        for _ in range(STEPS):
            sources, targets = kept.select(F.col("s").alias("t")).distinct(), kept.select(F.col("t").alias("s")).distinct()
            kept = kept.join(targets, "s", "left_semi").join(sources, "t", "left_semi").select("s", "t")
        kept, left = cut_counted(kept)
        drop(live)
        live = kept
        if left == many:
            break
        many = left
    return live, many


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, c): the largest id that reaches each node."""
    colour = cut(edges.select(F.explode(F.array("s", "t")).alias("id")).distinct().withColumn("c", F.col("id")))
    while True:
        now, seen = colour.withColumn("was", F.col("c")), Observation()
        for _ in range(STEPS):
            came = edges.join(now.select(F.col("id").alias("s"), "c"), "s").groupBy("t").agg(F.max("c").alias("more"))
            now = now.join(came.withColumnRenamed("t", "id"), "id", "left").select("id", F.greatest("c", F.coalesce("more", "c")).alias("c"), "was")
        after = cut(now.observe(seen, F.count_if(F.col("c") > F.col("was")).alias("n")).select("id", "c"))
        drop(colour)
        colour = after
        if not seen.get["n"]:
            return colour


def _with_colours(edges: DataFrame, colour: DataFrame) -> DataFrame:
    s, t = (colour.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "st")
    return edges.join(s, "s").join(t, "t")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
