"""Iterative graph operators: one shuffle per level, lineage cut by written tables.

Edges are (s parent, t child). Loops are driven by small counts; the frontier,
the visited set and all results stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from kinframe.operators.tables import cut, cut_counted, drop

#: Levels between written tables.
EVERY = 6
#: Generations after which a count without a bound looks for cycles.
LOOK_FOR_CYCLES = 48
#: Levels of a search after which what was found is written as one table.
TOGETHER = 4


def bfs(edges: DataFrame, roots: DataFrame, up: bool = True, max_depth: int | None = None, keep_path: bool = False, start: int = 0) -> DataFrame:
    """(id, depth, pred[, path]): least depth of everything reached from the roots (id).

    Ends when a level finds nothing new; ``max_depth`` ends it after so many levels.
    ``up`` follows child to parent. ``pred`` is the smallest predecessor of the level;
    with ``keep_path`` it is the one a queue would meet first (neighbours in id order),
    and ``path`` leads from the root through it.
    """
    child, parent = ("t", "s") if up else ("s", "t")
    step = cut(edges.select(F.col(child).alias("id"), F.col(parent).alias("to")).distinct())
    seen = roots.select("id", F.lit(start).alias("depth"), F.lit(None).cast("long").alias("pred"))
    if keep_path:
        seen = seen.withColumn("path", F.array("id"))
    frontier, found_now = cut_counted(seen)
    levels, depth = [frontier], start
    while (max_depth is None or depth - start < max_depth) and found_now:
        depth += 1
        reached = frontier.join(step, "id").groupBy("to")
        # of equally short paths the least one is the one that is discovered first
        found = reached.agg(F.min("path").alias("path")).withColumn("pred", F.element_at("path", -1)) if keep_path else reached.agg(F.min("id").alias("pred"))
        found = found.join(_all(levels).select(F.col("id").alias("to")), "to", "left_anti")
        columns = [F.col("to").alias("id"), F.lit(depth).alias("depth"), "pred"]
        frontier, found_now = cut_counted(found.select(*columns, *([F.concat("path", F.array("to")).alias("path")] if keep_path else [])))
        levels.append(frontier)
        if len(levels) > TOGETHER:  # else plans grow with the depth
            whole = cut(_all(levels))
            drop(*levels[:-1])
            levels = [whole]
    return _all(levels)


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All ancestors and descendants of the roots, with their signed distance."""
    above = bfs(edges, roots, True, max_depth).select("id", F.col("depth").alias("distance"))
    below = bfs(edges, roots, False, max_depth).where("depth > 0").select("id", (-F.col("depth")).alias("distance"))
    return above.unionByName(below)


def path_counts(edges: DataFrame, root: int, max_gen: int | None = 25, mode: str = "exact") -> DataFrame:
    """(id, depth, ways): number of lines of descent of each length from the root.

    Up to ``max_gen`` generations, or to the last one (None). Without a bound a cycle above
    the root raises: a count that goes on beyond ``LOOK_FOR_CYCLES`` generations looks for
    cycles among what it still counts, once.

    ``exact`` counts every path. ``bfs`` reproduces the order-dependent variant in
    which a contribution passes on only to nodes discovered later in breadth-first order.
    """
    step = edges.select(F.col("t").alias("id"), F.col("s").alias("to")).distinct()
    if mode == "bfs":
        found = bfs(edges, edges.sparkSession.createDataFrame([(root,)], "id long"), True, max_gen, keep_path=True)
        rank = cut(found.select("id", F.struct("depth", "path").alias("r")))  # the order of discovery
        a, b = rank.withColumnRenamed("r", "ra"), rank.select(F.col("id").alias("to"), F.col("r").alias("rb"))
        last = step.join(a, "id").join(b, "to").where("ra < rb").select("id", "to")
        passes = cut(last)
        everyone = step
    else:
        passes = everyone = cut(step)
    start = edges.sparkSession.createDataFrame([(root,)], "id long")
    frontier, levels = start.select("id", F.lit(0).alias("depth"), F.lit(1).cast("decimal(38,0)").alias("ways")), []
    depth, left, looked = 0, 1, False
    while left and (max_gen is None or depth < max_gen):
        depth += 1
        to = lambda s, f: f.join(s, "id").groupBy("to").agg(F.sum("ways").cast("decimal(38,0)").alias("ways"))
        told = to(everyone, frontier).select(F.col("to").alias("id"), F.lit(depth).alias("depth"), "ways")
        levels.append(told)
        frontier = told if passes is everyone else to(passes, frontier).select(F.col("to").alias("id"), F.lit(depth).alias("depth"), "ways")
        if depth % EVERY == 0:
            frontier, left = cut_counted(frontier)
            if left and max_gen is None and not looked and depth >= LOOK_FOR_CYCLES:
                looked = True
                _refuse_cycles(everyone, frontier)
            levels = [cut(_all([*levels[:-1], frontier] if passes is everyone else levels))]
    return _all(levels)


def _refuse_cycles(step: DataFrame, frontier: DataFrame) -> None:
    from kinframe.operators.linking import cycles

    above = bfs(step.select(F.col("id").alias("t"), F.col("to").alias("s")), frontier.select("id").distinct())
    inside = step.join(above.select("id"), "id", "left_semi")
    some = [str(r.id) for r in cycles(inside.select(F.col("to").alias("s"), F.col("id").alias("t"))).orderBy("id").limit(20).collect()]
    if some:
        raise ValueError(f"lines of descent run into a cycle, with the ids {', '.join(some)}")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def topo_rank(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, rank, cyclic): peeling rounds, ancestors first; what is left lies on or below cycles.

    Each round takes the nodes whose parents are all done; ``max_rounds`` raises beyond so many.
    """
    ids = nodes.select("id")
    live = cut(edges.select("s", "t").distinct())
    targets = lambda e: e.select(F.col("t").alias("id"))
    ready, many = cut_counted(ids.join(targets(live), "id", "left_anti"))
    done, rank = [], 0
    while many:
        if max_rounds is not None and rank >= max_rounds:
            raise RuntimeError(f"more than {max_rounds} ranks")
        done.append(ready.select("id", F.lit(rank).alias("rank"), F.lit(False).alias("cyclic")))
        rank += 1
        own = ready.withColumnRenamed("id", "s")
        children = live.join(own, "s", "left_semi")
        rest = cut(live.join(own, "s", "left_anti"))
        ready, many = cut_counted(targets(children).distinct().join(ids, "id", "left_semi").join(targets(rest), "id", "left_anti"))
        drop(live)
        live = rest
        if len(done) > TOGETHER:
            done = [cut(_all(done))]
    if not done:
        return ids.select("id", F.lit(0).alias("rank"), F.lit(True).alias("cyclic"))
    left = ids.join(_all(done), "id", "left_anti").select("id", F.lit(rank).alias("rank"), F.lit(True).alias("cyclic"))
    return _all([*done, left])


def first_parents(edges: DataFrame, most: int = 2, order: str = "s") -> DataFrame:
    """At most ``most`` parents of each child, in an explicit order."""
    w = Window.partitionBy("t").orderBy(order)
    return edges.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def kinship(edges: DataFrame, ranks: DataFrame, pairs: DataFrame, unknown_parent: str = "renormalise") -> DataFrame:
    """Kinship coefficient of each pair (a, b): (a, b, phi).

    The pairs that are needed are worked out once each. Going up, rank by rank from the
    youngest, each distinct pair is replaced by the pairs of its later-ranked member's
    parents with the other member ((x, x) by the pair of its two parents); what refers
    to what is written per rank. Coming down, each rank is solved from those above it:
    phi(x, x) = (1 + phi(parents)) / 2, any other phi is the weighted sum of those it
    refers to, and 0 where the later-ranked member has no parents. The work is bounded
    by distinct pairs, however many origins share them. Ranks on cycles aren't allowed.

    With ``renormalise`` a single known parent has the whole weight, else half of it.
    """
    parents = first_parents(edges).groupBy("t").agg(F.sort_array(F.collect_list("s")).alias("ps"))
    about = cut(ranks.select("id", "rank").join(parents.withColumnRenamed("t", "id"), "id", "left").select("id", "rank", F.coalesce("ps", F.array().cast("array<long>")).alias("ps")))
    x = about.select(F.col("id").alias("x"), F.col("rank").alias("rx"), F.col("ps").alias("px"))
    y = about.select(F.col("id").alias("y"), F.col("rank").alias("ry"), F.col("ps").alias("py"))
    later = F.struct("rx", "x") >= F.struct("ry", "y")

    def ordered(p: DataFrame) -> DataFrame:
        """Distinct (a, ra, pa, b, rb): the later-ranked member first, with its parents."""
        rows = p.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().join(x, "x").join(y, "y")
        pick = lambda u, v: F.when(later, F.col(u)).otherwise(F.col(v))
        return rows.select(pick("x", "y").alias("a"), pick("rx", "ry").alias("ra"), pick("px", "py").alias("pa"), pick("y", "x").alias("b"), pick("ry", "rx").alias("rb"))

    share = 1.0 / F.size("pa") if unknown_parent == "renormalise" else F.lit(0.5)
    same = F.col("a") == F.col("b")
    up = F.when(same, F.when(F.size("pa") == 2, F.array(F.struct(F.col("pa")[0].alias("c"), F.col("pa")[1].alias("d"), F.lit(0.5).alias("w"))))).otherwise(
        F.transform("pa", lambda p: F.struct(p.alias("c"), F.col("b").alias("d"), share.alias("w"))))

    def needs(p: DataFrame) -> DataFrame:
        """(a, b, c, d, w): what each pair refers to; c is null where it refers to nothing."""
        return p.select("a", "b", F.explode_outer(up).alias("r")).select("a", "b", F.least("r.c", "r.d").alias("c"), F.greatest("r.c", "r.d").alias("d"), "r.w")

    def beyond(n: DataFrame) -> DataFrame:
        return n.where("c IS NOT NULL").select(F.col("c").alias("x"), F.col("d").alias("y"))

    wanted = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    pool = cut(ordered(wanted))
    told: list[DataFrame] = []  # what pairs refer to; solved last to first
    rank = pool.agg(F.max("ra")).first()[0]
    while rank is not None:
        mine = pool.where(F.col("ra") == rank)
        # two members of one rank first: what they refer to may be of this rank too
        peers = cut(needs(mine.where("ra = rb")))
        fresh = ordered(beyond(peers))
        lower = pool.where(F.col("ra") < rank).unionByName(fresh.where(F.col("ra") < rank))
        uneven = cut(needs(mine.where("ra > rb").unionByName(fresh.where(F.col("ra") == rank)).distinct()))
        oldest = Observation()
        rest = cut(lower.unionByName(ordered(beyond(uneven))).distinct().observe(oldest, F.max("ra").alias("rank")))
        told += [peers, uneven]
        drop(pool)
        pool, was = rest, rank
        rank = oldest.get["rank"]
        if rank is not None and rank >= was:
            raise ValueError("the pairs lead into a cycle")
    known: list[DataFrame] = []
    for refers in reversed(told):
        if known:
            phi = _all(known).select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("phi").alias("_phi"))
            value = refers.join(phi, ["c", "d"], "left")
        else:
            value = refers.withColumn("_phi", F.lit(None).cast("double"))
        value = value.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.coalesce(F.col("w") * F.col("_phi"), F.lit(0.0)).alias("part"))
        solved = value.groupBy("a", "b").agg(F.sum("part").alias("phi"))
        known.append(cut(solved.select("a", "b", (F.col("phi") + F.when(same, 0.5).otherwise(0.0)).alias("phi"))))
        if len(known) > TOGETHER:
            whole = cut(_all(known))
            drop(*known)
            known = [whole]
    if told:
        drop(*told)
    total = pairs.select("a", "b").distinct()
    if not known:
        return total.withColumn("phi", F.lit(0.0))
    phi = _all(known).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "phi")
    return total.join(phi, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left").select("a", "b", F.coalesce("phi", F.lit(0.0)).alias("phi"))


def inbreeding(nodes: DataFrame, edges: DataFrame, ids: DataFrame, unknown_parent: str = "renormalise") -> DataFrame:
    """(id, f, status): Wright's F, the kinship of the two parents; null with fewer than two.

    The relationship matrix is A = L D L', so no pairs of people are made: each person has a row
    of L, the shares of its ancestors (its own 1, and half of each parent's row), and a variance
    d that Mendelian sampling adds. With the rows l, m of the two parents F is half the sum of
    l m d over the ancestors that they share, and d follows from the parents' F. Ranks are solved
    ancestors first; a rank takes the rows of its parents, with d carried along, and keeps the
    rows of those that have children here. Work and space follow the number of (person, ancestor)
    pairs of those above ``ids``.
    """
    wanted = cut(ids.select("id").distinct())
    parents = first_parents(edges).select("s", "t")
    above = wanted if ids is nodes else bfs(parents, wanted).select("id")  # of all people there is nobody above
    own = cut(parents.join(above.withColumnRenamed("id", "t"), "t", "left_semi"))
    ranks = topo_rank(above, own)
    about = cut(above.join(own.groupBy(F.col("t").alias("id")).agg(F.sort_array(F.collect_list("s")).alias("ps")), "id", "left")
                .select("id", F.coalesce("ps", F.array().cast("array<long>")).alias("ps"))
                .join(own.select(F.col("s").alias("id")).distinct().withColumn("has", F.lit(True)), "id", "left").join(ranks, "id"))
    if not about.where("cyclic").isEmpty():
        raise ValueError("the people lie on or below a cycle")
    last = about.agg(F.max("rank")).first()[0]
    rows: list[DataFrame] = []  # (x, anc, l, d) of people with children
    known: list[DataFrame] = []  # (id, f) of everyone
    for rank in range(0 if last is None else last + 1):
        mine = about.where(F.col("rank") == rank)
        if not rows:  # nobody has parents
            told = mine.select("id", F.lit(0.0).alias("f"))
            made = mine.where("has").select(F.col("id").alias("x"), F.col("id").alias("anc"), F.lit(1.0).alias("l"), F.lit(1.0).alias("d"))
            known, rows = [cut(told)], [cut(made)]
            continue
        each = mine.select("id", F.size("ps").alias("many"), "has", F.posexplode("ps").alias("k", "p"))
        of_parents = each.join(_all(known).select(F.col("id").alias("p"), F.col("f").alias("fp")), "p").groupBy("id").agg(F.first("many").alias("many"), F.sum("fp").alias("fs"), F.first("has").alias("has"))
        alone = -F.col("fs") if unknown_parent == "renormalise" else 0.75 - 0.25 * F.col("fs")
        new_d = of_parents.select("id", "has", F.when(F.col("many") == 2, 0.5 - 0.25 * F.col("fs")).otherwise(alone).alias("d"))
        met = each.join(_all(rows).withColumnRenamed("x", "p"), "p").groupBy("id", "anc").agg(
            F.first("has").alias("has"), F.first("many").alias("many"), F.first("d").alias("d"), F.sum(F.when(F.col("k") == 0, F.col("l")).otherwise(0.0)).alias("l0"), F.sum(F.when(F.col("k") == 1, F.col("l")).otherwise(0.0)).alias("l1"))
        met = cut(met)
        told = met.groupBy("id").agg(F.sum(0.5 * F.col("l0") * F.col("l1") * F.col("d")).alias("f"))
        share = F.when(F.col("many") == 2, F.lit(0.5)).otherwise(1.0 if unknown_parent == "renormalise" else 0.5)
        inherited = met.where("has").select(F.col("id").alias("x"), "anc", (share * (F.col("l0") + F.col("l1"))).alias("l"), "d")
        itself = new_d.where("has").select(F.col("id").alias("x"), F.col("id").alias("anc"), F.lit(1.0).alias("l"), "d")
        known.append(cut(told))
        if rank < last:
            rows.append(cut(inherited.unionByName(itself)))
        drop(met)
        for tables in (known, rows):
            if len(tables) > TOGETHER:
                one = cut(_all(tables))
                drop(*tables)
                tables[:] = [one]
    two = about.where(F.size("ps") == 2).select("id", F.lit(True).alias("_two"))
    found = wanted.join(two, "id", "left")
    if known:
        found = found.join(_all(known), "id", "left")
    else:
        found = found.withColumn("f", F.lit(None).cast("double"))
    out = ids.select("id").join(found.select("id", F.when(F.col("_two"), F.col("f")).alias("f")), "id", "left")
    return out.select("id", "f", F.when(F.col("f").isNull(), "undefined").otherwise("ok").alias("status"))


#: Coefficients of well-known relationships between the parents.
EQUIVALENTS = ((0.25, "full siblings or parent and child"), (0.125, "half siblings or uncle and niece"), (0.0625, "first cousins"), (0.03125, "first cousins once removed"), (0.015625, "second cousins"))


def equivalent(f: DataFrame) -> DataFrame:
    """The relationship whose coefficient is nearest to each F."""
    table = f.sparkSession.createDataFrame(list(EQUIVALENTS), "ref double, relation string")
    return f.crossJoin(F.broadcast(table)).groupBy(*f.columns).agg(F.min_by("relation", F.struct(F.abs(F.col("f") - F.col("ref")), -F.col("ref"))).alias("relation"))  # five rows


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    return nodes.join(edges.select(F.col("s").alias("id")), "id", "left_anti")


def find_root(nodes: DataFrame, edges: DataFrame, root_id: int | None = None, name: str | None = None) -> int:
    """The root's id: given, by unique exact name, or the unique sink of least generation."""
    found = nodes.where(F.col("id") == root_id) if root_id is not None else nodes.where(F.col("name") == name) if name is not None else sinks(nodes, edges)
    if root_id is None and name is None:
        found = found.join(found.agg(F.min("gen").alias("gen")), "gen")
    rows = found.select("id").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the root isn't unique" if rows else "no root found")
    return rows[0]["id"]


def implex(ways: DataFrame) -> DataFrame:
    """Per generation: places filled, distinct ancestors, collapse and the places in theory."""
    by = ways.where("depth > 0").groupBy("depth").agg(F.sum("ways").cast("decimal(38,0)").alias("filled"), F.count_distinct("id").alias("distinct_ancestors"))
    return by.select(F.col("depth").alias("gen"), "filled", "distinct_ancestors", (1 - F.col("distinct_ancestors") / F.col("filled").cast("double")).alias("collapse"), F.pow(F.lit(2.0), "depth").alias("theoretical"))


def implex_summary(ways: DataFrame) -> DataFrame:
    """Totals over all generations."""
    return ways.where("depth > 0").agg(F.sum("ways").cast("decimal(38,0)").alias("total_filled"), F.count_distinct("id").alias("total_distinct"), F.max("depth").alias("generations"))


def drop_self_and_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between two different existing nodes."""
    ids = nodes.select("id")
    return edges.where("s <> t").join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "t"), "t", "left_semi").select("s", "t").distinct()


def remove_placeholders(nodes: DataFrame, edges: DataFrame, placeholder: str = "placeholder") -> tuple[DataFrame, DataFrame]:
    """Nodes that aren't placeholders and have an edge to another such node, and their edges."""
    real = nodes.where(~F.col(placeholder)).select("id")
    kept = edges.join(real.withColumnRenamed("id", "s"), "s", "left_semi").join(real.withColumnRenamed("id", "t"), "t", "left_semi").select("s", "t")
    ends = kept.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    return nodes.where(~F.col(placeholder)).join(ends, "id", "left_semi"), kept


def cap_placeholder_parents(nodes: DataFrame, edges: DataFrame, most: int = 2, placeholder: str = "placeholder") -> DataFrame:
    """Edges with at most ``most`` placeholder parents per child, smallest ids first."""
    marked = edges.join(nodes.select(F.col("id").alias("s"), F.col(placeholder).alias("_ph")), "s")
    w = Window.partitionBy("t", "_ph").orderBy("s")
    return marked.withColumn("_n", F.row_number().over(w)).where(~F.col("_ph") | (F.col("_n") <= most)).select("s", "t")


def repair_directions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose parent is of a higher generation than the child, or of unknown ones."""
    g = nodes.select("id", F.coalesce("gen", F.lit(-1)).alias("g"))
    e = edges.join(g.select(F.col("id").alias("s"), F.col("g").alias("gs")), "s").join(g.select(F.col("id").alias("t"), F.col("g").alias("gt")), "t")
    return e.where("gs > gt OR gs = -1 OR gt = -1").select("s", "t")


def over_parented(edges: DataFrame, most: int = 2) -> DataFrame:
    """Children with more than ``most`` parents."""
    return edges.groupBy(F.col("t").alias("id")).agg(F.count_distinct("s").alias("parents")).where(F.col("parents") > most)


def contract(nodes: DataFrame, edges: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge duplicates into canonical nodes: remap (dup, canon). Gaps of the canonical are filled.

    Chains of remaps are followed to their end, cycles go to their least id. Where the
    canonical isn't a node itself, the least of its duplicates gives the fields. Edges are
    rewritten, loops dropped.
    """
    from kinframe.operators.linking import flatten

    r = flatten(remap).withColumnRenamed("dup", "id")
    pointed = nodes.join(r, "id", "left").withColumn("canon", F.coalesce("canon", "id"))
    own = F.struct((F.col("id") != F.col("canon")).alias("other"), "id")
    fields = [c for c in nodes.columns if c != "id"]

    def filled(c: str):
        value = F.when(F.col(c).cast("string") != "", F.col(c))
        return F.min_by(value, F.when(value.isNotNull(), own)).alias(c)

    merged = pointed.groupBy("canon").agg(*(F.sum(c).alias(c) if c == "mult" else filled(c) for c in fields)).withColumnRenamed("canon", "id")
    e = edges
    for end in ("s", "t"):
        e = e.join(r.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("canon", end)).drop("canon")
    return merged.select("id", *fields), e.where("s <> t").select("s", "t").distinct()


def keep_connected(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes that the search reached or that have any edge."""
    ids = reached.select("id").unionByName(edges.select(F.explode(F.array("s", "t")).alias("id"))).distinct()
    return nodes.join(ids, "id", "left_semi")
