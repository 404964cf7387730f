"""Entity matching: by name, by family position, change sets, graph extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions import text as T
from kinframe.operators.tables import cut, cut_counted, drop, filled

#: fixed values: what stands for no region
JUNK_REGIONS = ("", "?", "unknown", "n/a", "-")


def match_by_name(people: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ged_id, id): the first variant of a person that names a node, and its first node.

    people: ged_id, variants ARRAY<STRING>; nodes: id, name.
    """
    wanted = people.select("ged_id", F.posexplode("variants").alias("ord", "variant")).withColumn("norm", T.norm_gedcom(F.col("variant")))
    named = nodes.groupBy(T.norm_gedcom(F.col("name")).alias("norm")).agg(F.min("id").alias("id"))
    return wanted.join(named, "norm").groupBy("ged_id").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))


def match_by_position(people: DataFrame, person_edges: DataFrame, nodes: DataFrame, node_edges: DataFrame, matched: DataFrame, max_passes: int | None = None) -> DataFrame:
    """Extend (ged_id, id): unmatched parents of matched children with the same first word.

    people: ged_id, first, ord; nodes: id, first; edges: s parent, t child. One-to-one;
    competing candidates go by ord, then by node id. Repeats until nothing is found, or
    ``max_passes`` times. A pass joins only the matches of the last one; candidates that lost
    wait, and go when either side is matched.
    """
    found = cut(matched.select("ged_id", "id"))
    p = people.select(F.col("ged_id").alias("g"), F.col("first").alias("fw"), "ord")
    n = nodes.select(F.col("id").alias("h"), F.col("first").alias("fw"))
    up = person_edges.select(F.col("s").alias("g"), F.col("t").alias("ged_id"))
    node_up = node_edges.select(F.col("s").alias("h"), F.col("t").alias("child"))
    new, pool, passes = found, None, 0
    while max_passes is None or passes < max_passes:
        passes += 1
        # only what the last pass has matched brings candidates; those of before wait in the pool
        fresh = up.join(new, "ged_id").select("g", F.col("id").alias("child")).join(node_up, "child").join(p, "g").join(n, ["h", "fw"]).select("g", "h", "ord").distinct()
        fresh = _free(fresh, found)
        waiting = fresh if pool is None else _free(pool, new).unionByName(fresh).distinct()
        waiting = cut(waiting)
        if pool is not None:
            drop(pool)
        pool = waiting
        per_person = pool.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where("k = 1")
        one = per_person.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("ord", "g"))).where("k = 1")
        matches, many = cut_counted(one.select(F.col("g").alias("ged_id"), F.col("h").alias("id")))
        if new is not found:
            drop(new)
        if not many:
            drop(matches)
            break
        new = matches
        more = cut(found.unionByName(new))
        drop(found)
        found = more
    if pool is not None:
        drop(pool)
    return found


def _free(candidates: DataFrame, matched: DataFrame) -> DataFrame:
    """Candidates (g, h) neither of which is matched."""
    taken = matched.select(F.col("ged_id").alias("g")), matched.select(F.col("id").alias("h"))
    return candidates.join(taken[0], "g", "left_anti").join(taken[1], "h", "left_anti")


def _change(field: str, old: Column, new: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new")))


def change_set(matches: DataFrame, people: DataFrame, nodes: DataFrame, policy: str = "overwrite", root: int | None = None) -> DataFrame:
    """Long table (id, field, old, new) of updates that matched people bring.

    people: ged_id, name, birth, death, country, region. ``overwrite`` replaces
    differing years, ``fill`` only sets missing ones. A name is replaced by one that
    differs and isn't shorter, never the root's. Of several people matched to a node the
    last (largest ged_id) decides.
    """
    last = matches.groupBy("id").agg(F.max("ged_id").alias("ged_id"))
    g = people.select("ged_id", *(F.col(c).alias(f"g_{c}") for c in ("name", "birth", "death", "country", "region")))
    rows = last.join(g, "ged_id").join(nodes, "id")
    year = lambda c: F.col(f"g_{c}").isNotNull() & (F.col(c).isNull() if policy == "fill" else ~F.col(c).eqNullSafe(F.col(f"g_{c}")))
    text = lambda c: filled(F.col(f"g_{c}")).isNotNull() & filled(F.col(c)).isNull()
    renamed = filled(F.col("g_name")).isNotNull() & (T.norm_gedcom(F.col("g_name")) != T.norm_gedcom(F.col("name"))) & (F.length("g_name") >= F.length("name"))
    if root is not None:
        renamed = renamed & (F.col("id") != root)
    changes = F.array_compact(F.array(
        _change("name", F.col("name"), F.col("g_name"), renamed),
        _change("birth", F.col("birth"), F.col("g_birth"), year("birth")),
        _change("death", F.col("death"), F.col("g_death"), year("death")),
        _change("country", F.lit(""), F.col("g_country"), text("country")),
        _change("region", F.lit(""), F.col("g_region"), text("region") & ~F.lower("g_region").isin(*JUNK_REGIONS)),
    ))
    return rows.select("id", F.inline(changes))


def apply_changes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the change set applied (a new version; nothing is rewritten in place)."""
    fields = [c for c in ("name", "birth", "death", "country", "region") if c in nodes.columns]
    wide = changes.groupBy("id").agg(*(F.max(F.when(F.col("field") == c, F.col("new"))).alias(f"new_{c}") for c in fields))
    kinds = dict(nodes.dtypes)
    out = nodes.join(wide, "id", "left").withColumns({c: F.coalesce(F.col(f"new_{c}").cast(kinds[c]), F.col(c)) for c in fields})
    return out.select(nodes.columns)


def extend_graph(nodes: DataFrame, edges: DataFrame, people: DataFrame, person_edges: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append unmatched people (by generation, then ged_id) and the edges that are missing."""
    from kinframe.operators.outline import dense_ids

    new = people.join(matches.select("ged_id"), "ged_id", "left_anti").withColumn("first_seen", F.struct("gen", "ged_id"))
    top = nodes.agg(F.max("id").alias("top")).first()["top"]
    numbered = cut(dense_ids(new, start=0 if top is None else top + 1).drop("first_seen"))
    ids = matches.select("ged_id", "id").unionByName(numbered.select("ged_id", "id"))
    made = numbered.select("id", "name", "gen", "birth", "death", F.lit("untitled").alias("cat"), F.lit(1).cast("long").alias("mult"))
    e = person_edges.join(ids.withColumnRenamed("ged_id", "s").withColumnRenamed("id", "si"), "s").join(ids.withColumnRenamed("ged_id", "t").withColumnRenamed("id", "ti"), "t")
    more = e.select(F.col("si").alias("s"), F.col("ti").alias("t")).where("s <> t").distinct()
    added = more.join(edges.select("s", "t"), ["s", "t"], "left_anti")
    return nodes.unionByName(made, allowMissingColumns=True), edges.select("s", "t").unionByName(added)


def family_edges(families: DataFrame) -> DataFrame:
    """Parent and child pairs of families (husb, wife, chil ARRAY)."""
    return families.select(F.explode(F.array_compact(F.array("husb", "wife"))).alias("s"), "chil").select("s", F.explode("chil").alias("t")).distinct()


def branch(people: DataFrame, person_edges: DataFrame, start: str) -> DataFrame:
    """A person's ancestors with dense ids in breadth-first order (ged_id, gen, id)."""
    from kinframe.operators.outline import dense_ids

    up = cut(person_edges.select(F.col("t").alias("ged_id"), "s").distinct())
    frontier, many = cut_counted(people.where(F.col("ged_id") == start).select("ged_id", F.lit(0).alias("gen")).distinct())
    seen, gen, written = frontier, 0, [up, frontier]
    while many:
        gen += 1
        found = frontier.join(up, "ged_id").select(F.col("s").alias("ged_id")).distinct()
        frontier, many = cut_counted(found.join(seen.select("ged_id"), "ged_id", "left_anti").select("ged_id", F.lit(gen).alias("gen")))
        written.append(frontier)
        seen = seen.unionByName(frontier)
    seen = cut(seen)
    drop(*written)
    return dense_ids(seen.withColumn("first_seen", F.struct("gen", "ged_id"))).drop("first_seen")


def surname_matches(entries: DataFrame, surnames: DataFrame, text: Column) -> DataFrame:
    """Entries joined with a surname dictionary (surname, display, priority) on whole words.

    A key may have several words or marks between them. It is an equi join of the entry's
    runs of as many words as keys have (the few lengths that occur), never a theta join;
    what meets is held against the key with its marks, between word boundaries. Runs carry
    the number of their entry alone, and only what meets is joined with the entries again:
    a text is moved once, not once per word.
    """
    word = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), F.lit(1))
    keys = surnames.select("surname", "display", "priority", T.norm_voyage(F.col("surname")).alias("_key")).withColumn("_words", word(F.col("_key"))).where(F.size("_words") > 0)
    keys = cut(keys.withColumn("_run", F.array_join("_words", " ")).dropDuplicates(["_key", "display"]), merged=False)
    plain = F.col("_key").rlike(r"(?U)^\w+$")
    kinds = keys.select(F.size("_words"), plain).distinct().collect()
    lengths = sorted({n for n, _ in kinds})
    # written once, so that both joins speak of the same numbers
    rows = cut(entries.withColumn("_id", F.monotonically_increasing_id()))
    worded = rows.select("_id", word(T.norm_voyage(text)).alias("_words"))

    def runs(n: int) -> Column:
        begin = F.sequence(F.lit(1), F.size("_words") - n + 1)
        return F.when(F.size("_words") >= n, F.transform(begin, lambda i: F.array_join(F.slice("_words", i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs_of = F.col("_words") if lengths == [1] else F.concat(*(runs(n) for n in lengths)) if lengths else F.array().cast("array<string>")
    met = worded.select("_id", F.explode(F.array_distinct(runs_of)).alias("_run")).join(keys.drop("_words"), "_run")
    found = rows.join(met, "_id")
    if not all(alone for _, alone in kinds):
        bounded = F.concat(F.lit(r"(?U)\b\Q"), F.col("_key"), F.lit(r"\E\b"))
        found = found.where(plain | F.regexp_like(T.norm_voyage(text), bounded))
    return found.drop("_id", "_run", "_key")
