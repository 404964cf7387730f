"""Reports: conflicts, duplicate clusters, houses, flows, eras, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions import rules
from kinframe.functions import text as T


def relatives(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parents, children): sorted lists of ids."""
    up = edges.groupBy(F.col("t").alias("id")).agg(F.sort_array(F.collect_set("s")).alias("parents"))
    down = edges.groupBy(F.col("s").alias("id")).agg(F.sort_array(F.collect_set("t")).alias("children"))
    none = F.array().cast("array<long>")
    return nodes.select("id").join(up, "id", "left").join(down, "id", "left").select("id", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def conflicts(nodes: DataFrame, edges: DataFrame, second_source_from: int, most: int = 2) -> DataFrame:
    """Nodes with more than two parents, the parents split by source or else into halves."""
    about = nodes.select(F.col("id").alias("s"), F.col("name").alias("parent_name"))
    rows = edges.select("s", "t").distinct().join(about, "s")
    grouped = rows.groupBy(F.col("t").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("s").alias("id"), F.col("parent_name").alias("name")))).alias("parents"))
    first, second = (F.filter("parents", f) for f in (lambda p: p.id < second_source_from, lambda p: p.id >= second_source_from))
    half = F.floor(F.size("parents") / 2).cast("int")
    mixed = (F.size(first) > 0) & (F.size(second) > 0)
    out = grouped.where(F.size("parents") > most).join(nodes.select("id", "name", "gen"), "id")
    return out.select(
        "id", "name", "gen", F.size("parents").alias("n_parents"),
        F.when(mixed, first).otherwise(F.slice("parents", F.lit(1), half)).alias("group_a"),
        F.when(mixed, second).otherwise(F.slice("parents", half + 1, F.size("parents"))).alias("group_b"),
    )


def duplicate_clusters(nodes: DataFrame, edges: DataFrame, band: int = 5) -> DataFrame:
    """Probable duplicates: same review name and generation, births near a cluster's seed.

    Greedy leaders in id order: a node joins the first cluster whose seed's birth is
    unknown together with its own, or within ``band`` years; else it seeds a new one.
    Which cluster that is depends on the birth alone (when a birth first occurs its
    cluster exists or is made, and later ones come after it), so only the distinct births
    of a name are folded, in order of their first id: as many as there are years, however
    many people share a name.
    """
    year = F.when(F.col("birth") != 0, F.col("birth")).cast("int")
    people = nodes.select("id", "gen", T.norm_review(F.col("name")).alias("norm"), year.alias("birth"))
    births = people.groupBy("norm", "gen", "birth").agg(F.min("id").alias("first"))
    known = births.where("birth IS NOT NULL").groupBy("norm", "gen").agg(F.array_sort(F.collect_list(F.struct("first", "birth"))).alias("births"))

    def near(seed: Column, b: Column) -> Column:
        return F.abs(seed - b) <= band

    def add(seeds: Column, x: Column) -> Column:
        return F.when(F.exists(seeds, lambda s: near(s, x.birth)), seeds).otherwise(F.array_append(seeds, x.birth))

    seeds = F.aggregate("births", F.array().cast("array<int>"), add)
    known = known.withColumn("seeds", seeds).select("norm", "gen", F.explode("births.birth").alias("birth"), "seeds")
    seed_of = known.select(F.col("norm").alias("_n"), F.col("gen").alias("_g"), F.col("birth").alias("_b"), F.get(F.filter("seeds", lambda s: near(s, F.col("birth"))), F.lit(0)).alias("seed"))
    same = F.col("norm").eqNullSafe(F.col("_n")) & F.col("gen").eqNullSafe(F.col("_g")) & (F.col("birth") == F.col("_b"))
    placed = people.join(seed_of, same, "left").select("norm", "gen", "id", "seed")
    linked = edges.select(F.explode(F.array("s", "t")).alias("id")).distinct().withColumn("linked", F.lit(True))
    members = placed.join(linked, "id", "left")
    found = members.groupBy("norm", "gen", "seed").agg(F.array_sort(F.collect_list("id")).alias("ids"), (~F.coalesce(F.bool_or("linked"), F.lit(False))).alias("is_orphan"))
    return found.where(F.size("ids") > 1).select("norm", "gen", "ids", "is_orphan").orderBy("is_orphan", "gen", "norm", "ids")


def house_stats(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Houses with at least ``least`` members: size, span, counts by category."""
    cats = ("royal", "noble", "clergy", "military")
    agg = [F.count("*").alias("members"), F.min("birth").alias("first_birth"), F.max("birth").alias("last_birth")]
    agg += [F.count_if(F.col("cat") == c).alias(f"n_{c}") for c in cats]
    out = nodes.where(F.coalesce("house", F.lit("")) != "").groupBy("house").agg(*agg).where(F.col("members") >= least)
    return out.withColumn("slug", T.slug(F.col("house"))).withColumn("era", T.era_label(F.col("first_birth"), F.col("last_birth")))


def house_rank(stats: DataFrame) -> DataFrame:
    """Houses in index order: royals, nobles, size, name."""
    w = Window.orderBy(F.desc("n_royal"), F.desc("n_noble"), F.desc("members"), "house")
    return stats.withColumn("rank", F.row_number().over(w))  # one row per house


def house_members(nodes: DataFrame, oldest_first: bool = True) -> DataFrame:
    """Members with their place in their house; unknown births last."""
    birth = F.col("birth").asc_nulls_last() if oldest_first else F.col("birth").desc_nulls_last()
    return nodes.where(F.coalesce("house", F.lit("")) != "").withColumn("place", F.row_number().over(Window.partitionBy("house").orderBy(birth, "id")))


def house_nearest(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Per house the reachable member nearest to the root, else its oldest member."""
    rows = nodes.where(F.coalesce("house", F.lit("")) != "").join(reached.select("id", "depth"), "id", "left")
    near = F.min_by("id", F.when(F.col("depth").isNotNull(), F.struct("depth", "id")))
    oldest = F.min_by("id", F.struct(F.coalesce("birth", F.lit(9999)), "id"))
    return rows.groupBy("house").agg(F.coalesce(near, oldest).alias("id"), F.min("depth").alias("depth"))


def history_sentence(stats: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """A curated text per house (house, text), or a sentence made from its figures."""
    period = F.when(F.col("first_birth") < 1000, "early").when(F.col("first_birth") < 1200, "high").otherwise("late")
    kind = F.when(F.col("n_royal") > 1, "a royal house").when(F.col("n_noble") > 1, "a noble house").otherwise("a family")
    made = F.format_string("The house of %s was %s of the %s Middle Ages, with %d recorded members.", "house", kind, period, "members")
    if told is None:
        return stats.withColumn("history", made)
    return stats.join(told.select("house", "text"), "house", "left").withColumn("history", F.coalesce("text", made)).drop("text")


def place_coordinates(nodes: DataFrame, regions: DataFrame, countries: DataFrame) -> DataFrame:
    """Nodes with (lat, lng) of region, else country, moved by a small amount fixed by the id."""
    r = regions.select(F.col("place").alias("region"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    c = countries.select(F.col("place").alias("country"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    rows = nodes.join(r, "region", "left").join(c, "country", "left")
    lat, lng = F.coalesce("r_lat", "c_lat"), F.coalesce("r_lng", "c_lng")
    jitter = [(lat + F.sin(F.col("id") * 1.6180339887) * 0.45), (lng + F.cos(F.col("id") * 2.7182818284) * 0.70)]
    return rows.withColumn("lat", F.bround(jitter[0], 4)).withColumn("lng", F.bround(jitter[1], 4)).drop("r_lat", "r_lng", "c_lat", "c_lng")


def map_points(placed: DataFrame) -> DataFrame:
    """People with a birth year and a place."""
    return placed.where("birth IS NOT NULL AND birth <> 0 AND lat IS NOT NULL").withColumn("titles", F.substring("titles", 1, 80))


def thin(years: Column, gap: int = 25) -> Column:
    """Greedy thinning: each kept year is at least ``gap`` after the last kept one."""
    none = F.array().cast("array<int>")
    last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(-9999))
    return F.aggregate(F.array_sort(years), none, lambda kept, y: F.when(y - last(kept) >= gap, F.array_append(kept, y)).otherwise(kept))


def migration_flows(placed: DataFrame, edges: DataFrame, least_degrees: float = 1.5, americas_west_of: float = -40.0, contact: int = 1492, gap: int = 25) -> DataFrame:
    """(y, from_lat, from_lng, to_lat, to_lng): moves of a generation, thinned per pair of places."""
    p = map_points(placed).select("id", "lat", "lng", "birth")
    s, t = (p.select(F.col("id").alias(x), F.col("lat").alias(f"{x}_lat"), F.col("lng").alias(f"{x}_lng"), F.col("birth").cast("int").alias(f"{x}_year")) for x in "st")
    rows = edges.join(s, "s").join(t, "t").where(F.hypot(F.col("s_lat") - F.col("t_lat"), F.col("s_lng") - F.col("t_lng")) >= least_degrees)
    rows = rows.where(~((F.least("s_lng", "t_lng") < americas_west_of) & (F.col("t_year") < contact)))
    cells = [F.bround(c, 0).cast("int").alias(n) for c, n in (("s_lat", "from_lat"), ("s_lng", "from_lng"), ("t_lat", "to_lat"), ("t_lng", "to_lng"))]
    grouped = rows.groupBy(*cells).agg(F.collect_set("t_year").alias("years"))  # distinct years are bounded
    return grouped.select("from_lat", "from_lng", "to_lat", "to_lng", F.explode(thin(F.col("years"), gap)).alias("y"))


def flows_at(flows: DataFrame, years: DataFrame, window: int = 25, least: float = 0.12) -> DataFrame:
    """Flows shown at each year: those of the last ``window`` years, fading with their age.

    A flow is exploded to the years it is shown in, an equi join with the asked ones.
    """
    shown = flows.withColumn("year", F.explode(F.sequence(F.col("y"), F.col("y") + window)))
    rows = shown.join(years.select("year").distinct(), "year")
    return rows.withColumn("alpha", F.greatest(F.lit(least), 1 - (F.col("year") - F.col("y")) / window))


def merged_relations(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents and children of a duplicate cluster's members together: (key, role, id, n, shared).

    ``shared`` marks relatives that all members have.
    """
    members = clusters.select(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("key"), F.size("ids").alias("many"), F.explode("ids").alias("member"))
    up = members.join(edges.select(F.col("t").alias("member"), F.col("s").alias("id")), "member").withColumn("role", F.lit("parent"))
    down = members.join(edges.select(F.col("s").alias("member"), F.col("t").alias("id")), "member").withColumn("role", F.lit("child"))
    rows = up.unionByName(down).groupBy("key", "many", "role", "id").agg(F.count_distinct("member").alias("n"))
    return rows.select("key", "role", "id", "n", (F.col("n") == F.col("many")).alias("shared"))


def find_text(df: DataFrame, text: str, columns: list[str], **equal: str) -> DataFrame:
    """Rows whose columns hold a text, whatever its case, and equal the other conditions."""
    found = F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))
    for column, value in equal.items():
        found = found & (F.col(column) == value)
    return df.where(found)


def alive_at(people: DataFrame, years: DataFrame) -> DataFrame:
    """(year, id) of people shown at each year: born, and dead for at most 5 years or born within 80.

    The lifespans are exploded to the asked range, an equi join instead of a theta join.
    """
    bounds = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    end = F.when(F.coalesce("death", F.lit(0)) != 0, F.col("death") + 5).otherwise(F.col("birth") + 80)
    span = people.where("birth IS NOT NULL").crossJoin(F.broadcast(bounds)).select("id", F.greatest("birth", "lo").alias("a"), F.least(end, F.col("hi")).alias("b")).where("a <= b")  # one row
    return span.select("id", F.explode(F.sequence("a", "b")).alias("year")).join(years.select("year").distinct(), "year")


def era_counts(people: DataFrame, eras=rules.ERAS) -> DataFrame:
    return people.groupBy(rules.era_of(F.col("birth"), eras).alias("era")).agg(F.count("*").alias("n"))


def top_by(df: DataFrame, column: str, most: int, ties: str) -> DataFrame:
    """Top rows by a count, with an explicit order for ties."""
    return df.orderBy(F.desc(column), ties).limit(most)


def generation_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("gen").agg(F.count("*").alias("n"))


def tag_source(nodes: DataFrame, second_from: int, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Nodes with the source they come from, by the first id of the second one."""
    return nodes.withColumn("source", F.when(F.col("id") < second_from, names[0]).otherwise(names[1]))


def with_decisions(candidates: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Candidates with their reviewers' decisions; null where there is none."""
    return candidates.join(decisions.select(key, "decision"), key, "left")


def apply_conflict_decisions(edges: DataFrame, conflicts_: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges without the parents that were decided against (keep-a drops group b, keep-b group a)."""
    decided = with_decisions(conflicts_, decisions)
    gone = F.when(F.col("decision") == "keep-a", F.col("group_b")).when(F.col("decision") == "keep-b", F.col("group_a"))
    drop = decided.where(gone.isNotNull()).select(F.col("id").alias("t"), F.explode(gone).alias("p")).select("t", F.col("p.id").alias("s"))
    return edges.join(drop, ["s", "t"], "left_anti")


def merge_decisions(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Remap (dup, canon) of clusters decided as merge-first or merge-last; key: ids joined by commas."""
    keyed = clusters.withColumn("key", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    rows = keyed.join(decisions.select("key", "decision"), "key").where(F.col("decision").isin("merge-first", "merge-last"))
    canon = F.when(F.col("decision") == "merge-first", F.col("ids")[0]).otherwise(F.element_at("ids", -1))
    return rows.select(F.explode("ids").alias("dup"), canon.alias("canon")).where("dup <> canon")
