"""From outline lines to a graph: stitching, cleaning, keys, links, collapse, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions import rules
from kinframe.functions import text as T
from kinframe.operators.asof import STRETCH, asof_parent, last_seen
from kinframe.operators.tables import cut, filled, first_known

ENTRY = r"^\s*(\d+)\.\s+(.*\S)\s*$"
HEADER = r"^(Ancestors of|Exported from)\b"


def stitch(lines: DataFrame, entry: str = ENTRY, header: str = HEADER, stretch: int | None = STRETCH) -> DataFrame:
    """(src, pos, line) to occurrences (src, pos, gen, raw_text).

    A line that matches ``entry`` opens an occurrence; later lines are appended with a
    blank; blank lines, headers and lines before the first entry are dropped. Each line finds
    the last entry at or before it; ``stretch`` positions of a source are one task's at a time,
    and an entry may go on over any number of them.
    """
    kept = lines.where((F.trim("line") != "") & ~F.col("line").rlike(header))
    marked = kept.withColumn("opens", F.col("line").rlike(entry))
    opened = last_seen(marked, F.when(F.col("opens"), F.col("pos")), ["src"], "pos", "grp", stretch=stretch)
    part = F.struct("pos", F.when(F.col("opens"), F.regexp_extract("line", entry, 2)).otherwise(F.trim("line")).alias("t"))
    grouped = opened.where("grp IS NOT NULL").groupBy("src", "grp").agg(
        F.min("pos").alias("pos"),
        F.max(F.when(F.col("opens"), F.regexp_extract("line", entry, 1).cast("int"))).alias("gen"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    return grouped.select("src", "pos", "gen", F.array_join(F.transform("parts", lambda p: p.t), " ").alias("raw_text"))


def clean(occurrences: DataFrame) -> DataFrame:
    """Names, years, country, region and house of occurrences."""
    # columns of their own for what is used more than once, as Spark works out a column once
    placed = occurrences.withColumn("_at", T.vital_at(F.col("raw_text")))
    name, born, died = T.split_vitals(F.col("raw_text"), F.col("_at"))
    rows = placed.select("src", "pos", "gen", name.alias("_name"), born.alias("b"), died.alias("d"))
    rows = rows.withColumn("name", F.coalesce(filled(F.col("_name")), F.lit("Unknown"))).withColumn("_country", rules.country_of(F.col("b")))
    return rows.select(
        "src", "pos", "gen", "name",
        T.parse_year(F.col("b")).alias("birth"),
        T.parse_year(F.col("d")).alias("death"),
        F.coalesce(filled(F.col("_country")), rules.country_of(F.col("d"))).alias("country"),
        rules.region_of(F.col("name")).alias("region"),
        rules.house_of(F.col("name")).alias("house"),
    )


def node_key(name: Column, birth: Column, unique: Column, dedupe: bool = True, bilingual: bool = False, normal: Column | None = None) -> Column:
    """Identity of a person: normal name and birth year, or ``unique`` for placeholders.

    ``bilingual`` drops prepositions and unifies title words, for rebuilt graphs; ``normal`` is
    the normal name if it is known.
    """
    normal = T.norm(name) if normal is None else normal
    alone = rules.is_placeholder(normal, rules.WIDE_PLACEHOLDER if bilingual else rules.PLACEHOLDER, 4)
    shown = rules.language_key(normal) if bilingual else normal
    own = F.concat(F.lit("_u"), unique.cast("string"), F.lit("::"), F.coalesce(filled(normal), F.lit("unknown")))
    shared = F.concat(shown, F.lit("|"), F.coalesce(birth.cast("string"), F.lit("?")))
    return F.when(alone, own).otherwise(shared) if dedupe else own


def keyed(people: DataFrame, dedupe: bool = True) -> DataFrame:
    """People with their keys; placeholders never fuse, as their key holds source and place."""
    named = people.withColumn("_normal", T.norm(F.col("name")))
    key = node_key(F.col("name"), F.col("birth"), F.concat_ws(":", "src", "pos"), dedupe, normal=F.col("_normal"))
    return named.withColumn("key", key).drop("_normal")


def edges_of(keyed_people: DataFrame) -> DataFrame:
    """Distinct parent -> child keys by the as-of rule."""
    linked = asof_parent(keyed_people)
    return linked.where("child_key IS NOT NULL").select(F.col("key").alias("s"), F.col("child_key").alias("t")).distinct()


def collapse(keyed_people: DataFrame) -> DataFrame:
    """One node per key: first name and country, count, least generation, first known rest."""
    order = F.struct("src", "pos")
    return keyed_people.groupBy("key").agg(
        F.min(order).alias("first_seen"),
        F.min_by("name", order).alias("name"),
        F.min("gen").alias("gen"),
        first_known(F.col("birth"), order).alias("birth"),
        first_known(F.col("death"), order).alias("death"),
        F.min_by("country", order).alias("country"),
        F.coalesce(first_known(filled(F.col("region")), order), F.lit("")).alias("region"),
        F.coalesce(first_known(filled(F.col("house")), order), F.lit("")).alias("house"),
        F.count("*").alias("mult"),
    )


def titled(nodes: DataFrame) -> DataFrame:
    """Nodes with category and title phrase."""
    return nodes.withColumn("cat", rules.classify(F.col("name"))).withColumn("titles", rules.title_phrase(F.col("name"), F.col("cat")))


def dense_ids(nodes: DataFrame, order: str = "first_seen", start: int = 0) -> DataFrame:
    """Ids 0, 1, ... in an explicit order.

    Counts per range of the order are summed, so no task sees all rows: the rows are
    range-partitioned, numbered inside a partition, and offset by the rows before. The
    numbered rows are written once, so that rows and counts speak of the same ranges
    (ranges are sampled anew, and joined anew by adaptive execution, in each plan).
    """
    ranged = nodes.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    inside = cut(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order))))
    before = inside.groupBy("_p").agg(F.count("*").alias("n"))
    offset = before.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_o"))  # one row per partition
    return inside.join(F.broadcast(offset), "_p").withColumn("id", F.col("_i") + F.col("_o") - 1 + start).drop("_p", "_i", "_o")


def translate_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between keys as edges between ids; an edge with an unknown end is dropped."""
    a, b = (ids.select(F.col("key").alias(x), F.col("id").alias(f"{x}_id")) for x in ("s", "t"))
    return edges.join(a, "s").join(b, "t").select(F.col("s_id").alias("s"), F.col("t_id").alias("t"))


def build(lines: DataFrame, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of outline lines (src, pos, line)."""
    people = keyed(clean(stitch(lines)), dedupe)
    nodes = dense_ids(titled(collapse(people)))
    return nodes, translate_edges(edges_of(people), nodes)


def legend(nodes: DataFrame) -> DataFrame:
    """Present categories in their fixed order, with labels, colours and counts."""
    rows = [(i, *row[:3]) for i, row in enumerate((*rules.CATEGORIES, rules.UNTITLED))]
    table = nodes.sparkSession.createDataFrame(rows, "ord int, cat string, label string, color string")
    return nodes.groupBy("cat").agg(F.count("*").alias("n")).join(F.broadcast(table), "cat").orderBy("ord")


def summary(nodes: DataFrame) -> DataFrame:
    """People, generations and the span of birth years."""
    return nodes.agg(F.count("*").alias("people"), F.max("gen").alias("generations"), F.min("birth").alias("first_birth"), F.max("birth").alias("last_birth"))


def verify(nodes: DataFrame, edges: DataFrame, root_gen: int = 1) -> DataFrame:
    """Integrity checks in one row: root, inverted edges by birth order, loops, repeats."""
    about = nodes.select("id", "gen", "birth")
    s, t = (about.select(F.col("id").alias(x), F.col("gen").alias(f"{x}_gen"), F.col("birth").alias(f"{x}_birth")) for x in "st")
    e = edges.join(s, "s").join(t, "t")
    inverted = F.col("s_gen") < F.col("t_gen")
    known = F.col("s_birth").isNotNull() & F.col("t_birth").isNotNull()
    checks = e.agg(
        F.count_if(inverted).alias("inverted"),
        F.count_if(inverted & known & (F.col("s_birth") <= F.col("t_birth"))).alias("year_ok"),
        F.count_if(inverted & known & (F.col("s_birth") > F.col("t_birth"))).alias("year_fail"),
        F.count_if(inverted & ~known).alias("year_skip"),
        F.count_if(F.col("s") == F.col("t")).alias("self_loops"),
        F.count_if((F.col("t_gen") == root_gen) & (F.col("s_gen") != root_gen + 1)).alias("root_bad_edges"),
        F.count("*").alias("edges"),
    )
    distinct = edges.distinct().agg(F.count("*").alias("distinct_edges"))
    roots = nodes.agg(F.count_if(F.col("gen") == root_gen).alias("roots"))
    return roots.crossJoin(checks).crossJoin(distinct)  # three single rows
