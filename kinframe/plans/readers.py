"""Queries of the readers and of what appends to a graph: files, legends, known keys, names, branches, extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions import display, rules
from kinframe.functions import text as T
from kinframe.operators import graph, matching, outline, reports
from kinframe.plans.catalog import _BFS, _STATS, WITH_OUTLINE, WITH_PEOPLE, _t, query
from kinframe.plans.relations import LAYERS, OUTLINE, PEDIGREE, PEOPLE, oracle, relation, spread
from kinframe.plans.structure import _new_folder
from kinframe.sources import gedcom
from kinframe.sources import graphs as G
from kinframe.sources import lines as L

# ---- files ------------------------------------------------------------------


@query("outline_files")
def _outline_files(spark, sf):
    """Outlines written as text files, one per source, found and read again, put together and cleaned."""
    people = relation(spark, sf, OUTLINE)
    born = F.when(F.col("birth").isNotNull(), F.concat(F.lit(" b. "), F.col("birth").cast("string"))).otherwise("")
    folder = _new_folder(spark, "outlines")
    text = people.select("src", "pos", F.concat(F.col("gen").cast("string"), F.lit(". "), "name", born).alias("value"))
    L.write_files(text.repartition("src").sortWithinPartitions("src", "pos").drop("pos"), "src", folder)
    read = outline.clean(outline.stitch(L.split_lines(L.read_folder(spark, folder))))
    return read.select(F.regexp_extract("src", r"/src=(\d+)/", 1).cast("long").alias("src"), (F.col("pos") + 1).alias("pos"), "gen", "name", "birth")


@query("graph_files")
def _graph_files(spark, sf):
    """People written as graph files, JSON and pages in turn, of a thousand each; their nodes read again."""
    people = relation(spark, sf, PEOPLE).withColumn("file", F.floor(F.col("id") / 1000))
    whole = people.groupBy("file").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name", "gen", "birth", "cat", "mult")).alias("nodes"), F.array().alias("edges"))).alias("json"))
    page = F.concat(F.lit("<script>const GRAPH = "), F.col("json"), F.lit(";</script>"))
    folder = _new_folder(spark, "graphs")
    L.write_files(whole.select("file", F.when(F.col("file") % 2 == 0, F.col("json")).otherwise(page).alias("value")), "file", folder)
    return G.nodes_of(G.graphs_in(L.read_folder(spark, folder))).select("id", "name", "gen", "birth", "cat", "mult")


@query("legend_meta", """SELECT CAST(c_custkey AS BIGINT) AS id, 'Line of ' || c_custkey AS title, 'segment ' || c_nationkey AS subtitle, 'k' || c_nationkey || ';royal' AS keys, 'Label ' || c_custkey || ';Royalty' AS labels FROM customer""")
def _legend_meta(spark, sf):
    """The legend and the titles that pages carry beside their graph."""
    c = _t(spark, sf, "customer")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    entry = lambda k, label: F.struct(k.alias("key"), label.alias("label"), F.lit("#e8b820").alias("color"))
    legend = F.to_json(F.array(entry(F.concat(F.lit("k"), nation), F.concat(F.lit("Label "), key)), entry(F.lit("royal"), F.lit("Royalty"))))
    meta = F.to_json(F.struct(F.concat(F.lit("Line of "), key).alias("title"), F.concat(F.lit("segment "), nation).alias("subtitle")))
    html = F.concat(F.lit("<script>const LEGEND = "), legend, F.lit(";\nconst META = "), meta, F.lit(";</script>"))
    read = c.select(F.col("c_custkey").alias("id"), G.legend_of(html).alias("legend"), G.meta_of(html).alias("meta"))
    joined = lambda f: F.array_join(F.transform("legend", lambda e: e[f]), ";")
    return read.select("id", "meta.title", "meta.subtitle", joined("key").alias("keys"), joined("label").alias("labels"))


#: People of whom some have names that stand for nobody.
NAMELESS = """
SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 40 AS INT) AS gen, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(900 + (p_partkey * 13) % 1000 AS INT) END AS birth,
       CASE p_partkey % 16 WHEN 0 THEN 'N.N.' WHEN 1 THEN 'n n' WHEN 2 THEN '(No name)' WHEN 3 THEN 'Desconocido' WHEN 4 THEN 'MOTHER' WHEN 5 THEN '-' WHEN 6 THEN 'Motherwell' WHEN 7 THEN 'Ana' ELSE p_name END AS name
FROM {part}
"""


@query("known_keys", f"""WITH x AS ({oracle(NAMELESS)}) SELECT DISTINCT lower(name) || '|' || coalesce(CAST(birth AS VARCHAR), '?') AS key FROM x WHERE id % 16 = 6 OR id % 16 > 7""")
def _known_keys(spark, sf):
    """Keys of the people of many graphs; those whose names stand for nobody, or are too short, have none."""
    people = relation(spark, sf, NAMELESS)
    files = people.groupBy(F.floor(F.col("id") / 1000).cast("string").alias("src")).agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name", "gen", "birth")).alias("nodes"), F.array().alias("edges"))).alias("json"))
    return G.known_keys(files.select("src", G.graph_of(F.col("json")).alias("graph")))


@query("placeholder_names", f"""WITH x AS ({oracle(LAYERS)}) SELECT s, t FROM x WHERE (s % 16 > 5) AND (t % 16 > 5)""")
def _placeholder_names(spark, sf):
    """Edges that stay when people are removed by the pattern of their names."""
    nodes = relation(spark, sf, NAMELESS).withColumn("placeholder", rules.is_placeholder(T.norm_gedcom(F.col("name"))))
    return graph.remove_placeholders(nodes, relation(spark, sf, LAYERS))[1]


#: The names that a GEDCOM record of a part gives, besides the name itself.
@query("gedcom_names", """WITH v AS (SELECT p_partkey, p_name || ' ' || p_brand AS a, CASE WHEN p_partkey % 3 > 0 THEN p_type || ' de la Torre' END AS b, p_type || ' Sol' AS c, p_name || ' ' || p_brand || ' (el viejo)' AS d FROM part),
u AS (SELECT p_partkey, unnest([a, b, c]) AS n FROM v)
SELECT '@I' || p_partkey || '@' AS ged_id, arg_min(n, lpad(CAST(1000 - length(n) AS VARCHAR), 4, '0') || n) AS name, CAST(1500 + p_partkey % 300 AS BIGINT) AS birth, 'Spain' AS country FROM u WHERE n IS NOT NULL GROUP BY p_partkey""")
def _gedcom_names(spark, sf):
    """The best of the names that records give: the longest without annotations; married and own surnames are joined to the given name."""
    k, lit = F.col("p_partkey").cast("string"), F.lit
    line = lambda *parts: F.concat(*parts)
    married = F.when(F.col("p_partkey") % 3 > 0, lit("2 _MARNM de la Torre"))
    rows = F.array_compact(F.array(
        line(lit("0 @I"), k, lit("@ INDI")), line(lit("1 NAME "), "p_name", lit(" /"), "p_brand", lit("/")), line(lit("2 GIVN "), "p_type"), lit("2 SURN Sol"), married,
        line(lit("1 NAME "), "p_name", lit(" /"), "p_brand", lit("/ (el viejo)")), lit("1 BIRT"), line(lit("2 DATE 3 MAY "), (1500 + F.col("p_partkey") % 300).cast("string")), lit("2 ADDR"), lit("3 CTRY Spain")))
    lines = spread(_t(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")).select(F.floor(F.col("p_partkey") / 1000).cast("string").alias("src"), "p_partkey", F.posexplode(rows).alias("i", "line"))
    found = gedcom.people(gedcom.individuals(lines.select("src", (F.col("p_partkey") * 20 + F.col("i")).alias("pos"), "line")))
    return found.select("ged_id", "name", "birth", "country")


# ---- ids, branches, extensions ----------------------------------------------


@query("translated_edges", f"""WITH {WITH_OUTLINE},
u AS (SELECT src, pos, gen, key, gen AS lvl, 1 AS d FROM o UNION ALL SELECT src, pos, gen, key, gen - 1, 0 FROM o),
w AS (SELECT *, last_value(CASE WHEN d = 1 THEN key END IGNORE NULLS) OVER (PARTITION BY src, lvl ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM u),
x AS (SELECT DISTINCT key AS s, c AS t FROM w WHERE d = 0 AND gen > 1 AND c IS NOT NULL AND c <> key),
i AS (SELECT key, row_number() OVER (ORDER BY min(src * 1000000 + pos)) - 1 AS id FROM o GROUP BY key)
SELECT CAST(a.id AS BIGINT) AS s, CAST(b.id AS BIGINT) AS t FROM x JOIN i a ON a.key = x.s JOIN i b ON b.key = x.t""")
def _translated_edges(spark, sf):
    people = relation(spark, sf, OUTLINE)
    return outline.translate_edges(outline.edges_of(people), outline.dense_ids(outline.collapse(people)))


@query("branch_ids", f"{_BFS} SELECT 'g' || CAST(id AS VARCHAR) AS ged_id, CAST(depth AS BIGINT) AS gen, CAST(row_number() OVER (ORDER BY depth, 'g' || CAST(id AS VARCHAR)) - 1 AS BIGINT) AS id FROM m")
def _branch_ids(spark, sf):
    name = lambda c: F.concat(F.lit("g"), F.col(c).cast("string"))
    people = relation(spark, sf, PEOPLE).select(name("id").alias("ged_id"))
    return matching.branch(people, relation(spark, sf, PEDIGREE).select(name("s").alias("s"), name("t").alias("t")), "g0").select("ged_id", "gen", "id")


def _extended(spark, sf):
    """Three of four people are known; a file names every second one, and those that are new come with their edges."""
    name = lambda c: F.concat(F.lit("g"), F.col(c).cast("string"))
    people, edges = relation(spark, sf, PEOPLE), relation(spark, sf, LAYERS)
    file = people.where("id % 2 = 0").select(name("id").alias("ged_id"), "id", "name", "gen", "birth", "death")
    matches = file.where("id % 4 = 2").select("ged_id", "id")
    of_file = edges.where("s % 2 = 0 AND t % 2 = 0").select(name("s").alias("s"), name("t").alias("t"))
    return matching.extend_graph(people.where("id % 4 <> 0"), edges.where("s % 4 <> 0 AND t % 4 <> 0"), file.drop("id"), of_file, matches)


_EXTENDED = f"""{WITH_PEOPLE}, new AS (SELECT id AS old, (SELECT max(id) FROM n WHERE id % 4 <> 0) + row_number() OVER (ORDER BY gen, 'g' || CAST(id AS VARCHAR)) AS id, name, gen, birth FROM n WHERE id % 4 = 0),
i AS (SELECT old, id FROM new UNION ALL SELECT id, id FROM n WHERE id % 4 = 2)"""


@query("extended_nodes", f"WITH {_EXTENDED} SELECT CAST(id AS BIGINT) AS id, name, CAST(gen AS BIGINT) AS gen, CAST(birth AS BIGINT) AS birth FROM (SELECT id, name, gen, birth FROM n WHERE id % 4 <> 0 UNION ALL SELECT id, name, gen, birth FROM new)")
def _extended_nodes(spark, sf):
    return _extended(spark, sf)[0].select("id", "name", "gen", "birth")


@query("extended_edges", f"""WITH {_EXTENDED}, x AS ({oracle(LAYERS)}) SELECT CAST(s AS BIGINT) AS s, CAST(t AS BIGINT) AS t FROM x WHERE s % 4 <> 0 AND t % 4 <> 0
UNION SELECT a.id, b.id FROM x JOIN i a ON a.old = x.s JOIN i b ON b.old = x.t WHERE x.s % 2 = 0 AND x.t % 2 = 0""")
def _extended_edges(spark, sf):
    return _extended(spark, sf)[1]


# ---- display ----------------------------------------------------------------


@query("house_badges", f"""WITH {_STATS}, y AS (SELECT house, CASE WHEN n_royal > 0 AND n_noble > 0 THEN 'Royal,Noble' WHEN n_royal > 0 THEN 'Royal' WHEN n_noble > 0 THEN 'Noble' ELSE 'Untitled' END AS kinds FROM st)
SELECT house, kinds, '<span class="badge house">' || kinds || '</span>' AS badge FROM y""")
def _house_badges(spark, sf):
    stats = reports.house_stats(relation(spark, sf, PEOPLE))
    typed = stats.withColumn("kinds", display.house_type(F.col("n_royal"), F.col("n_noble"), F.lit(0)))
    return typed.select("house", "kinds", display.badge(F.col("kinds"), F.lit("house")).alias("badge"))


@query("kin_equivalents", """WITH x AS (SELECT p_partkey AS id, CAST((p_partkey % 60) / 200.0 AS DOUBLE) AS f FROM part),
r AS (SELECT * FROM (VALUES (CAST(0.25 AS DOUBLE), 'full siblings or parent and child'), (0.125, 'half siblings or uncle and niece'), (0.0625, 'first cousins'), (0.03125, 'first cousins once removed'), (0.015625, 'second cousins')) AS v(ref, relation))
SELECT id, arg_min(relation, abs(f - ref)) AS relation FROM x CROSS JOIN r GROUP BY id""")
def _kin_equivalents(spark, sf):
    f = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 60) / F.lit(200.0)).alias("f"))
    return graph.equivalent(f).select("id", "relation")
