"""Registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinframe.functions import display, naming, rules
from kinframe.functions import text as T
from kinframe.operators import graph, matching, merge, outline, reports
from kinframe.operators.asof import asof_header, asof_parent
from kinframe.plans.relations import EDGES, LAYERS, OUTLINE, PEDIGREE, PEOPLE, SOURCES, oracle, plain, relation, spread
from kinframe.sources import catalogue, gedcom
from kinframe.sources import graphs as G
from kinframe.sources import lines as L
from kinframe.sources import search
from kinframe.streaming.incremental import merge_batch

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

WITH_EDGES = f"e AS ({oracle(EDGES)})"
WITH_PEOPLE = f"n AS ({oracle(PEOPLE)})"
WITH_OUTLINE = f"o AS ({oracle(OUTLINE)})"
WITH_SOURCES = f"f AS ({oracle(SOURCES)})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        _queries[name] = lambda spark, sf_dir: plain(run(spark, sf_dir))
        if sql:
            _oracles[name] = sql
        return run

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_t(spark, sf, "documents").select("doc_id", "text"))


def _roots(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline -> as-of links -> collapse -> ids -> path counts -> implex by generation."""
    people = relation(spark, sf_dir, OUTLINE)
    nodes = outline.dense_ids(outline.collapse(people))
    edges = outline.translate_edges(outline.edges_of(people), nodes)
    root = nodes.orderBy("gen", "id").limit(1).select("id").first()["id"]
    return graph.implex(graph.path_counts(edges, root)).withColumn("gen", F.col("gen").cast("bigint"))  # places of 25 generations outgrow a BIGINT


# ---- outline ----------------------------------------------------------------


@query("outline_link", f"""WITH {WITH_OUTLINE},
u AS (SELECT src, pos, gen, key, gen AS lvl, 1 AS d FROM o UNION ALL SELECT src, pos, gen, key, gen - 1, 0 FROM o),
w AS (SELECT *, last_value(CASE WHEN d = 1 THEN key END IGNORE NULLS) OVER (PARTITION BY src, lvl ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM u)
SELECT src, pos, CAST(gen AS BIGINT) AS gen, key, c AS child_key FROM w WHERE d = 0 AND gen > 1 AND c IS NOT NULL AND c <> key""")
def _outline_link(spark, sf):
    return asof_parent(relation(spark, sf, OUTLINE)).where("child_key IS NOT NULL").select("src", "pos", "gen", "key", "child_key")


@query("pedigree_collapse", f"""WITH {WITH_OUTLINE}
SELECT key, arg_min(name, src * 1000000 + pos) AS name, CAST(min(gen) AS BIGINT) AS gen, CAST(arg_min(birth, src * 1000000 + pos) AS BIGINT) AS birth,
  CAST(arg_min(death, CASE WHEN death IS NOT NULL THEN src * 1000000 + pos END) AS BIGINT) AS death, coalesce(arg_min(region, CASE WHEN region <> '' THEN src * 1000000 + pos END), '') AS region,
  arg_min(house, src * 1000000 + pos) AS house, count(*) AS mult FROM o GROUP BY key""")
def _pedigree_collapse(spark, sf):
    return outline.collapse(relation(spark, sf, OUTLINE)).select("key", "name", "gen", "birth", "death", "region", "house", "mult")


@query("dense_ids", f"""WITH {WITH_OUTLINE}, k AS (SELECT key, min(src * 1000000 + pos) AS f FROM o GROUP BY key)
SELECT key, CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS id FROM k""")
def _dense_ids(spark, sf):
    return outline.dense_ids(outline.collapse(relation(spark, sf, OUTLINE))).select("key", "id")


@query("outline_edges", f"""WITH {WITH_OUTLINE},
u AS (SELECT src, pos, gen, key, gen AS lvl, 1 AS d FROM o UNION ALL SELECT src, pos, gen, key, gen - 1, 0 FROM o),
w AS (SELECT *, last_value(CASE WHEN d = 1 THEN key END IGNORE NULLS) OVER (PARTITION BY src, lvl ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM u)
SELECT DISTINCT key AS s, c AS t FROM w WHERE d = 0 AND gen > 1 AND c IS NOT NULL AND c <> key""")
def _outline_edges(spark, sf):
    return outline.edges_of(relation(spark, sf, OUTLINE))


LINES = """SELECT doc_id AS src, i - 1 AS pos, CASE WHEN (i - 1) % 3 = 0 THEN CAST(1 + (i - 1) % 7 AS VARCHAR) || '. ' || l ELSE l END AS line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""


@query("stitch_lines", f"""WITH l AS ({LINES}),
k AS (SELECT src, pos, line, regexp_matches(line, '^\\s*(\\d+)\\.\\s+(.*\\S)\\s*$') AS opens FROM l WHERE trim(line) <> '' AND NOT regexp_matches(line, '^(Ancestors of|Exported from)\\b')),
g AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY src ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM k)
SELECT src, min(pos) AS pos, CAST(max(CASE WHEN opens THEN CAST(regexp_extract(line, '^\\s*(\\d+)\\.', 1) AS INT) END) AS BIGINT) AS gen,
  md5(string_agg(CASE WHEN opens THEN regexp_extract(line, '^\\s*(\\d+)\\.\\s+(.*\\S)\\s*$', 2) ELSE trim(line) END, ' ' ORDER BY pos)) AS text_md5
FROM g WHERE grp > 0 GROUP BY src, grp""")
def _stitch_lines(spark, sf):
    rows = L.split_lines(_texts(spark, sf).select(F.col("doc_id").alias("src"), F.replace("text", F.lit("\r"), F.lit("")).alias("value")))
    rows = rows.withColumn("line", F.when(F.col("pos") % 3 == 0, F.concat((1 + F.col("pos") % 7).cast("string"), F.lit(". "), F.col("line"))).otherwise(F.col("line")))
    return outline.stitch(rows).select("src", "pos", "gen", F.md5("raw_text").alias("text_md5"))


# ---- text -------------------------------------------------------------------

_NORM = "trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("norm_text", f"SELECT doc_id, md5({_NORM.format(c='text')}) AS norm_md5, length({_NORM.format(c='text')}) AS n FROM documents")
def _norm_text(spark, sf):
    n = T.norm(F.col("text"))
    return _texts(spark, sf).select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("n"))


@query("norm_variants", """SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]+', '', 'g')), '\\s+', ' ', 'g'))) AS gedcom_md5,
md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS review_md5, md5(trim(lower(strip_accents(text)))) AS voyage_md5 FROM documents""")
def _norm_variants(spark, sf):
    c = F.col("text")
    return _texts(spark, sf).select("doc_id", F.md5(T.norm_gedcom(c)).alias("gedcom_md5"), F.md5(T.norm_review(c)).alias("review_md5"), F.md5(T.norm_voyage(c)).alias("voyage_md5"))


@query("slugify", "SELECT page_id, regexp_replace(regexp_replace(lower(strip_accents(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def _slugify(spark, sf):
    return _t(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("parse_year", """SELECT page_id, CAST((list_filter(list_transform(regexp_extract_all(url, '\\b(\\d{3,4})\\b', 1), LAMBDA x: CAST(x AS INT)), LAMBDA y: y BETWEEN 300 AND 2025))[1] AS BIGINT) AS year FROM pages""")
def _parse_year(spark, sf):
    return _t(spark, sf, "pages").select("page_id", T.parse_year(F.col("url")).alias("year"))


VITALS = """SELECT CAST(o_orderkey AS BIGINT) AS id, 'Person ' || CAST(o_orderkey AS STRING) ||
CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ', b. circa ' || CAST(1500 + o_orderkey % 300 AS STRING) || ' Soria, Spain' END ||
CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' d. ' || CAST(1560 + o_orderkey % 300 AS STRING) || ' Lima, Peru' END AS raw FROM {orders}"""


@query("split_vitals", f"""WITH v AS ({oracle(VITALS)}) SELECT id, regexp_extract(raw, '^Person \\d+') AS name,
CASE WHEN id % 3 = 0 THEN '' ELSE 'circa ' || CAST(1500 + id % 300 AS VARCHAR) || ' Soria, Spain' END AS born, CASE WHEN id % 4 = 0 THEN '' ELSE CAST(1560 + id % 300 AS VARCHAR) || ' Lima, Peru' END AS died,
CASE WHEN id % 3 <> 0 THEN 1500 + id % 300 END AS birth, CASE WHEN id % 4 <> 0 THEN 1560 + id % 300 END AS death,
CASE WHEN id % 3 <> 0 THEN 'Spain' WHEN id % 4 <> 0 THEN 'Peru' ELSE '' END AS country FROM v""")
def _split_vitals(spark, sf):
    name, born, died = T.split_vitals(F.col("raw"))
    v = relation(spark, sf, VITALS).select("id", name.alias("name"), born.alias("born"), died.alias("died"))
    country = F.coalesce(F.when(rules.country_of(F.col("born")) != "", rules.country_of(F.col("born"))), rules.country_of(F.col("died")))
    return v.select("id", "name", "born", "died", T.parse_year(F.col("born")).alias("birth"), T.parse_year(F.col("died")).alias("death"), country.alias("country"))


TITLED = """SELECT CAST(c_custkey AS BIGINT) AS id, c_name || CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN ', Rey de Navarra' WHEN 1 THEN ', Condesa de Lara' WHEN 2 THEN ', Obispo de Burgos' WHEN 3 THEN ', Capitán General'
WHEN 4 THEN ', Alcalde de Soria' WHEN 5 THEN ', Cacique' WHEN 6 THEN ' de Guzmán' ELSE '' END AS name FROM {customer}"""
_M = "CAST(id % 8 AS INT)"


@query("classify_category", f"""WITH v AS ({oracle(TITLED)}) SELECT id, CASE {_M} WHEN 0 THEN 'royal' WHEN 1 THEN 'noble' WHEN 2 THEN 'clergy' WHEN 3 THEN 'military' WHEN 4 THEN 'official' WHEN 5 THEN 'indigenous' ELSE 'untitled' END AS cat,
CASE {_M} WHEN 0 THEN 'Rey de Navarra' WHEN 1 THEN 'Condesa de Lara' WHEN 2 THEN 'Obispo de Burgos' WHEN 3 THEN 'Capitán General' WHEN 4 THEN 'Alcalde de Soria' WHEN 5 THEN 'Indigenous' ELSE '' END AS titles,
CASE {_M} WHEN 0 THEN 'Navarra' WHEN 1 THEN 'Lara' WHEN 2 THEN 'Burgos' WHEN 4 THEN 'Soria' ELSE '' END AS region, CASE {_M} WHEN 1 THEN 'Lara' WHEN 6 THEN 'Guzmán' ELSE '' END AS house FROM v""")
def _classify_category(spark, sf):
    name = F.col("name")
    v = relation(spark, sf, TITLED).withColumn("cat", rules.classify(name))
    return v.select("id", "cat", rules.title_phrase(name, F.col("cat")).alias("titles"), rules.region_of(name).alias("region"), rules.house_of(name).alias("house"))


@query("classify_documents", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(strip_accents(text)), '(?:{'|'.join(p)})') THEN '{k}'" for k, _, _, p in rules.CATEGORIES) + " ELSE 'untitled' END AS cat FROM documents")
def _classify_documents(spark, sf):
    return _texts(spark, sf).select("doc_id", rules.classify(F.col("text")).alias("cat"))


@query("classify_wide", f"""WITH v AS ({oracle(TITLED)}) SELECT id, CASE {_M} WHEN 0 THEN 'royal' WHEN 1 THEN 'noble' WHEN 2 THEN 'clergy' WHEN 3 THEN 'military' WHEN 4 THEN 'official' WHEN 5 THEN 'indigenous' ELSE 'untitled' END AS cat FROM v""")
def _classify_wide(spark, sf):
    return relation(spark, sf, TITLED).select("id", rules.classify_wide(F.col("name")).alias("cat"))


@query("country_hint", "SELECT c_custkey AS id, CASE CAST(c_nationkey % 4 AS INT) WHEN 0 THEN 'Spain' WHEN 1 THEN 'Mexico' WHEN 2 THEN 'Italy' ELSE '' END AS country FROM customer")
def _country_hint(spark, sf):
    m = (F.col("c_nationkey") % 4).cast("int")
    place = F.concat(F.lit("Casa, "), F.when(m == 0, "León, España").when(m == 1, "Zacatecas, MÉXICO").when(m == 2, "Siena, Italia").otherwise("Nowhere"))
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), rules.country_of(place).alias("country"))


@query("name_casing", f"""WITH v AS ({oracle(TITLED)}) SELECT id, regexp_replace(name, '[, ].*', '') || CASE {_M} WHEN 0 THEN ', King of Navarre' WHEN 1 THEN ', Countess of Lara' WHEN 2 THEN ', Bishop of Burgos' WHEN 3 THEN ', Captain General'
WHEN 4 THEN ', Mayor of Soria' WHEN 5 THEN ', Cacique' WHEN 6 THEN ' de Guzmán' ELSE '' END AS name FROM v""")
def _name_casing(spark, sf):
    return relation(spark, sf, TITLED).select("id", naming.fix_name(F.col("name")).alias("name"))


@query("escape_html", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages")
def _escape_html(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped_md5"))


@query("relation_labels", "SELECT p_partkey AS id, CASE p_size % 9 WHEN 0 THEN 'you' WHEN 1 THEN 'parent' WHEN 2 THEN 'grandparent' WHEN 3 THEN 'great-grandparent' ELSE CAST(p_size % 9 - 2 AS VARCHAR) || 'th great-grandparent' END AS label FROM part")
def _relation_labels(spark, sf):
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.relation_label(F.col("p_size") % 9).alias("label"))


@query("extract_payload", """SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_nationkey * 10 + i AS BIGINT) AS id, n_name || CAST(i AS VARCHAR) AS name, CAST(i AS BIGINT) AS gen FROM nation CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)""")
def _extract_payload(spark, sf):
    nation = _t(spark, sf, "nation")
    node = lambda i: F.struct((F.col("n_nationkey").cast("long") * 10 + i).alias("id"), F.concat("n_name", F.lit(str(i))).alias("name"), F.lit(i).alias("gen"))
    page = F.concat(F.lit("<script>const GRAPH = "), F.to_json(F.struct(F.array(*(node(i) for i in range(3))).alias("nodes"), F.array(F.struct(F.lit(1).alias("s"), F.lit(0).alias("t"))).alias("edges"))), F.lit(";\nconst META = {};</script>"))
    found = nation.select(F.col("n_nationkey").alias("src"), G.graph_of(G.payload(page)).alias("graph"))
    return G.nodes_of(found).select("src", "id", "name", "gen")


@query("page_titles", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def _page_titles(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


@query("search_scores", """SELECT p_partkey AS id, CAST(2 + 2 + 4 + 6 + 6 + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS score FROM part""")
def _search_scores(spark, sf):
    ending = F.when(F.col("p_partkey") % 2 == 0, ".svg").otherwise(".png")
    title = F.concat(F.lit("escudo armas"), F.lit(" lara"), F.col("p_partkey").cast("string"), ending)
    house = F.concat(F.lit("Lara"), F.col("p_partkey").cast("string"))
    slug = F.concat(F.lit("lara"), F.col("p_partkey").cast("string"))
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), search.score(title, house, slug).cast("long").alias("score"))


def _pictures(query: str) -> list[tuple[str, str]]:
    """A search client that knows two of three houses, one of them by its picture's second name alone."""
    word = query.split()[-1]
    number = int(word[1:])
    return [] if number % 3 == 0 else [(f"File:Escudo {word}.svg", f"u{number}")] if number % 3 == 1 else [(f"{word}.jpg", f"v{number}"), (f"Escudo {word}.pdf", "none")]


@query("lookup_best", """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS slug, CASE s_suppkey % 3 WHEN 1 THEN 'Escudo s' || CAST(s_suppkey AS VARCHAR) || '.svg' WHEN 2 THEN 's' || CAST(s_suppkey AS VARCHAR) || '.jpg' END AS title,
CASE s_suppkey % 3 WHEN 1 THEN 'u' || CAST(s_suppkey AS VARCHAR) WHEN 2 THEN 'v' || CAST(s_suppkey AS VARCHAR) END AS url,
CAST(CASE s_suppkey % 3 WHEN 0 THEN -1 ELSE 12 + CASE WHEN s_suppkey > 9 THEN 4 ELSE 0 END + CASE s_suppkey % 3 WHEN 1 THEN 5 ELSE 0 END END AS BIGINT) AS score FROM supplier WHERE s_suppkey % 5 <> 0""")
def _lookup_best(spark, sf):
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    houses = _t(spark, sf, "supplier").select(F.upper(name).alias("house"), name.alias("slug"), "s_suppkey")
    cache = houses.where("s_suppkey % 5 = 0").select("slug")
    return search.lookup(houses.drop("s_suppkey"), cache, [_pictures, _pictures]).select("slug", "title", "url", "score")


# ---- files --------------------------------------------------------------------


def _gedcom(spark, sf):
    """A GEDCOM record of five lines per part, and a family per order, in bounded files."""
    text = lambda c: F.col(c).cast("string")
    lines = lambda *parts: F.posexplode(F.array(*(F.concat(*p) for p in parts))).alias("k", "line")
    lit = F.lit
    born = (1500 + F.col("p_partkey") % 300).cast("string")
    people = _t(spark, sf, "part").select(F.concat(lit("p"), F.floor(F.col("p_partkey") / 1000).cast("string")).alias("src"), F.col("p_partkey").alias("n"), lines(
        [lit("0 @I"), text("p_partkey"), lit("@ INDI")], [lit("1 NAME "), F.col("p_name"), lit(" /"), F.col("p_brand"), lit("/")], [lit("1 BIRT")],
        [lit("2 DATE 3 MAY "), born], [lit("2 PLAC "), F.col("p_type")], [lit("1 FAMC @F"), text("p_partkey"), lit("@")]))
    families = _t(spark, sf, "orders").select(F.concat(lit("f"), F.floor(F.col("o_orderkey") / 1000).cast("string")).alias("src"), F.col("o_orderkey").alias("n"), lines(
        [lit("0 @F"), text("o_orderkey"), lit("@ FAM")], [lit("1 HUSB @I"), text("o_custkey"), lit("@")], [lit("1 CHIL @I"), (F.col("o_custkey") + 1).cast("string"), lit("@")], [lit("1 CHIL @I"), text("o_orderkey"), lit("@")]))
    return people.unionByName(families).select("src", (F.col("n") * 10 + F.col("k")).alias("pos"), "line")


@query("gedcom_people", """SELECT '@I' || CAST(p_partkey AS VARCHAR) || '@' AS ged_id, trim(regexp_replace(p_name || ' ' || p_brand, '\\s+', ' ', 'g')) AS name, CAST(1500 + p_partkey % 300 AS BIGINT) AS birth, p_type AS place,
'@F' || CAST(p_partkey AS VARCHAR) || '@' AS family FROM part""")
def _gedcom_people(spark, sf):
    found = gedcom.individuals(_gedcom(spark, sf))
    return found.select("ged_id", F.array_join("names", ";").alias("name"), T.first_year(F.col("birth_date")).alias("birth"), F.col("birth_place").alias("place"), F.array_join("famc", ";").alias("family"))


@query("gedcom_families", """SELECT '@F' || CAST(o_orderkey AS VARCHAR) || '@' AS fam_id, '@I' || CAST(o_custkey AS VARCHAR) || '@' AS husb, CAST(NULL AS VARCHAR) AS wife,
'@I' || CAST(o_custkey + 1 AS VARCHAR) || '@;@I' || CAST(o_orderkey AS VARCHAR) || '@' AS chil FROM orders""")
def _gedcom_families(spark, sf):
    return gedcom.families(_gedcom(spark, sf)).select("fam_id", "husb", "wife", F.array_join("chil", ";").alias("chil"))


@query("catalogue_entries", """SELECT c_custkey % 90000 + 1 AS num, 'Juan Mozo ' || chr(CAST(65 + c_custkey % 26 AS INTEGER)) || 'ez' AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Soria' ELSE 'Toro' END AS origin,
CASE c_custkey % 3 WHEN 0 THEN 'Chile' WHEN 1 THEN 'Perú' ELSE 'Nueva España (México)' END AS destination, CAST(1510 + c_nationkey AS BIGINT) AS year, CAST(1 + c_custkey % 28 AS BIGINT) AS day, CAST(CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 10 END AS BIGINT) AS month, 'II' AS vol FROM customer""")
def _catalogue_entries(spark, sf):
    """Volumes of bounded size, a header with the year and an entry per customer."""
    k = F.col("c_custkey")
    entry = F.concat(
        (k % 90000 + 1).cast("string"), F.lit(". — Juan Mozo "), F.char((65 + k % 26).cast("int")), F.lit("ez, natural de "), F.when(k % 2 == 0, "Soria").otherwise("Toro"),
        F.when(k % 3 == 0, ", a Chile. — ").when(k % 3 == 1, ", al Perú. — ").otherwise(", a la Nueva España. — "), (1 + k % 28).cast("string"), F.when(k % 4 == 0, " marzo").otherwise(" octubre"),
    )
    own = _t(spark, sf, "customer").select("c_nationkey", F.floor(k / 1000).alias("part"), F.struct("c_custkey", entry.alias("line")).alias("e"))
    whole = own.groupBy("c_nationkey", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.line), "\n").alias("entries"))
    volumes = whole.select(F.concat_ws("_", F.lit("Volumen_II"), "c_nationkey", "part").alias("src"), F.concat(F.lit("AÑO "), (1510 + F.col("c_nationkey")).cast("string"), F.lit("\n"), F.col("entries")).alias("value"))
    return catalogue.entries(volumes).select("num", "name", "origin", "destination", "year", "day", "month", "vol")


@query("graph_nodes", f"""WITH {WITH_PEOPLE} SELECT id, name, CAST(coalesce(gen, 0) AS BIGINT) AS gen, CAST(birth AS BIGINT) AS birth, CASE WHEN id % 2 = 0 THEN cat ELSE 'untitled' END AS cat, CASE WHEN id % 2 = 0 THEN house ELSE '' END AS house, CASE WHEN id % 2 = 0 THEN mult ELSE 1 END AS mult FROM n""")
def _graph_nodes(spark, sf):
    """People written as graph JSON inside pages, of newer and older files, and read again."""
    people = relation(spark, sf, PEOPLE)
    newer = people.where("id % 2 = 0").groupBy(F.floor(F.col("id") / 1000).alias("f")).agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name", "gen", "birth", "cat", "house", "mult")).alias("nodes"), F.array().alias("edges"))).alias("json"))
    older = people.where("id % 2 = 1").groupBy(F.floor(F.col("id") / 1000).alias("f")).agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name", "gen", "birth")).alias("nodes"), F.array().alias("edges"))).alias("json"))
    pages = newer.unionByName(older).select(F.lit("f").alias("src"), F.concat(F.lit("<script>const GRAPH = "), F.col("json"), F.lit(";</script>")).alias("html"))
    found = G.nodes_of(pages.select("src", G.graph_of(G.payload(F.col("html"))).alias("graph")))
    return found.select("id", "name", "gen", "birth", "cat", "house", "mult")


# ---- graph ------------------------------------------------------------------

WITH_PEDIGREE = f"d AS ({oracle(PEDIGREE)})"
_BFS = f"""WITH RECURSIVE {WITH_PEDIGREE}, b(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT d.s, b.depth + 1 FROM b JOIN d ON d.t = b.id),
m AS (SELECT id, min(depth) AS depth FROM b GROUP BY id)"""


@query("bfs_depth", f"{_BFS} SELECT id, CAST(depth AS BIGINT) AS depth FROM m")
def _bfs_depth(spark, sf):
    return graph.bfs(relation(spark, sf, PEDIGREE), _roots(spark, 0)).select("id", "depth")


@query("shortest_path", f"""{_BFS}, r(id, path, depth) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], 0 UNION ALL SELECT m.id, list_append(r.path, m.id), m.depth FROM r JOIN d ON d.t = r.id JOIN m ON m.id = d.s AND m.depth = r.depth + 1)
SELECT id, array_to_string(min(path), ',') AS path FROM r GROUP BY id""")
def _shortest_path(spark, sf):
    found = graph.bfs(relation(spark, sf, PEDIGREE), _roots(spark, 0), keep_path=True)
    return found.select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("ancestor_closure", f"""WITH RECURSIVE {WITH_PEDIGREE}, a(id, k) AS (SELECT CAST(100 AS BIGINT), 0 UNION SELECT d.s, a.k + 1 FROM a JOIN d ON d.t = a.id),
c(id, k) AS (SELECT CAST(100 AS BIGINT), 0 UNION SELECT d.t, c.k + 1 FROM c JOIN d ON d.s = c.id)
SELECT id, CAST(min(k) AS BIGINT) AS distance FROM a GROUP BY id UNION ALL SELECT id, CAST(-min(k) AS BIGINT) FROM c GROUP BY id HAVING min(k) > 0""")
def _ancestor_closure(spark, sf):
    return graph.closure(relation(spark, sf, PEDIGREE), _roots(spark, 100))


_WAYS = f"""WITH RECURSIVE {WITH_PEDIGREE}, p(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT d.s, p.depth + 1 FROM p JOIN d ON d.t = p.id),
w AS (SELECT id, depth, count(*) AS ways FROM p WHERE depth > 0 GROUP BY id, depth)"""


@query("path_counts", f"{_WAYS} SELECT id, CAST(depth AS BIGINT) AS depth, ways FROM w")
def _path_counts(spark, sf):
    return graph.path_counts(relation(spark, sf, PEDIGREE), 0, None)


@query("implex_by_gen", f"""{_WAYS} SELECT CAST(depth AS BIGINT) AS gen, CAST(sum(ways) AS BIGINT) AS filled, count(*) AS distinct_ancestors, round(1 - count(*) / CAST(sum(ways) AS DOUBLE), 9) AS collapse, pow(2.0, depth) AS theoretical FROM w GROUP BY depth""")
def _implex_by_gen(spark, sf):
    return graph.implex(graph.path_counts(relation(spark, sf, PEDIGREE), 0, None)).withColumn("collapse", F.round("collapse", 9))


@query("implex_summary", f"{_WAYS} SELECT CAST(sum(ways) AS BIGINT) AS total_filled, count(DISTINCT id) AS total_distinct, CAST(max(depth) AS BIGINT) AS generations FROM w")
def _implex_summary(spark, sf):
    return graph.implex_summary(graph.path_counts(relation(spark, sf, PEDIGREE), 0, None))


WITH_LAYERS = f"g AS ({oracle(LAYERS)})"


@query("topo_rank", f"""WITH RECURSIVE {WITH_LAYERS}, r(id, d) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT t FROM g) UNION SELECT g.t, r.d + 1 FROM r JOIN g ON g.s = r.id)
SELECT id, CAST(max(d) AS BIGINT) AS rank, false AS cyclic FROM r GROUP BY id""")
def _topo_rank(spark, sf):
    return graph.topo_rank(relation(spark, sf, PEOPLE), relation(spark, sf, LAYERS))


@query("wright_f", f"""WITH RECURSIVE {WITH_LAYERS}, par AS (SELECT t, min(s) AS p1, max(s) AS p2, count(*) AS n FROM g GROUP BY t),
k(root, a, b, w) AS (SELECT t, p1, p2, CAST(1.0 AS DOUBLE) FROM par WHERE n = 2 UNION ALL
SELECT k.root, g.s, CASE WHEN k.a = k.b THEN par.p2 ELSE (CASE WHEN par.t = k.a THEN k.b ELSE k.a END) END, CASE WHEN k.a = k.b THEN k.w / 2 ELSE k.w / par.n END
FROM k JOIN par ON par.t = (CASE WHEN k.a % 5 < k.b % 5 OR (k.a % 5 = k.b % 5 AND k.a < k.b AND k.a IN (SELECT t FROM par)) OR (k.a % 5 = k.b % 5 AND k.b NOT IN (SELECT t FROM par)) THEN k.a ELSE k.b END) JOIN g ON g.t = par.t WHERE k.a <> k.b OR (par.n = 2 AND g.s = par.p1)),
f AS (SELECT root, sum(CASE WHEN a = b THEN w / 2 ELSE 0 END) AS f FROM k GROUP BY root) SELECT p_partkey AS id, round(f, 9) AS f, CASE WHEN f IS NULL THEN 'undefined' ELSE 'ok' END AS status FROM part LEFT JOIN f ON root = p_partkey""")
def _wright_f(spark, sf):
    nodes = relation(spark, sf, PEOPLE)
    return graph.inbreeding(nodes, relation(spark, sf, LAYERS), nodes).withColumn("f", F.round("f", 9))


@query("find_root", f"WITH {WITH_EDGES}, {WITH_PEOPLE} SELECT id FROM n WHERE id NOT IN (SELECT s FROM e)")
def _find_root(spark, sf):
    return graph.sinks(relation(spark, sf, PEOPLE), relation(spark, sf, EDGES)).select("id")


@query("drop_dangling", f"WITH {WITH_EDGES}, {WITH_PEOPLE} SELECT s, t FROM e WHERE s IN (SELECT id FROM n WHERE NOT placeholder) AND t IN (SELECT id FROM n WHERE NOT placeholder)")
def _drop_dangling(spark, sf):
    loops = relation(spark, sf, "SELECT p_partkey AS s, p_partkey AS t FROM {part}")
    return graph.drop_self_and_dangling(relation(spark, sf, PEOPLE).where("NOT placeholder"), relation(spark, sf, EDGES).unionByName(loops))


@query("edge_repair", f"WITH {WITH_EDGES}, {WITH_PEOPLE} SELECT e.s, e.t FROM e JOIN n a ON a.id = e.s JOIN n b ON b.id = e.t WHERE a.gen > b.gen")
def _edge_repair(spark, sf):
    return graph.repair_directions(relation(spark, sf, PEOPLE), relation(spark, sf, EDGES))


BAD_EDGES = EDGES + " UNION SELECT p_partkey AS s, p_partkey - p_partkey % 10 AS t FROM {part} WHERE p_partkey % 10 IN (1, 2, 3)"


@query("over_two_parents", f"WITH b AS ({oracle(BAD_EDGES)}) SELECT t AS id, count(DISTINCT s) AS parents FROM b GROUP BY t HAVING count(DISTINCT s) > 2")
def _over_two_parents(spark, sf):
    return graph.over_parented(relation(spark, sf, BAD_EDGES))


@query("verify_report", f"""WITH {WITH_EDGES}, {WITH_PEOPLE}, x AS (SELECT a.gen AS sg, b.gen AS tg, a.birth AS sb, b.birth AS tb, e.s, e.t FROM e JOIN n a ON a.id = e.s JOIN n b ON b.id = e.t)
SELECT (SELECT count(*) FROM n WHERE gen = 1) AS roots, count(*) FILTER (sg < tg) AS inverted, count(*) FILTER (sg < tg AND sb <= tb) AS year_ok, count(*) FILTER (sg < tg AND sb > tb) AS year_fail,
count(*) FILTER (sg < tg AND (sb IS NULL OR tb IS NULL)) AS year_skip, count(*) FILTER (s = t) AS self_loops, count(*) FILTER (tg = 1 AND sg <> 2) AS root_bad_edges, count(*) AS edges, (SELECT count(*) FROM e) AS distinct_edges FROM x""")
def _verify_report(spark, sf):
    return outline.verify(relation(spark, sf, PEOPLE), relation(spark, sf, EDGES))


@query("remove_placeholders", f"""WITH {WITH_EDGES}, {WITH_PEOPLE}, k AS (SELECT e.s, e.t FROM e JOIN n a ON a.id = e.s AND NOT a.placeholder JOIN n b ON b.id = e.t AND NOT b.placeholder)
SELECT id FROM n WHERE NOT placeholder AND (id IN (SELECT s FROM k) OR id IN (SELECT t FROM k))""")
def _remove_placeholders(spark, sf):
    return graph.remove_placeholders(relation(spark, sf, PEOPLE), relation(spark, sf, EDGES))[0].select("id")


@query("cap_placeholder_parents", f"""WITH b AS ({oracle(BAD_EDGES)}), {WITH_PEOPLE}, x AS (SELECT b.s, b.t, n.id % 2 = 0 AS ph, row_number() OVER (PARTITION BY b.t, n.id % 2 = 0 ORDER BY b.s) AS k FROM b JOIN n ON n.id = b.s)
SELECT s, t FROM x WHERE NOT ph OR k <= 1""")
def _cap_placeholder_parents(spark, sf):
    return graph.cap_placeholder_parents(relation(spark, sf, PEOPLE).withColumn("placeholder", F.col("id") % 2 == 0), relation(spark, sf, BAD_EDGES), 1)


@query("contract_duplicates", f"""WITH {WITH_EDGES}, r AS (SELECT id AS dup, id - 1 AS canon FROM ({oracle(PEOPLE)}) WHERE id % 10 = 1)
SELECT DISTINCT coalesce(a.canon, e.s) AS s, coalesce(b.canon, e.t) AS t FROM e LEFT JOIN r a ON a.dup = e.s LEFT JOIN r b ON b.dup = e.t WHERE coalesce(a.canon, e.s) <> coalesce(b.canon, e.t)""")
def _contract_duplicates(spark, sf):
    nodes = relation(spark, sf, PEOPLE)
    return graph.contract(nodes, relation(spark, sf, EDGES), nodes.where("id % 10 = 1").select(F.col("id").alias("dup"), (F.col("id") - 1).alias("canon")))[1]


@query("contracted_nodes", f"""WITH {WITH_PEOPLE}, p AS (SELECT CASE WHEN id % 10 = 1 THEN id - 1 ELSE id END AS to_id, * FROM n)
SELECT to_id AS id, arg_min(name, id) AS name, CAST(arg_min(birth, CASE WHEN birth IS NOT NULL THEN id END) AS BIGINT) AS birth, arg_min(house, CASE WHEN house <> '' THEN id END) AS house, CAST(sum(mult) AS BIGINT) AS mult FROM p GROUP BY to_id""")
def _contracted_nodes(spark, sf):
    nodes = relation(spark, sf, PEOPLE).select("id", "name", "birth", "house", "mult")
    return graph.contract(nodes, relation(spark, sf, EDGES), nodes.where("id % 10 = 1").select(F.col("id").alias("dup"), (F.col("id") - 1).alias("canon")))[0]


@query("keep_connected", f"{_BFS}, {WITH_PEOPLE}, x AS (SELECT * FROM ({oracle(LAYERS)})) SELECT id FROM n WHERE id IN (SELECT id FROM m) OR id IN (SELECT s FROM x) OR id IN (SELECT t FROM x)")
def _keep_connected(spark, sf):
    reached = graph.bfs(relation(spark, sf, PEDIGREE), _roots(spark, 0))
    return graph.keep_connected(relation(spark, sf, PEOPLE), relation(spark, sf, LAYERS), reached).select("id")


# ---- merge ------------------------------------------------------------------


@query("merge_union", f"""WITH {WITH_SOURCES} SELECT key, arg_min(name, file_ord) AS name, CAST(arg_min(gen, file_ord) AS BIGINT) AS gen, CAST(arg_min(birth, file_ord) AS BIGINT) AS birth,
CAST(max(death) AS BIGINT) AS death, CAST(sum(mult) AS BIGINT) AS mult FROM (SELECT key, file_ord, min(name) AS name, min(gen) AS gen, min(birth) AS birth, max(death) AS death, sum(mult) AS mult FROM f GROUP BY key, file_ord) GROUP BY key""")
def _merge_union(spark, sf):
    per_file = relation(spark, sf, SOURCES).groupBy("key", "file_ord").agg(F.min("name").alias("name"), F.min("gen").alias("gen"), F.min("birth").alias("birth"), F.max("death").alias("death"), F.sum("mult").alias("mult"))
    top = per_file.groupBy("key").agg(F.max("death").alias("last_death"))
    return merge.merge_nodes(per_file.join(top, "key").withColumn("death", F.col("last_death"))).select("key", "name", "gen", "birth", "death", "mult")


@query("yearless_fold", f"""WITH {WITH_SOURCES}, g AS (SELECT key, min(name) AS name, min(gen) AS gen, min(birth) AS birth, sum(mult) AS mult FROM f GROUP BY key), p AS (SELECT *, regexp_extract(key, '^(.*)\\|', 1) AS prefix, key LIKE '%|?' AS yl FROM g),
c AS (SELECT prefix, key AS canon FROM p WHERE NOT yl QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY mult DESC, key) = 1), t AS (SELECT CASE WHEN p.yl THEN coalesce(c.canon, p.key) ELSE p.key END AS to_key, p.* FROM p LEFT JOIN c USING (prefix))
SELECT to_key AS key, min(name) AS name, CAST(min(gen) AS BIGINT) AS gen, CAST(max(birth) AS BIGINT) AS birth, CAST(sum(mult) AS BIGINT) AS mult FROM t GROUP BY to_key""")
def _yearless_fold(spark, sf):
    g = relation(spark, sf, SOURCES).groupBy("key").agg(F.min("name").alias("name"), F.min("gen").alias("gen"), F.min("birth").alias("birth"), F.lit(None).cast("int").alias("death"), F.sum("mult").alias("mult"))
    return merge.fold_yearless(g)[0].drop("death")


@query("anchored_merge", f"""WITH {WITH_SOURCES} SELECT key, CAST(coalesce(min(gen) FILTER (source = 'src0'), min(gen)) AS BIGINT) AS gen, CAST(sum(mult) AS BIGINT) AS mult, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM f GROUP BY key""")
def _anchored_merge(spark, sf):
    return merge.anchored_merge(relation(spark, sf, SOURCES), "src0").select("key", "gen", "mult", F.array_join("sources", ",").alias("sources"))


@query("backfill", f"""WITH v AS ({oracle(TITLED)}) SELECT id, CASE WHEN id % 3 = 0 THEN 'noble' ELSE CASE {_M} WHEN 0 THEN 'royal' WHEN 1 THEN 'noble' WHEN 2 THEN 'clergy' WHEN 3 THEN 'military' WHEN 4 THEN 'official' WHEN 5 THEN 'indigenous' ELSE 'untitled' END END AS cat,
CASE {_M} WHEN 1 THEN 'Lara' WHEN 6 THEN 'Guzmán' ELSE '' END AS house FROM v""")
def _backfill(spark, sf):
    nodes = relation(spark, sf, TITLED).select("id", "name", F.when(F.col("id") % 3 == 0, "nobility").otherwise("untitled").alias("cat"), F.lit("").alias("house"), F.lit(None).cast("string").alias("region"))
    return merge.backfill(nodes).select("id", "cat", "house")


@query("anchor_offsets", f"""WITH {WITH_SOURCES}, b AS (SELECT key, min(gen) AS gen FROM f WHERE file_ord = 0 GROUP BY key), s AS (SELECT f.file_ord, b.gen - f.gen AS o, b.gen, f.key, f.gen AS own FROM f JOIN b USING (key) WHERE f.file_ord > 0)
SELECT CAST(file_ord AS BIGINT) AS file_ord, CAST(o AS BIGINT) AS "offset" FROM s QUALIFY row_number() OVER (PARTITION BY file_ord ORDER BY gen, key, own) = 1""")
def _anchor_offsets(spark, sf):
    f = relation(spark, sf, SOURCES)
    return merge.anchor_offsets(f.where("file_ord = 0"), f.where("file_ord > 0"))


@query("gen_align", f"WITH {WITH_OUTLINE} SELECT src, pos, CAST(gen - (SELECT min(gen) FROM o) AS BIGINT) AS gen FROM o")
def _gen_align(spark, sf):
    return merge.align(relation(spark, sf, OUTLINE)).select("src", "pos", "gen")


@query("union_on_subject", f"""WITH {WITH_EDGES}, m AS (SELECT max(p_partkey) + 10000 AS sh FROM part) SELECT s, t FROM e UNION SELECT CASE WHEN s = 0 THEN 0 ELSE s + sh END, CASE WHEN t = 0 THEN 0 ELSE t + sh END FROM e, m""")
def _union_on_subject(spark, sf):
    g = relation(spark, sf, PEOPLE), relation(spark, sf, EDGES)
    return merge.union_on_subject(g, g)[1]


@query("incremental_keys", f"WITH {WITH_OUTLINE} SELECT DISTINCT key, key NOT IN (SELECT key FROM o WHERE src < 50) AS is_new FROM o WHERE src >= 50")
def _incremental_keys(spark, sf):
    o = relation(spark, sf, OUTLINE)
    return merge.increment(o.where("src < 50").select("key").distinct(), o.where("src >= 50"))


@query("incremental_merge", """SELECT lower(l_returnflag) || ' person ' || CAST(l_partkey % 97 AS VARCHAR) || '|' || CAST(1500 + l_partkey % 97 AS VARCHAR) AS key, CAST(min(1 + l_partkey % 6) AS BIGINT) AS gen, count(*) AS mult, 'untitled' AS cat
FROM lineitem GROUP BY l_returnflag, l_partkey % 97""")
def _incremental_merge(spark, sf):
    """Outline lines made of all line items, in two batches."""
    name = F.concat_ws(" ", F.col("l_returnflag"), F.lit("Person"), (F.col("l_partkey") % 97).cast("string"))
    line = F.concat((1 + F.col("l_partkey") % 6).cast("string"), F.lit(". "), name, F.lit(" b. "), (1500 + F.col("l_partkey") % 97).cast("string"))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"))
    rows = _t(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), place.cast("long").alias("pos"), line.alias("line"))
    first = merge_batch(None, rows.where("src < 's5'"))
    return merge_batch(first, rows.where("src >= 's5'"))[0].select("key", "gen", "mult", "cat")


# ---- matching ---------------------------------------------------------------

MATCH_NODES = "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, CAST(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 1500 + s_suppkey END AS INT) AS birth, CAST(NULL AS INT) AS death, '' AS country, '' AS region FROM {supplier}"


@query("match_first", "SELECT 'p' || CAST(c_custkey AS VARCHAR) AS ged_id, min(s_suppkey) AS id FROM customer JOIN supplier ON s_suppkey = c_custkey % 200 GROUP BY c_custkey")
def _match_first(spark, sf):
    name = lambda k: F.concat(F.lit("SUPPLIER#"), F.lpad(k.cast("string"), 9, "0"))
    people = _t(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("ged_id"), F.array(F.lit("Nobody"), name(F.col("c_custkey") % 200)).alias("variants"))
    return matching.match_by_name(people, relation(spark, sf, MATCH_NODES))


@query("match_positional")
def _match_positional(spark, sf):
    nodes, edges = relation(spark, sf, PEOPLE), relation(spark, sf, LAYERS)
    g = lambda c: F.concat(F.lit("g"), F.col(c).cast("string"))
    first = lambda c: (F.col(c) % 7).cast("string")
    people = nodes.select(g("id").alias("ged_id"), first("id").alias("first"), F.col("id").alias("ord"))
    start = graph.sinks(nodes, edges).select(g("id").alias("ged_id"), "id")
    return matching.match_by_position(people, edges.select(g("s").alias("s"), g("t").alias("t")), nodes.select("id", first("id").alias("first")), edges, start)


@query("change_set", """WITH p AS (SELECT s_suppkey AS id, 1500 + s_suppkey + (s_suppkey % 2) AS nb, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 1500 + s_suppkey END AS ob FROM supplier)
SELECT id, 'birth' AS field, CAST(ob AS VARCHAR) AS old, CAST(nb AS VARCHAR) AS new FROM p WHERE ob IS DISTINCT FROM nb
UNION ALL SELECT id, 'country', '', 'Spain' FROM p WHERE id % 2 = 0 UNION ALL SELECT id, 'region', '', 'Soria' FROM p WHERE id % 5 = 0""")
def _change_set(spark, sf):
    nodes = relation(spark, sf, MATCH_NODES)
    people = nodes.select(F.col("id").cast("string").alias("ged_id"), "name", (1500 + F.col("id") + F.col("id") % 2).cast("int").alias("birth"), F.lit(None).cast("int").alias("death"),
                          F.when(F.col("id") % 2 == 0, "Spain").otherwise("").alias("country"), F.when(F.col("id") % 5 == 0, "Soria").otherwise("unknown").alias("region"))
    return matching.change_set(nodes.select("id", F.col("id").cast("string").alias("ged_id")), people, nodes)


@query("family_pairs", "SELECT DISTINCT CAST(p AS VARCHAR) AS s, CAST(c AS VARCHAR) AS t FROM (SELECT unnest([o_custkey, o_orderkey % 7]) AS p, o_orderkey AS c FROM orders)")
def _family_pairs(spark, sf):
    f = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("husb"), (F.col("o_orderkey") % 7).cast("string").alias("wife"), F.array(F.col("o_orderkey").cast("string")).alias("chil"))
    return matching.family_edges(f)


@query("surname_match", """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(trim(lower(strip_accents(text))), '[a-z0-9_]+')) AS word FROM documents)
SELECT doc_id, word AS surname, display, priority FROM w JOIN (SELECT unnest(['the', 'der', 'para']) AS s, unnest(['English', 'German', 'Spanish']) AS display, CAST(unnest([1, 1, 2]) AS BIGINT) AS priority) ON s = word""")
def _surname_match(spark, sf):
    table = spark.createDataFrame([("the", "English", 1), ("der", "German", 1), ("para", "Spanish", 2)], "surname string, display string, priority int")
    return matching.surname_matches(_texts(spark, sf), table, F.col("text")).select("doc_id", "surname", "display", "priority")


@query("asof_header", """SELECT event_id, CAST(last_value(CASE WHEN event_type = 'login' OR event_id % 10 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS header FROM events""")
def _asof_header(spark, sf):
    e = _t(spark, sf, "events").withColumn("place", F.struct("ts", "event_id"))
    return asof_header(e, F.when((F.col("event_type") == "login") | (F.col("event_id") % 10 == 0), F.col("event_id")), "user_id", "place").select("event_id", "header")


# ---- reports ----------------------------------------------------------------


@query("relatives", f"""WITH {WITH_EDGES}, {WITH_PEOPLE} SELECT n.id, coalesce(array_to_string(list_sort(p.l), ','), '') AS parents, coalesce(array_to_string(list_sort(c.l), ','), '') AS children FROM n
LEFT JOIN (SELECT t, list(DISTINCT s) AS l FROM e GROUP BY t) p ON p.t = n.id LEFT JOIN (SELECT s, list(DISTINCT t) AS l FROM e GROUP BY s) c ON c.s = n.id""")
def _relatives(spark, sf):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return reports.relatives(relation(spark, sf, PEOPLE), relation(spark, sf, EDGES)).select("id", joined("parents"), joined("children"))


@query("conflict_records", f"""WITH b AS (SELECT DISTINCT s, t FROM ({oracle(BAD_EDGES)})), g AS (SELECT t AS id, list_sort(list(s)) AS l FROM b GROUP BY t HAVING count(*) > 2), x AS (SELECT id, l, list_filter(l, LAMBDA v: v < 1000) AS lo, list_filter(l, LAMBDA v: v >= 1000) AS hi FROM g)
SELECT id, CAST(len(l) AS BIGINT) AS n_parents, array_to_string(CASE WHEN len(lo) > 0 AND len(hi) > 0 THEN lo ELSE l[1:len(l) // 2] END, ',') AS group_a, array_to_string(CASE WHEN len(lo) > 0 AND len(hi) > 0 THEN hi ELSE l[len(l) // 2 + 1:] END, ',') AS group_b FROM x""")
def _conflict_records(spark, sf):
    ids = lambda c: F.array_join(F.transform(c, lambda p: p.id.cast("string")), ",").alias(c)
    return reports.conflicts(relation(spark, sf, PEOPLE), relation(spark, sf, BAD_EDGES), 1000).select("id", "n_parents", ids("group_a"), ids("group_b"))


@query("dup_clusters", f"""WITH RECURSIVE {WITH_PEOPLE}, g AS (SELECT lower(name) AS norm, gen, id, coalesce(birth, 0) AS b, row_number() OVER (PARTITION BY lower(name), gen ORDER BY id) AS k FROM n),
w(norm, gen, k, seeds, clusters) AS (SELECT norm, gen, k, [b], [[id]] FROM g WHERE k = 1 UNION ALL
SELECT g.norm, g.gen, g.k, CASE WHEN i IS NULL THEN list_append(seeds, g.b) ELSE seeds END, CASE WHEN i IS NULL THEN list_append(clusters, [g.id]) ELSE list_concat(list_concat(clusters[1:i - 1], [list_append(clusters[i], g.id)]), clusters[i + 1:]) END
FROM (SELECT w.*, list_position(list_transform(seeds, LAMBDA v: (v = 0 AND h.b = 0) OR (v <> 0 AND h.b <> 0 AND abs(v - h.b) <= 5)), true) AS i0, CASE WHEN list_position(list_transform(seeds, LAMBDA v: (v = 0 AND h.b = 0) OR (v <> 0 AND h.b <> 0 AND abs(v - h.b) <= 5)), true) > 0 THEN list_position(list_transform(seeds, LAMBDA v: (v = 0 AND h.b = 0) OR (v <> 0 AND h.b <> 0 AND abs(v - h.b) <= 5)), true) END AS i
FROM w JOIN g h ON h.norm = w.norm AND h.gen = w.gen AND h.k = w.k + 1) x JOIN g ON g.norm = x.norm AND g.gen = x.gen AND g.k = x.k + 1),
l AS (SELECT norm, gen, clusters FROM w QUALIFY row_number() OVER (PARTITION BY norm, gen ORDER BY k DESC) = 1)
SELECT norm, CAST(gen AS BIGINT) AS gen, array_to_string(c, ',') AS ids FROM (SELECT norm, gen, unnest(clusters) AS c FROM l) WHERE len(c) > 1""")
def _dup_clusters(spark, sf):
    found = reports.duplicate_clusters(relation(spark, sf, PEOPLE), relation(spark, sf, EDGES))
    return found.select("norm", "gen", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


_STATS = f"""{WITH_PEOPLE}, st AS (SELECT house, count(*) AS members, min(birth) AS first_birth, max(birth) AS last_birth, count(*) FILTER (cat = 'royal') AS n_royal, count(*) FILTER (cat = 'noble') AS n_noble FROM n WHERE house <> '' GROUP BY house HAVING count(*) >= 3)"""


@query("house_stats", f"WITH {_STATS} SELECT house, members, CAST(first_birth AS BIGINT) AS first_birth, CAST(last_birth AS BIGINT) AS last_birth, n_royal, n_noble, regexp_replace(lower(house), '[^a-z0-9]+', '-', 'g') AS slug FROM st")
def _house_stats(spark, sf):
    return reports.house_stats(relation(spark, sf, PEOPLE)).select("house", "members", "first_birth", "last_birth", "n_royal", "n_noble", "slug")


@query("house_rank", f"WITH {_STATS} SELECT house, CAST(row_number() OVER (ORDER BY n_royal DESC, n_noble DESC, members DESC, house) AS BIGINT) AS rank FROM st")
def _house_rank(spark, sf):
    return reports.house_rank(reports.house_stats(relation(spark, sf, PEOPLE))).select("house", "rank")


@query("house_history", f"""WITH {_STATS} SELECT house, 'The house of ' || house || ' was ' || CASE WHEN n_royal > 1 THEN 'a royal house' WHEN n_noble > 1 THEN 'a noble house' ELSE 'a family' END || ' of the ' ||
CASE WHEN first_birth < 1000 THEN 'early' WHEN first_birth < 1200 THEN 'high' ELSE 'late' END || ' Middle Ages, with ' || CAST(members AS VARCHAR) || ' recorded members.' AS history FROM st""")
def _house_history(spark, sf):
    return reports.history_sentence(reports.house_stats(relation(spark, sf, PEOPLE))).select("house", "history")


@query("house_members", f"WITH {WITH_PEOPLE} SELECT id, house, CAST(row_number() OVER (PARTITION BY house ORDER BY birth ASC NULLS LAST, id) AS BIGINT) AS place FROM n WHERE house <> ''")
def _house_members(spark, sf):
    return reports.house_members(relation(spark, sf, PEOPLE)).select("id", "house", "place")


@query("house_nearest", f"""{_BFS}, {WITH_PEOPLE} SELECT house, coalesce(arg_min(n.id, CASE WHEN depth IS NOT NULL THEN depth * CAST(1000000 AS BIGINT) + n.id END), arg_min(n.id, coalesce(birth, 9999) * CAST(1000000 AS BIGINT) + n.id)) AS id, CAST(min(depth) AS BIGINT) AS depth FROM n LEFT JOIN m ON m.id = n.id WHERE house <> '' GROUP BY house""")
def _house_nearest(spark, sf):
    return reports.house_nearest(relation(spark, sf, PEOPLE), graph.bfs(relation(spark, sf, PEDIGREE), _roots(spark, 0)))


_ERAS = "CASE " + " ".join(f"WHEN birth BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in rules.ERAS) + " ELSE 'Unknown Era' END"


@query("era_counts", f"WITH {WITH_PEOPLE} SELECT {_ERAS} AS era, count(*) AS n FROM n GROUP BY 1")
def _era_counts(spark, sf):
    return reports.era_counts(relation(spark, sf, PEOPLE))


_PLACED = f"""{WITH_PEOPLE}, g AS (SELECT *, CASE region WHEN 'Toledo' THEN 39.86 WHEN 'Normandy' THEN 49.0 ELSE CASE country WHEN 'Spain' THEN 40.0 WHEN 'Mexico' THEN 23.0 END END AS lat0,
CASE region WHEN 'Toledo' THEN -4.02 WHEN 'Normandy' THEN 0.5 ELSE CASE country WHEN 'Spain' THEN -3.5 WHEN 'Mexico' THEN -102.0 END END AS lng0 FROM n),
pl AS (SELECT *, round_even(CAST(lat0 AS DOUBLE) + sin(id * CAST(1.6180339887 AS DOUBLE)) * 0.45, 4) AS lat, round_even(CAST(lng0 AS DOUBLE) + cos(id * CAST(2.7182818284 AS DOUBLE)) * 0.7, 4) AS lng FROM g)"""


def _placed(spark, sf):
    return reports.place_coordinates(relation(spark, sf, PEOPLE), rules.places(spark, rules.REGION_PLACES), rules.places(spark, rules.COUNTRY_PLACES))


@query("geo_fallback", f"WITH {_PLACED} SELECT id, CAST(round(lat * 10000) AS BIGINT) AS lat, CAST(round(lng * 10000) AS BIGINT) AS lng FROM pl")
def _geo_fallback(spark, sf):
    return _placed(spark, sf).select("id", F.round(F.col("lat") * 10000).cast("long").alias("lat"), F.round(F.col("lng") * 10000).cast("long").alias("lng"))


@query("migration_flows", f"""WITH RECURSIVE {_PLACED}, {WITH_EDGES}, p AS (SELECT id, lat, lng, birth FROM pl WHERE birth IS NOT NULL AND lat IS NOT NULL),
r AS (SELECT CAST(round_even(a.lat, 0) AS BIGINT) AS from_lat, CAST(round_even(a.lng, 0) AS BIGINT) AS from_lng, CAST(round_even(b.lat, 0) AS BIGINT) AS to_lat, CAST(round_even(b.lng, 0) AS BIGINT) AS to_lng, b.birth AS y FROM e JOIN p a ON a.id = e.s JOIN p b ON b.id = e.t
WHERE sqrt((a.lat - b.lat) ** 2 + (a.lng - b.lng) ** 2) >= 1.5 AND NOT (least(a.lng, b.lng) < -40 AND b.birth < 1492)),
k(from_lat, from_lng, to_lat, to_lng, y) AS (SELECT from_lat, from_lng, to_lat, to_lng, min(y) FROM r GROUP BY ALL UNION ALL
SELECT k.from_lat, k.from_lng, k.to_lat, k.to_lng, (SELECT min(r.y) FROM r WHERE r.from_lat = k.from_lat AND r.from_lng = k.from_lng AND r.to_lat = k.to_lat AND r.to_lng = k.to_lng AND r.y >= k.y + 25) FROM k WHERE k.y IS NOT NULL)
SELECT from_lat, from_lng, to_lat, to_lng, CAST(y AS BIGINT) AS y FROM k WHERE y IS NOT NULL""")
def _migration_flows(spark, sf):
    return reports.migration_flows(_placed(spark, sf), relation(spark, sf, EDGES))


@query("alive_at", f"""WITH {WITH_PEOPLE}, y AS (SELECT unnest([1000, 1100, 1500, 1516]) AS year) SELECT CAST(year AS BIGINT) AS year, count(*) AS n FROM n JOIN y ON birth <= year AND (CASE WHEN coalesce(death, 0) <> 0 THEN death >= year - 5 ELSE birth >= year - 80 END) GROUP BY year""")
def _alive_at(spark, sf):
    years = spark.createDataFrame([(y,) for y in (1000, 1100, 1500, 1516)], "year int")
    return reports.alive_at(relation(spark, sf, PEOPLE), years).groupBy("year").agg(F.count("*").alias("n"))


@query("flows_at", f"""WITH {WITH_PEOPLE}, {WITH_EDGES}, fl AS (SELECT e.s, e.t, b.birth AS y FROM e JOIN n b ON b.id = e.t WHERE b.birth IS NOT NULL), ys AS (SELECT unnest([1000, 1500]) AS year)
SELECT s, t, CAST(year AS BIGINT) AS year, round(greatest(0.12, 1 - (year - y) / 25.0), 6) AS alpha FROM fl JOIN ys ON y <= year AND y >= year - 25""")
def _flows_at(spark, sf):
    flows = relation(spark, sf, EDGES).join(relation(spark, sf, PEOPLE).select(F.col("id").alias("t"), F.col("birth").alias("y")), "t").where("y IS NOT NULL")
    shown = reports.flows_at(flows, spark.createDataFrame([(1000,), (1500,)], "year int"))
    return shown.select("s", "t", "year", F.round("alpha", 6).alias("alpha"))


@query("merged_relations", f"""WITH {WITH_EDGES}, m AS (SELECT p_partkey AS id, p_partkey - p_partkey % 3 AS k, count(*) OVER (PARTITION BY p_partkey - p_partkey % 3) AS many, string_agg(CAST(p_partkey AS VARCHAR), ',') OVER (PARTITION BY p_partkey - p_partkey % 3 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS key FROM part),
u AS (SELECT key, many, 'parent' AS role, e.s AS id, m.id AS member FROM e JOIN m ON m.id = e.t UNION SELECT key, many, 'child', e.t, m.id FROM e JOIN m ON m.id = e.s)
SELECT key, role, id, count(DISTINCT member) AS n, count(DISTINCT member) = many AS shared FROM u GROUP BY key, many, role, id""")
def _merged_relations(spark, sf):
    clusters = relation(spark, sf, PEOPLE).groupBy((F.col("id") - F.col("id") % 3).alias("k")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return reports.merged_relations(clusters, relation(spark, sf, EDGES))


@query("find_text", "SELECT page_id FROM pages WHERE contains(lower(url || ' ' || html), 'thering')")
def _find_text(spark, sf):
    return reports.find_text(_t(spark, sf, "pages"), "THERing", ["url", "html"]).select("page_id")


@query("display_labels", f"""WITH {WITH_PEOPLE} SELECT id, CASE cat WHEN 'royal' THEN 'Royalty' WHEN 'noble' THEN 'Nobility' WHEN 'clergy' THEN 'Clergy' ELSE 'Untitled' END AS label, CASE cat WHEN 'royal' THEN '#e8b820' WHEN 'noble' THEN '#c83040' WHEN 'clergy' THEN '#9040c0' ELSE '#7a6e5a' END AS color,
CAST(CASE cat WHEN 'royal' THEN 7.0 WHEN 'noble' THEN 5.5 ELSE 4.0 END + CASE WHEN mult * 50 > 100 THEN 2 WHEN mult * 50 > 10 THEN 1 ELSE 0 END AS DOUBLE) AS radius,
CAST(CASE WHEN gen < 8 THEN 0.95 WHEN gen < 20 THEN 0.8 WHEN gen < 40 THEN 0.65 ELSE 0.5 END AS DOUBLE) AS opacity, CASE WHEN birth > 1821 THEN 'Mexico' WHEN birth > 1492 THEN 'Iberia + New Spain' WHEN birth > 1200 THEN 'Iberia + France' ELSE 'Iberia' END AS region FROM n""")
def _display_labels(spark, sf):
    n, c = relation(spark, sf, PEOPLE), F.col
    return n.select("id", display.category_label(c("cat")).alias("label"), display.category_color(c("cat")).alias("color"), display.marker_radius(c("cat"), c("mult") * 50).alias("radius"), display.age_opacity(c("gen")).alias("opacity"), display.stage_region(c("birth")).alias("region"))


@query("top_collapsed", f"WITH {WITH_OUTLINE} SELECT key, count(*) AS mult FROM o GROUP BY key ORDER BY mult DESC, key LIMIT 10")
def _top_collapsed(spark, sf):
    return reports.top_by(outline.collapse(relation(spark, sf, OUTLINE)), "mult", 10, "key").where("mult > 1").select("key", "mult")


@query("dest_top8", "SELECT n_name AS destination, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY n DESC, destination LIMIT 8")
def _dest_top8(spark, sf):
    rows = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return reports.top_by(rows.groupBy(F.col("n_name").alias("destination")).agg(F.count("*").alias("n")), "n", 8, "destination")


@query("gen_histogram", f"WITH {WITH_OUTLINE} SELECT CAST(gen AS BIGINT) AS gen, count(*) AS n FROM o GROUP BY gen")
def _gen_histogram(spark, sf):
    return reports.generation_histogram(relation(spark, sf, OUTLINE))


@query("legend_counts", f"WITH {WITH_PEOPLE} SELECT cat, count(*) AS n FROM n GROUP BY cat")
def _legend_counts(spark, sf):
    return outline.legend(relation(spark, sf, PEOPLE)).select("cat", "n")


@query("graph_summary", f"WITH {WITH_PEOPLE} SELECT count(*) AS people, CAST(max(gen) AS BIGINT) AS generations, CAST(min(birth) AS BIGINT) AS first_birth, CAST(max(birth) AS BIGINT) AS last_birth FROM n")
def _graph_summary(spark, sf):
    return outline.summary(relation(spark, sf, PEOPLE))


@query("conflict_decisions", f"""WITH b AS (SELECT DISTINCT s, t FROM ({oracle(BAD_EDGES)})), g AS (SELECT t AS id, list_sort(list(s)) AS l FROM b GROUP BY t HAVING count(*) > 2), x AS (SELECT id, l, list_filter(l, LAMBDA v: v < 1000) AS lo, list_filter(l, LAMBDA v: v >= 1000) AS hi FROM g),
d AS (SELECT id, unnest(CASE WHEN len(lo) > 0 AND len(hi) > 0 THEN hi ELSE l[len(l) // 2 + 1:] END) AS s FROM x WHERE id % 20 = 0) SELECT b.s, b.t FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = b.t AND d.s = b.s)""")
def _conflict_decisions(spark, sf):
    edges = relation(spark, sf, f"SELECT DISTINCT s, t FROM ({BAD_EDGES}) AS z")
    found = reports.conflicts(relation(spark, sf, PEOPLE), edges, 1000)
    return reports.apply_conflict_decisions(edges, found, found.where("id % 20 = 0").select("id", F.lit("keep-a").alias("decision")))


@query("source_tags", f"WITH {WITH_PEOPLE} SELECT id, CASE WHEN id < 1000 THEN 'first' ELSE 'second' END AS source FROM n")
def _source_tags(spark, sf):
    return reports.tag_source(relation(spark, sf, PEOPLE), 1000).select("id", "source")


from kinframe.plans import readers, structure  # noqa: E402,F401  register their queries
