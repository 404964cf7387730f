"""Outlines: stitching, cleaning, as-of links, collapse, and the whole build."""

import random

from pyspark.sql import functions as F

from kinframe.functions import naming, rules
from kinframe.functions import text as T
from kinframe.operators import graph, outline
from kinframe.operators.asof import asof_parent
from kinframe.sources.lines import split_lines

TEXT = """Ancestors of Ana Prueba (4 generations)
1. Ana Prueba b. 1900 Quito, Colombia
2. Luis Prueba, alcalde b. circa 1870
d. between 1930 and 1932 Lima, Peru
3. Marta Solar b. 1840
4. N N
3. Bruno Prueba b. 1842
4. Conde Tomás de Lara b. 1810 d. 1860 León, España
2. Rosa Solar b. 1874
3. Marta Solar b. 1840
Exported from nowhere
"""


def lines(spark, text=TEXT):
    return split_lines(spark.createDataFrame([("f", text)], "src string, value string"))


def test_stitch_and_clean(spark):
    got = outline.stitch(lines(spark)).orderBy("pos").collect()
    assert [r.gen for r in got] == [1, 2, 3, 4, 3, 4, 2, 3]
    assert got[1].raw_text.endswith("d. between 1930 and 1932 Lima, Peru")
    by = {r.name: r for r in outline.titled(outline.clean(outline.stitch(lines(spark)))).collect()}
    luis, tomas = by["Luis Prueba, alcalde"], by["Conde Tomás de Lara"]
    assert (luis.birth, luis.death, luis.cat, luis.country) == (1870, 1930, "official", "Peru")
    assert (tomas.cat, tomas.country, tomas.house, tomas.region) == ("noble", "Spain", "Lara", "")


def test_build(spark):
    nodes, edges = outline.build(lines(spark))
    names = {r.id: r.name for r in nodes.collect()}
    assert sorted(names) == list(range(7))
    pairs = {(names[r.s].split()[0], names[r.t].split()[0]) for r in edges.collect()}
    assert pairs == {("Luis", "Ana"), ("Marta", "Luis"), ("N", "Marta"), ("Bruno", "Luis"), ("Conde", "Bruno"), ("Rosa", "Ana"), ("Marta", "Rosa")}
    marta = nodes.where("name = 'Marta Solar'").first()
    assert (marta.mult, marta.gen) == (2, 3)
    marked = nodes.withColumn("placeholder", rules.is_placeholder(T.norm(F.col("name"))))
    kept, left = graph.remove_placeholders(marked, edges)
    assert kept.count() == 6 and left.count() == 6
    root = graph.find_root(nodes, edges)
    assert names[root] == "Ana Prueba"
    rows = {r.gen: (int(r.filled), r.distinct_ancestors) for r in graph.implex(graph.path_counts(left, root, 5)).collect()}
    assert rows == {1: (2, 2), 2: (3, 2), 3: (1, 1)}
    report = outline.verify(nodes, edges).first()
    assert (report.roots, report.self_loops, report.edges, report.distinct_edges) == (1, 0, 7, 7)


def test_empty_outline(spark):
    nodes, edges = outline.build(lines(spark, ""))
    assert nodes.count() == 0 and edges.count() == 0


def test_asof_matches_a_sequential_model(spark):
    rng = random.Random(3)
    rows = [(s, p, rng.randint(1, 5), f"k{rng.randint(0, 30)}") for s in ("a", "b") for p in range(150)]
    want = set()
    for s in ("a", "b"):
        last = {}
        for _, p, g, k in (r for r in rows if r[0] == s):
            if g > 1 and last.get(g - 1) not in (None, k):
                want.add((s, p, last[g - 1]))
            last[g] = k
    got = asof_parent(spark.createDataFrame(rows, "src string, pos long, gen int, key string")).where("child_key IS NOT NULL")
    assert {(r.src, r.pos, r.child_key) for r in got.collect()} == want


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_text_functions(spark):
    assert column(spark, ["Éßøł ñ", "Ａ", "é", ""], T.strip_accents) == ["Eßøł n", "Ａ", "e", ""]
    assert column(spark, ["  José-María  d'Ávila ", "N. N."], T.norm) == ["jose maria d avila", "n n"]
    assert column(spark, ["José d'Ávila", "ß x"], T.norm_gedcom) == ["jose d'avila", "x"]
    assert column(spark, ["¡Casa de Lara!"], T.slug) == ["casa-de-lara"]
    assert column(spark, ["between 1589 and 1620", "b. 42", "c. 2999 then 301", ""], T.parse_year) == [1589, None, 301, None]
    assert column(spark, ["3 MAY 1900", "12345", ""], T.first_year) == [1900, None, None]
    assert column(spark, ["Siracusa", "Lima, Perú", "León, España, Roma", "nowhere"], rules.country_of) == ["United States", "Peru", "Spain", ""]
    assert column(spark, ["king of pamplona y aragon", "rey de pamplona"], rules.language_key) == ["king pamplona aragon", "king pamplona"]
    assert column(spark, ["Charlemagne", "Duc de Bar", "X"], rules.classify_wide) == ["royal", "royal", "untitled"]
    assert column(spark, ["Conde de Lara y Haro", "Señor de la Maia, conde"], rules.region_of) == ["Lara", "Maia"]
    assert column(spark, ["Ana de Toledo", "Ana del Valle", "ana"], rules.house_of) == ["", "Valle", ""]


def test_naming(spark):
    assert column(spark, ["ANA DE LA TORRE", "luis xiv", "Juan (RICO) del Val, conde de Castilla", "", "NN", "D. PEDRO 1º"], naming.fix_name) == [
        "Ana de la Torre", "luis XIV", "Juan (Rico) del Val, Count of Castile", "", "NN", "D. Pedro 1º",
    ]
    assert column(spark, ["rey de Castilla y de León", "Conquistador", "maese de campo", "2º señor de Lara"], naming.translate_title) == ["King of Castile and León", "Conquistador", "Field Marshal", "2nd Lord of Lara"]


def test_best_name(spark):
    df = spark.createDataFrame([(["Ana Ana Sol", "Ana (vieja)", "Ana Sol"],), ([],)], "v array<string>")
    assert [r[0] for r in df.select(T.best_name(F.col("v"), F.col("v"))).collect()] == ["Ana Sol", ""]


def test_long_sources_are_shared_by_stretches(spark):
    """Links and headers are the same however a source is cut, over stretches without any too."""
    import random

    from pyspark.sql import functions as F

    from kinframe.operators.asof import asof_header

    rng = random.Random(5)
    rows = [(f"s{s}", p, rng.choice([1, 2, 3, 3, 4]), f"k{p}") for s in range(3) for p in sorted(rng.sample(range(2000), 150))] + [(None, 5, 1, "k5"), (None, 900, 2, "k900")]
    df = spark.createDataFrame(rows, "src string, pos long, gen int, key string")
    head = F.when(F.col("gen") == 4, F.col("key"))
    for stretch in (1, 7, 300, 10**6):
        assert sorted(asof_parent(df, stretch=stretch).collect(), key=repr) == sorted(asof_parent(df).collect(), key=repr)
        assert sorted(asof_header(df, head, stretch=stretch).collect(), key=repr) == sorted(asof_header(df, head).collect(), key=repr)


def test_records_span_stretches(spark):
    """Outlines, GEDCOM files and catalogues give the same however their sources are cut."""
    import random

    from kinframe.sources import catalogue, gedcom

    rng = random.Random(3)
    rows = [(s, i, rng.choice(["1. Ana", "2. Luis b. 1870", "goes on", "", "  and on", "Ancestors of x", "14. Rosa"])) for s in ("a", "b", None) for i in range(120)]
    lines = spark.createDataFrame(rows, "src string, pos long, line string")
    want = sorted(outline.stitch(lines, stretch=None).collect(), key=repr)
    assert len(want) > 50
    for stretch in (1, 7, 50):
        assert sorted(outline.stitch(lines, stretch=stretch).collect(), key=repr) == want
    tags = ["0 @I{}@ INDI", "1 NAME N{}", "1 BIRT", "2 DATE 19{}", "0 TRLR", "1 DEAT", "0 @F{}@ FAM"]
    ged = spark.createDataFrame([(s, i, rng.choice(tags).format(rng.randrange(10, 40))) for s in ("a", "b") for i in range(150)], "src string, pos long, line string")
    told = lambda stretch: sorted((repr(r) for r in gedcom._records(ged, stretch).collect()))
    assert told(None) == told(1) == told(9) and len(told(None)) > 50
    volume = "AÑO 1534\n" + "\n".join(f"{i}. — Juan Ficticio, natural de Soria, a la Nueva España. — 4 octubre" + ("\nAÑO 15%02d" % (i % 90 + 1) if i % 5 == 0 else "") for i in range(1, 60))
    volumes = spark.createDataFrame([("v1", volume), ("v2", volume[:900])], "src string, value string")
    told = lambda stretch: sorted(repr(r) for r in catalogue.entries(volumes, stretch=stretch).collect())
    assert told(None) == told(1) == told(8) and len({r.year for r in catalogue.entries(volumes).collect()}) > 5


def test_record_places_are_found_without_sorting(spark):
    """The record that a stretch ends in is found by its place, in a hash table: no split of lines is sorted for it."""
    from kinframe.sources import gedcom

    rows = ["0 HEAD", "1 NAME Nobody", "0 @I1@ INDI", "1 NAME Ana /Prueba/", "2 GIVN Ana", "0 @F1@ FAM", "1 HUSB @I1@", "0 NOTE", "1 NAME Nobody", "0 @I1@ INDI", "2 SURN Sol", "1 NAME Ana Sol"]
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate(rows)] + [(None, 4, "1 NAME Luis"), (None, 1, "0 @I1@ INDI")], "src string, pos long, line string")
    for stretch in (1, 3, 1 << 20):
        found = gedcom._records(lines, stretch)
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.src, r.pos, r.rec.id, r.rec.kind, r.top) for r in found.collect()} == {
            ("a", 2, "@I1@", "INDI", None), ("a", 3, "@I1@", "INDI", "NAME"), ("a", 4, "@I1@", "INDI", "NAME"), ("a", 5, "@F1@", "FAM", None), ("a", 6, "@F1@", "FAM", "HUSB"),
            ("a", 9, "@I1@", "INDI", "NAME"), ("a", 10, "@I1@", "INDI", "NAME"), ("a", 11, "@I1@", "INDI", "NAME"), (None, 1, "@I1@", "INDI", None), (None, 4, "@I1@", "INDI", "NAME")}


def test_one_long_source_uses_many_tasks(spark):
    """A source of 400,000 lines is cut into stretches: no task holds them all."""
    lines = spark.range(400_000).selectExpr("'one' AS src", "id AS pos", "if(id % 10 = 0, concat(1 + id % 7, '. Person ', id), 'more') AS line")
    whole = outline.stitch(lines, stretch=20_000)
    assert whole.count() == 40_000
    assert whole.agg(F.min(F.length("raw_text")), F.countDistinct("pos")).first()[1] == 40_000
