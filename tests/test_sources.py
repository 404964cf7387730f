"""Sources and sinks: graph payloads, GEDCOM, catalogues, lookups, incremental ingest."""

import json

import pytest
from pyspark.sql import functions as F

from kinframe.operators import outline
from kinframe.sources import catalogue, gedcom, graphs, lines, search
from kinframe.streaming import incremental

PAGE = """<script>const GRAPH = {"nodes":[{"id":0,"name":"Ana Prueba","gen":0,"birth":1900,"death":null},{"id":1,"name":"N N"}],"edges":[{"s":1,"t":0}]};
const LEGEND = [{"key":"royal","label":"Royalty","color":"#e8b820"}]; const META = {"title":"T","subtitle":"S"};</script>"""

GED = """﻿0 HEAD
1 GEDC
0 @I1@ INDI
1 NAME Ana /Prueba/
2 GIVN Ana
2 SURN Prueba
2 _MARNM Solar
1 BIRT
2 DATE 3 MAY 1899
2 DATE 3 MAY 1900
2 ADDR
3 STAE Pichincha
3 CTRY Ecuador
2 PLAC late
1 FAMC @F1@
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I3@
1 CHIL @I1@
0 TRLR
1 NAME nobody
"""


def test_graph_payload(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "b.json").write_text('{"nodes":[{"id":5,"name":"Luis"}],"edges":[]}')
    found = graphs.read_graphs(spark, str(tmp_path))
    rows = {r.id: r for r in graphs.nodes_of(found).collect()}
    assert rows[0].birth == 1900 and rows[1].cat == "untitled" and rows[5].mult == 1
    assert [(r.s, r.t) for r in graphs.edges_of(found).collect()] == [(1, 0)]
    assert {r.key for r in graphs.known_keys(found).collect()} == {"ana prueba|1900", "luis|?"}
    page = lines.read_text(spark, str(tmp_path / "a.html"))
    got = page.select(graphs.legend_of(F.col("value")).alias("l"), graphs.meta_of(F.col("value")).alias("m")).first()
    assert got.l[0].key == "royal" and got.m.title == "T"


def test_graph_sinks(spark):
    nodes = spark.createDataFrame([(0, "Ána <x>", 0)], "id long, name string, gen int")
    text = graphs.graph_json(nodes, spark.createDataFrame([(1, 0)], "s long, t long"))
    assert json.loads(text)["nodes"][0]["name"] == "Ána <x>" and "Á" in text
    new = graphs.splice(PAGE, text, title="U")
    assert '"title": "U"' in new and "Ána" in new and "Prueba" not in new
    assert graphs.render("__TITLE__ /*__DATA__*/", text, [], "a<b", "") == f"a&lt;b {text}"


def test_gedcom(spark):
    rows = lines.split_lines(spark.createDataFrame([("f", GED)], "src string, value string"))
    people = gedcom.people(gedcom.individuals(rows)).collect()
    assert len(people) == 1 and people[0].variants == ["Ana Prueba", "Ana Solar"]
    assert (people[0].birth, people[0].region, people[0].country) == (1900, "Pichincha", "Ecuador")
    from kinframe.operators.matching import family_edges

    assert {tuple(r) for r in family_edges(gedcom.families(rows)).collect()} == {("@I2@", "@I1@"), ("@I3@", "@I1@")}


def test_catalogue(spark):
    text = "AÑO 1534\n12. — Juan Ficticio, hijo de Pedro Ficticio y de Inés Gamboa, natural de Soria, a la Nueva España. — 4 marzo\n13. — Ana Nadie, vecina de Soria, al Perú. — 5 octubre\nAÑO 1535\n14. — Luis Otro, natural de Toro. — 6 dic\n"
    df = spark.createDataFrame([("x_Volumen_II_y.txt", text)], "src string, value string")
    rows = {r.num: r for r in catalogue.entries(df).collect()}
    a = rows[12]
    assert (a.name, a.origin, a.destination, a.parents, a.year, a.day, a.month, a.vol) == ("Juan Ficticio", "Soria", "Nueva España (México)", "Pedro Ficticio y de Inés Gamboa", 1534, 4, 3, "II")
    assert (rows[13].destination, rows[13].month, rows[14].year, rows[14].month) == ("Perú", 10, 1535, 12)
    short = {r.num: r.month for r in catalogue.entries(df, only_short_months=True).collect()}
    assert short == {12: 0, 13: 10, 14: 12}


def test_late_catalogue(spark):
    text = "Año 1590\n1. JUAN FICTICIO, natural de Soria, a Chile.\n2, LUIS NADIE, soltero, natural de Toro.\n"
    got = catalogue.entries(spark.createDataFrame([("v", text)], "src string, value string")).orderBy("num").collect()
    assert [(r.num, r.name, r.year) for r in got] == [(1, "Juan Ficticio", 1590), (2, "Luis Nadie", 1590)]


def test_lookup(spark, tmp_path):
    houses = spark.createDataFrame([("Lara", "lara"), ("Nadie", "nadie"), ("Old", "old")], "house string, slug string")
    cache = spark.createDataFrame([("old", None, False)], "slug string, url string, found boolean")

    def client(q):
        if "nadie" in q.lower():
            raise OSError("down")
        return [("Escudo de Lara.svg", "u1"), ("x.png", "u2")]

    found = search.lookup(houses, cache, client)
    assert {r.slug: r.url for r in found.collect()} == {"lara": "u1", "nadie": None}
    assert {r.slug: r.found for r in search.extend_cache(cache, found).collect()} == {"old": False, "lara": True, "nadie": False}
    assert search.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_lookup_stops_and_falls_back(spark, tmp_path):
    """A good result ends the search, a poor one asks the next wiki, and only pictures count."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def wiki(name, results):
        def ask(q):
            with open(asked / name, "a") as f:
                f.write(q + "\n")
            return [x for key, found in results.items() if key in q.lower() for x in found]

        return ask

    first = wiki("first", {"lara": [("File:Escudo de Lara.svg", "good"), ("Escudo armas Lara.pdf", "no picture")], "toro": [("toro.jpg", "poor")]})
    second = wiki("second", {"toro": [("Escudo Toro.png", "better")], "nadie": [("x.png", "u")]})
    houses = spark.createDataFrame([("Lara", "lara"), ("Toro", "toro"), ("Nadie", "nadie")], "house string, slug string").coalesce(1)
    cache = search.read_cache(spark, str(tmp_path / "none"))
    got = {r.slug: (r.title, r.url, r.wiki) for r in search.lookup(houses, cache, [first, second]).collect()}
    assert got == {"lara": ("Escudo de Lara.svg", "good", 0), "toro": ("toro.jpg", "poor", 0), "nadie": (None, None, -1)}
    lines_of = lambda n: (asked / n).read_text().splitlines()
    assert sum("lara" in q.lower() for q in lines_of("first")) == 1 and not any("lara" in q.lower() for q in lines_of("second"))
    assert sum("nadie" in q.lower() for q in lines_of("first")) == 4 and sum("nadie" in q.lower() for q in lines_of("second")) == 5
    rows = [("Escudo de Lara.svg", "Lara", "lara"), ("Coat_of_arms of Castro del Río.png", "Castro del Río", "castro-del-rio"), ("portugal_es.svg", "Pereira", "pereira"), ("casa-de-x", "De X", "")]
    df = spark.createDataFrame(rows, "t string, h string, s string")
    assert [r[0] for r in df.select(search.score(F.col("t"), F.col("h"), F.col("s"))).collect()] == [search.score_of(*r) for r in rows]


def test_a_bug_of_the_client_is_seen(spark):
    houses = spark.createDataFrame([("Lara", "lara")], "house string, slug string")
    with pytest.raises(Exception, match="no such attribute"):
        search.lookup(houses, search.read_cache(spark, "/nowhere/at/all"), lambda q: (_ for _ in ()).throw(AttributeError("no such attribute"))).collect()


def test_the_cache_grows_part_by_part(spark, tmp_path):
    """A run that dies keeps what its parts found; the next one asks only the rest."""
    houses = spark.createDataFrame([(f"House{i}", f"house{i}") for i in range(20)] + [("House1", "house1")], "house string, slug string")
    path, calls = str(tmp_path / "cache"), str(tmp_path / "calls")

    def ask(q):
        with open(calls, "a") as f:
            f.write(q + "\n")
        return [(f"escudo {q.split()[-1]}.svg", q)]

    part = houses.where(F.pmod(F.xxhash64("slug"), F.lit(4)) == 0)
    assert search.lookup_into(part, path, ask, chunks=4).count() == part.select("slug").distinct().count()
    before = len(open(calls).readlines())
    whole = search.lookup_into(houses, path, ask, chunks=4).collect()
    assert len(whole) == 20 and all(r.found for r in whole) and len(open(calls).readlines()) == 20 >= before


def test_the_cache_keeps_what_a_page_shows(spark, tmp_path):
    houses = spark.createDataFrame([("Lara", "lara"), ("Nadie", "nadie")], "house string, slug string")
    path = str(tmp_path / "cache")
    older = spark.createDataFrame([("old", "u0", True)], "slug string, url string, found boolean")
    older.write.parquet(path)  # of a cache that held less
    first, second = lambda q: [], lambda q: [("File:Escudo de Lara.svg", "u1")] if "lara" in q.lower() else []
    search.lookup_into(houses, path, [first, second], chunks=2, sources=[("arms", "arms.example"), ("commons", "Commons")])
    got = {r.slug: r for r in search.read_cache(spark, path).collect()}
    assert set(got) == {"old", "lara", "nadie"} and (got["old"].url, got["old"].title) == ("u0", None)
    lara = got["lara"]
    assert (lara.title, lara.source, lara.caption, lara.found) == ("Escudo de Lara.svg", "commons", "Arms of the House of Lara — Commons", True)
    assert lara.score == search.score_of("Escudo de Lara.svg", "Lara", "lara") and not got["nadie"].found and got["nadie"].source is None


def test_all_tasks_share_one_rate(spark, tmp_path):
    """Four tasks, each alone able to ask at once, keep the stated rate together."""
    import time

    houses = spark.createDataFrame([(f"House{i}", f"house{i}") for i in range(60)], "house string, slug string")
    calls, rate = tmp_path / "calls", 20.0
    calls.mkdir()

    def ask(q):
        from pyspark import TaskContext

        with open(calls / str(TaskContext.get().partitionId()), "a") as f:
            f.write(f"{time.monotonic()}\n")
        return [(f"escudo {q.split()[-1]}.svg", q)]

    found = search.lookup(houses, search.read_cache(spark, str(tmp_path / "none")), ask, rate=rate, tasks=4)
    assert found.where("url IS NOT NULL").count() == 60
    per_task = [[float(x) for x in f.read_text().split()] for f in calls.iterdir()]
    at = sorted(t for own in per_task for t in own)
    assert len(per_task) == 4 and len(at) == 60
    for window in (0.25, 0.5, 1.0):
        assert max(sum(t <= u < t + window for u in at) for t in at) <= window * rate + 4  # a late start may fall into the next slots


def test_discover(spark, tmp_path):
    for name in ("Árbol Uno.txt", "b.pdf", "c.md"):
        (tmp_path / name).write_text("x")
    rows = lines.discover(spark, str(tmp_path)).collect()
    assert {r.expected for r in rows} == {"arbol-uno-lineage.html", "b-lineage.html"} or len(rows) == 2
    done = spark.createDataFrame([(r.path,) for r in rows if r.path.endswith("b.pdf")], "path string")
    assert lines.discover(spark, str(tmp_path), done=done).count() == 1


def test_ingest(spark, tmp_path):
    folder, master = tmp_path / "in", tmp_path / "master"
    folder.mkdir()
    (folder / "a.txt").write_text("1. Ana Prueba b. 1900\n2. Luis Prueba b. 1870\n")
    incremental.ingest(spark, str(folder), str(master), str(tmp_path / "cp")).awaitTermination()
    (folder / "b.txt").write_text("1. Luis Prueba\n2. Rosa Solar b. 1840\n")
    incremental.ingest(spark, str(folder), str(master), str(tmp_path / "cp")).awaitTermination()
    nodes, edges = incremental.read_master(spark, str(master))
    assert {r.key: r.mult for r in nodes.collect()} == {"ana prueba|1900": 1, "luis prueba|1870": 2, "rosa solar|1840": 1}
    assert {tuple(r) for r in edges.collect()} == {("luis prueba|1870", "ana prueba|1900"), ("rosa solar|1840", "luis prueba|1870")}


def test_pdf_reader_uses_the_given_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"1. Ana\n2. Luis")
    rows = lines.read_outline_pdf(spark, str(tmp_path), extract=lambda b: b.decode().splitlines())
    assert outline.stitch(rows).count() == 2


def test_report_pages(spark):
    """The data sets are embedded whole, in order, and can't end their script."""
    import re

    from kinframe.operators import reports
    from kinframe.sources import pages

    def data(page):
        return json.loads(re.search(r"const DATA = (\{.*?\}); const TABLES", page, re.S).group(1).replace("<\\/", "</"))

    conflicts = spark.createDataFrame([(3, "Ana </script>", 2, 3, [1, 2], [4]), (1, "Luis", 1, 5, [7], [8, 9])], "id long, name string, gen int, n_parents int, group_a array<long>, group_b array<long>")
    decided = spark.createDataFrame([(1, "a")], "id long, decision string")
    page = pages.conflict_page(conflicts, decided)
    assert [(r["id"], r["decision"], r["name"]) for r in data(page)["conflicts"]] == [(1, "a", "Luis"), (3, None, "Ana </script>")] and page.count("</script>") == 2
    clusters = spark.createDataFrame([("ana", 2, [1, 2], False), ("luis", 1, [3, 4, 5], True)], "norm string, gen int, ids array<long>, is_orphan boolean")
    page = pages.review_page(clusters)
    assert [r["norm"] for r in data(page)["clusters"]] == ["ana", "luis"] and "<b>5</b> people" in page
    points = spark.createDataFrame([(1, "Ana", 1500, 1.5, 2.5, "noble"), (2, "Luis", None, None, None, "noble")], "id long, name string, birth int, lat double, lng double, cat string")
    flows = spark.createDataFrame([(1, 2, 3)], "from_lat int, to_lat int, n int")
    assert data(pages.map_page(points, flows)) == {"people": [{"id": 1, "name": "Ana", "birth": 1500, "lat": 1.5, "lng": 2.5, "cat": "noble"}], "flows": [{"from_lat": 1, "to_lat": 2, "n": 3}]}
    matches = spark.createDataFrame([(2, 1540, "B", "Lara", 2), (1, 1530, "A", "Lara", 1)], "num int, year int, name string, display string, priority int")
    top = spark.createDataFrame([("Chile", 1), ("Peru", 4)], "destination string, n long")
    got = data(pages.voyage_page(matches, matches, top))
    assert [r["num"] for r in got["matches"]] == [1, 2] and [r["destination"] for r in got["top"]] == ["Peru", "Chile"]

    nodes = spark.createDataFrame([(i, f"P{i}", 1500 + i, None, i, "royal", "Lara & Co") for i in range(4)], "id long, name string, birth int, death int, gen int, cat string, house string")
    stats = reports.house_stats(nodes)
    way = spark.createDataFrame([("Lara & Co", i, f"<P{i}>", 1500 + i, i) for i in range(20)], "house string, step int, name string, birth int, gen int")
    intro = pages.house_page_parts(reports.history_sentence(stats), way, spark.createDataFrame([("lara-co", 'http://x/"a')], "slug string, url string"))
    (page,) = graphs.house_pages(stats, reports.house_members(nodes), intro).collect()
    assert "&lt;P0&gt;, b. 1500, gen 0" in page.html and "… 6 more …" in page.html and "P10" not in page.html.split("<table>")[0] and "badge royal" in page.html and "&quot;a" in page.html
    assert "The house of Lara &amp; Co was a royal house" in page.html and page.html.count("<tr>") == 4
    assert "1 houses, 4 members" in graphs.index_page(reports.house_rank(stats))
