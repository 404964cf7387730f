"""Graph operators against sequential models and hand-made figures."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinframe.functions import text as T
from kinframe.operators import graph, matching, merge, reports


def edges_of(spark, child_parents):
    return spark.createDataFrame([(p, c) for c, ps in child_parents.items() for p in ps], "s long, t long")


def nodes_of(spark, n):
    return spark.createDataFrame([(i, f"n{i}", i) for i in range(n)], "id long, name string, gen int")


FULL_SIBS = {0: [1, 2], 1: [3, 4], 2: [3, 4]}
COUSINS = {0: [1, 2], 1: [3, 5], 2: [4, 6], 3: [7, 8], 4: [7, 8]}


@pytest.mark.parametrize(("dag", "f"), [(FULL_SIBS, 0.25), (COUSINS, 0.0625)])
def test_inbreeding(spark, dag, f):
    n = 1 + max(x for ps in dag.values() for x in ps)
    got = graph.inbreeding(nodes_of(spark, n), edges_of(spark, dag), spark.createDataFrame([(0,), (n - 1,)], "id long"))
    rows = {r.id: r for r in got.collect()}
    assert rows[0].f == f and rows[n - 1].status == "undefined"
    assert graph.equivalent(got.where("id = 0")).first().relation.startswith("full siblings" if f == 0.25 else "first cousins")


def phi(dag, a, b):
    if a == b:
        ps = dag.get(a, [])
        return 0.5 * (1 + (phi(dag, *ps) if len(ps) == 2 else 0))
    a, b = min(a, b), max(a, b)  # parents have larger ids
    ps = dag.get(a, [])
    return sum(phi(dag, p, b) for p in ps) / len(ps) if ps else 0.0


def test_kinship_matches_recursion(spark):
    rng = random.Random(5)
    dag = {i: sorted(rng.sample(range(i + 1, 14), min(2, 13 - i)) if rng.random() < 0.8 else []) for i in range(13)}
    edges, nodes = edges_of(spark, dag), nodes_of(spark, 14)
    pairs = spark.createDataFrame([(0, 1), (2, 3), (1, 1)], "a long, b long")
    got = {(r.a, r.b): r.phi for r in graph.kinship(edges, graph.topo_rank(nodes, edges), pairs).collect()}
    for a, b in ((0, 1), (2, 3), (1, 1)):
        assert got[a, b] == pytest.approx(phi(dag, a, b))


def test_path_counts_exact_and_bfs(spark):
    # root 0 has parents 1 and 2; 1 is a parent of 2; 3 is a parent of 1
    edges = edges_of(spark, {0: [1, 2], 2: [1], 1: [3]})
    exact = Counter({(r.id, r.depth): int(r.ways) for r in graph.path_counts(edges, 0, 5).collect()})
    assert exact == {(1, 1): 1, (2, 1): 1, (1, 2): 1, (3, 2): 1, (3, 3): 1}
    other = {(r.id, r.depth): int(r.ways) for r in graph.path_counts(edges, 0, 5, mode="bfs").collect()}
    assert other[3, 2] == 1 and (3, 3) not in other


def queue_model(parents, root, max_gen):
    """Breadth-first order, then contributions node by node in that order."""
    order, seen = [root], {root}
    for v in order:
        for p in parents.get(v, []):
            if p not in seen:
                seen.add(p)
                order.append(p)
    ways = defaultdict(Counter)
    ways[root][0] = 1
    for v in order:
        for d, w in list(ways[v].items()):
            if d < max_gen:
                for p in parents.get(v, []):
                    ways[p][d + 1] += w
    return {(v, d): w for v in ways for d, w in ways[v].items() if d}


def test_queue_order_matches_a_sequential_model(spark):
    rng = random.Random(11)
    parents = {i: sorted(rng.sample(range(i + 1, 22), min(3, 21 - i))) for i in range(21)}
    got = {(r.id, r.depth): int(r.ways) for r in graph.path_counts(edges_of(spark, parents), 0, 6, mode="bfs").collect()}
    assert got == queue_model(parents, 0, 6)


def test_bfs_paths_and_cycles(spark):
    edges = edges_of(spark, {0: [1], 1: [2], 2: [0, 3]})  # with a cycle
    found = {r.id: (r.depth, r.path) for r in graph.bfs(edges, spark.createDataFrame([(0,)], "id long"), keep_path=True).collect()}
    assert found == {0: (0, [0]), 1: (1, [0, 1]), 2: (2, [0, 1, 2]), 3: (3, [0, 1, 2, 3])}
    ranks = {r.id: (r.rank, r.cyclic) for r in graph.topo_rank(nodes_of(spark, 5), edges).collect()}
    assert ranks[3] == (0, False) and ranks[4] == (0, False) and all(ranks[i][1] for i in (0, 1, 2))


def test_find_root_errors(spark):
    with pytest.raises(ValueError, match="unique|found"):
        graph.find_root(nodes_of(spark, 3), edges_of(spark, {0: []} | {0: [1], 1: [0]}), name="nobody")


def test_repairs(spark):
    nodes = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, None)], "id long, gen int")
    edges = spark.createDataFrame([(1, 0), (0, 1), (1, 2), (3, 0), (0, 0), (9, 0)], "s long, t long")
    assert {tuple(r) for r in graph.repair_directions(nodes, edges).collect()} == {(1, 0), (3, 0)}
    assert {tuple(r) for r in graph.drop_self_and_dangling(nodes, edges).collect()} == {(1, 0), (0, 1), (1, 2), (3, 0)}


def test_merging_twice_doubles_counts_only(spark):
    rows = spark.createDataFrame([("a|1", "a", 1, 1500, None, 2), ("b|?", "b", 2, None, None, 1), ("b|1510", "b", 3, 1510, 1570, 1)], "key string, name string, gen int, birth int, death int, mult long")
    once, twice = merge.merge_files([rows]), merge.merge_files([rows, rows])
    a, b = ({r.key: r for r in x.collect()} for x in (once, twice))
    assert {k: (r.gen, r.birth, 2 * r.mult) for k, r in a.items()} == {k: (r.gen, r.birth, r.mult) for k, r in b.items()}
    folded, remap = merge.fold_yearless(rows)
    assert {r.key: r.mult for r in folded.collect()} == {"a|1": 2, "b|1510": 2}
    edges = spark.createDataFrame([("b|?", "a|1"), ("b|?", "b|1510")], "s string, t string")
    assert [tuple(r) for r in merge.remap_edges(edges, remap).collect()] == [("b|1510", "a|1")]


def test_files_are_aligned_by_a_shared_person(spark):
    schema = "key string, name string, gen int, birth int, death int, mult long"
    base = spark.createDataFrame([("r", "r", 1, None, None, 1), ("x", "x", 4, None, None, 1)], schema)
    more = spark.createDataFrame([("x", "x", 1, None, 1600, 1), ("y", "y", 2, None, None, 1)], schema)
    got = {r.key: (r.gen, r.death, r.mult) for r in merge.merge_files([base, more]).collect()}
    assert got == {"r": (0, None, 1), "x": (3, 1600, 2), "y": (4, None, 1)}


def greedy(items, band=5):
    clusters = []
    for i, b in items:
        for seed, ids in clusters:
            if (not seed and not b) or (seed and b and abs(seed - b) <= band):
                ids.append(i)
                break
        else:
            clusters.append((b, [i]))
    return [ids for _, ids in clusters if len(ids) > 1]


def test_duplicate_clusters(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["Ana Sol", "ana  sol", "Luis"]), rng.randint(1, 2), rng.choice([None, 0, 1500, 1504, 1508, 1513])) for i in range(40)]
    groups = defaultdict(list)
    for i, n, g, b in rows:
        groups[" ".join(n.lower().split()), g].append((i, b or 0))
    want = sorted(ids for items in groups.values() for ids in greedy(sorted(items)))
    got = reports.duplicate_clusters(spark.createDataFrame(rows, "id long, name string, gen int, birth int"), spark.createDataFrame([(0, 1)], "s long, t long"))
    assert sorted(r.ids for r in got.collect()) == want
    assert all(r.is_orphan == (0 not in r.ids and 1 not in r.ids) for r in got.collect())


def test_thinning(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1500, 1510, 1525, 1549, 1550],), ([],)], "y array<int>")
    assert [r[0] for r in df.select(reports.thin(F.col("y"))).collect()] == [[1500, 1525, 1550], []]


def test_positional_matches(spark):
    people = spark.createDataFrame([("c", "ana", 0), ("m", "rosa", 1), ("f", "luis", 2), ("x", "luis", 3)], "ged_id string, first string, ord int")
    person_edges = spark.createDataFrame([("m", "c"), ("f", "c"), ("x", "m")], "s string, t string")
    nodes = spark.createDataFrame([(0, "ana"), (1, "rosa"), (2, "luis"), (3, "luis")], "id long, first string")
    node_edges = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "s long, t long")
    got = matching.match_by_position(people, person_edges, nodes, node_edges, spark.createDataFrame([("c", 0)], "ged_id string, id long"))
    assert {r.ged_id: r.id for r in got.collect()} == {"c": 0, "m": 1, "f": 2, "x": 3}


def test_extend_graph(spark):
    nodes = spark.createDataFrame([(0, "ana", 0, None, None, "untitled", 1)], "id long, name string, gen int, birth int, death int, cat string, mult long")
    people = spark.createDataFrame([("c", "ana", 0, None, None), ("m", "rosa", 1, 1500, None)], "ged_id string, name string, gen int, birth int, death int")
    got, edges = matching.extend_graph(nodes, spark.createDataFrame([], "s long, t long"), people, spark.createDataFrame([("m", "c")], "s string, t string"), spark.createDataFrame([("c", 0)], "ged_id string, id long"))
    assert {r.id: r.name for r in got.collect()} == {0: "ana", 1: "rosa"} and [tuple(r) for r in edges.collect()] == [(1, 0)]


def test_decisions(spark):
    nodes = nodes_of(spark, 8)
    edges = spark.createDataFrame([(s, 0) for s in (1, 2, 5, 6)] + [(1, 3), (2, 3), (4, 3)], "s long, t long")
    found = reports.conflicts(nodes, edges, second_source_from=5)
    rows = {r.id: ([p.id for p in r.group_a], [p.id for p in r.group_b]) for r in found.collect()}
    assert rows == {0: ([1, 2], [5, 6]), 3: ([1], [2, 4])}
    left = reports.apply_conflict_decisions(edges, found, spark.createDataFrame([(0, "keep-b"), (3, "flag")], "id long, decision string"))
    assert {tuple(r) for r in left.collect()} == {(5, 0), (6, 0), (1, 3), (2, 3), (4, 3)}
    clusters = spark.createDataFrame([([1, 2, 3],), ([4, 5],)], "ids array<bigint>")
    remap = reports.merge_decisions(clusters, spark.createDataFrame([("1,2,3", "merge-last"), ("4,5", "distinct")], "key string, decision string"))
    assert {tuple(r) for r in remap.collect()} == {(1, 3), (2, 3)}


def test_change_policies(spark):
    nodes = spark.createDataFrame([(0, "Ana", 1500, None, "", "")], "id long, name string, birth int, death int, country string, region string")
    people = spark.createDataFrame([("g", "Ana Sol", 1501, 1560, "Peru", "unknown")], "ged_id string, name string, birth int, death int, country string, region string")
    match = spark.createDataFrame([("g", 0)], "ged_id string, id long")
    over = {(r.field, r.old, r.new) for r in matching.change_set(match, people, nodes).collect()}
    assert over == {("name", "Ana", "Ana Sol"), ("birth", "1500", "1501"), ("death", None, "1560"), ("country", "", "Peru")}
    fill = matching.change_set(match, people, nodes, "fill", root=0)
    assert {r.field for r in fill.collect()} == {"death", "country"}
    new = matching.apply_changes(nodes, fill).first()
    assert (new.name, new.birth, new.death, new.country) == ("Ana", 1500, 1560, "Peru")


def test_branch_ids_follow_generations(spark):
    people = spark.createDataFrame([(x,) for x in "abcde"], "ged_id string")
    got = matching.branch(people, spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "c"), ("b", "d")], "s string, t string"), "a")
    assert {r.ged_id: (r.gen, r.id) for r in got.collect()} == {"a": (0, 0), "b": (1, 1), "c": (1, 2), "d": (2, 3)}


def test_houses_and_pages(spark, tmp_path):
    from kinframe.sources import graphs

    rows = [(i, f"n{i}", "Lara & Co", "royal" if i else "noble", 900 + i if i else None, None, i) for i in range(4)] + [(9, "x", "", "noble", 1, None, 1)]
    nodes = spark.createDataFrame(rows, "id long, name string, house string, cat string, birth int, death int, gen int")
    stats = reports.house_stats(nodes)
    one = stats.first()
    assert (one.members, one.slug, one.era, one.n_royal) == (4, "lara-co", "c. 901–903 AD", 3)
    members = reports.house_members(nodes)
    assert [r.id for r in members.orderBy("place").collect()] == [1, 2, 3, 0]
    pages = graphs.house_pages(stats, members)
    graphs.write_pages(pages, str(tmp_path / "pages"))
    assert "Lara &amp; Co" in spark.read.text(str(tmp_path / "pages")).first()[0]
    assert "lara-co.html" in graphs.index_page(reports.house_rank(stats))


def test_surnames_of_several_words(spark):
    """Keys with blanks, hyphens and one word, found between word boundaries only."""
    import re

    from kinframe.operators.matching import surname_matches

    texts = ["Juan de Lara y Ponce de León", "saint-simon, duque", "saint simon", "delara", "Lara", "Ponce León", "", None, "x Ponce  de León-Lara"]
    keys = [("lara", "Lara", 1), ("ponce de leon", "Ponce", 2), ("Saint-Simon", "Simon", 1), ("de lara", "Delara", 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {(r.i, r.display) for r in surname_matches(rows, spark.createDataFrame(keys, "surname string, display string, priority int"), F.col("text")).collect()}
    plain = {r.i: r.t for r in rows.select("i", T.norm_voyage(F.col("text")).alias("t")).collect()}
    want = {(i, d) for i, t in plain.items() for k, d, _ in keys if t and re.search(r"\b" + re.escape(k.lower()) + r"\b", t)}
    assert got == want and {(0, "Lara"), (0, "Ponce"), (1, "Simon"), (0, "Delara")} <= got and (2, "Simon") not in got


def test_duplicate_clusters_by_a_sequential_model(spark):
    import random

    rng = random.Random(3)
    people = [(i, rng.choice(["Ana", "Luis", "N N"]), rng.randint(1, 2), rng.choice([None, 0, *range(1500, 1540)])) for i in range(400)]
    want = set()
    for key in {(n, g) for _, n, g, _ in people}:
        clusters = []
        for i, n, g, b in people:
            if (n, g) == key:
                for seed, ids in clusters:
                    if (not seed and not b) or (seed and b and abs(seed - b) <= 5):
                        ids.append(i)
                        break
                else:
                    clusters.append((b, [i]))
        want |= {(key[1], tuple(ids)) for _, ids in clusters if len(ids) > 1}
    nodes = spark.createDataFrame(people, "id long, name string, gen int, birth int")
    got = reports.duplicate_clusters(nodes, spark.createDataFrame([(1, 2)], "s long, t long")).collect()
    assert {(r.gen, tuple(r.ids)) for r in got} == want and all(r.is_orphan != (1 in r.ids or 2 in r.ids) for r in got)


def test_surnames_move_texts_once(spark):
    """The rows made of words carry no texts."""
    import re

    from kinframe.operators.matching import surname_matches

    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200)) + " lara") for i in range(20)], "i int, text string")
    got = surname_matches(rows, spark.createDataFrame([("lara", "Lara", 1), ("l'or", "L'Or", 1)], "surname string, display string, priority int"), F.col("text"))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[next(i for i, line in enumerate(plan) if "Generate explode" in line) + 1]
    assert "Project" in below and not re.search(r"(\[|, )_?text#\d+(,|\])", below)
    assert sorted((r.i, r.display) for r in got.collect()) == [(i, "Lara") for i in range(20)]
