"""Operators and queries against sequential models of the whole job, on the smallest tables and a deep graph."""

import os
from collections import defaultdict

import pytest

from kinframe.operators import graph, reports
from kinframe.plans import catalog
from kinframe.plans.relations import EDGES, LAYERS, PEDIGREE, PEOPLE, relation

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def rows(spark, name):
    return catalog.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def parents(spark):
    out = defaultdict(list)
    for r in sorted(relation(spark, SF, EDGES).collect()):
        out[r.t].append(r.s)
    return out


def queue(step, root):
    """The path by which a queue first meets each node."""
    order, path = [root], {root: [root]}
    for v in order:
        for p in step.get(v, ()):
            if p not in path:
                path[p] = [*path[v], p]
                order.append(p)
    return path


@tables
def test_searches_reach_the_end(spark, parents):
    path = queue(parents, 0)
    depth = {v: len(p) - 1 for v, p in path.items()}
    assert max(depth.values()) > graph.TOGETHER
    edges, root = relation(spark, SF, EDGES), spark.createDataFrame([(0,)], "id long")
    reached = graph.bfs(edges, root)
    assert {r.id: r.depth for r in reached.collect()} == depth
    assert {r.id: r.path for r in graph.bfs(edges, root, keep_path=True).collect()} == path
    children = defaultdict(list)
    for t, ss in parents.items():
        for s in ss:
            children[s].append(t)
    above, below = queue(parents, 100), queue(children, 100)
    want = {v: len(p) - 1 for v, p in above.items()} | {v: 1 - len(p) for v, p in below.items() if v != 100}
    assert {r.id: r.distance for r in graph.closure(edges, spark.createDataFrame([(100,)], "id long")).collect()} == want
    houses = defaultdict(list)
    for r in relation(spark, SF, PEOPLE).where("house <> ''").collect():
        houses[r.house].append((r.id, r.birth))
    nearest = {h: min(((depth[i], i) for i, _ in m if i in depth), default=None) for h, m in houses.items()}
    oldest = {h: min((9999 if b is None else b, i) for i, b in m)[1] for h, m in houses.items()}
    want = {h: (n[1], n[0]) if n else (oldest[h], None) for h, n in nearest.items()}
    assert {r.house: (r.id, r.depth) for r in reports.house_nearest(relation(spark, SF, PEOPLE), reached).collect()} == want


def test_a_search_has_no_bound_of_its_own():
    from inspect import signature

    assert signature(graph.bfs).parameters["max_depth"].default is None
    assert signature(graph.closure).parameters["max_depth"].default is None


@tables
def test_positional_matching_reaches_its_fixed_point(spark):
    """Competitors that lose a node need a fifth pass on these tables."""
    parents = defaultdict(set)
    for r in relation(spark, SF, LAYERS).collect():
        parents[r.t].add(r.s)
    ids = {r.id for r in relation(spark, SF, PEOPLE).collect()}
    found = {i: i for i in ids - set().union(*parents.values())}  # nobody's parents
    passes = 0
    while True:
        taken, wish = set(found.values()), {}
        for child, node in found.items():
            for g in parents[child] - set(found):
                for h in parents[node] - taken:
                    if g % 7 == h % 7:
                        wish[g] = min(h, wish.get(g, h))
        new = {h: g for g, h in sorted(wish.items(), reverse=True)}  # of competitors the least wins
        if not new:
            break
        passes += 1
        found |= {g: h for h, g in new.items()}
    assert passes == 5
    assert {r.ged_id: r.id for r in rows(spark, "match_positional")} == {f"g{g}": h for g, h in found.items()}


@tables
def test_path_counts_and_implex_reach_25_generations(spark, parents):
    found = graph.path_counts(relation(spark, SF, EDGES), 0)
    ways, want = {0: 1}, {}
    for gen in range(1, 26):
        above = defaultdict(int)
        for v, w in ways.items():
            for p in parents[v]:
                above[p] += w
        ways = dict(above)
        want |= {(v, gen): w for v, w in ways.items()}
    assert {(r.id, r.depth): r.ways for r in found.collect()} == want
    filled, distinct = defaultdict(int), defaultdict(int)
    for (_, gen), w in want.items():
        filled[gen] += w
        distinct[gen] += 1
    assert {r.gen: (r.filled, r.distinct_ancestors) for r in graph.implex(found).collect()} == {g: (filled[g], distinct[g]) for g in filled}
    assert [tuple(r) for r in graph.implex_summary(found).collect()] == [(sum(filled.values()), len({v for v, _ in want}), 25)]
    assert {r.gen for r in catalog.flagship(spark, SF).collect()} == set(range(1, 26))


@tables
def test_the_pedigree_grows_with_the_logarithm(spark):
    """The queries' graph: two parents each, shared ancestors, and a depth that needs no bound."""
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    parents = defaultdict(list)
    for r in sorted(relation(spark, SF, PEDIGREE).collect()):
        parents[r.t].append(r.s)
    path = queue(parents, 0)
    assert len(path) == n and max(len(p) for p in path.values()) < 1.5 * n.bit_length()
    assert {r.id: r.depth for r in rows(spark, "bfs_depth")} == {v: len(p) - 1 for v, p in path.items()}
    assert any(r.ways > 1 for r in rows(spark, "path_counts"))


def test_dense_ids_of_many_partitions(spark):
    """Ranges that adaptive execution joins anew in each plan; rows and counts must agree all the same."""
    from pyspark.sql import functions as F

    from kinframe.operators.outline import dense_ids

    wide = spark.range(0, 300_000, 1, 50).select(F.xxhash64("id").alias("first_seen"), F.repeat(F.col("id").cast("string"), 12).alias("name"))
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = dense_ids(wide)
        from pyspark.sql import Window

        got = ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("a"), F.max("id").alias("b")).first()
        wrong = ids.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_seen"))).where("k <> id + 1").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tuple(got) == (300_000, 300_000, 0, 299_999) and wrong == 0


def test_kinship_of_shared_pairs(spark):
    """Phi of all pairs of a random pedigree against the recursion over memoised pairs."""
    import random
    from functools import lru_cache

    rng = random.Random(12)
    parents = {i: sorted(rng.sample(range(i + 1, 40), min(rng.choice([0, 1, 2, 2, 2]), 39 - i))) for i in range(40)}
    edges = spark.createDataFrame([(s, t) for t, ss in parents.items() for s in ss], "s long, t long")
    nodes = spark.range(40)
    ranks = {r.id: r.rank for r in graph.topo_rank(nodes, edges).collect()}

    @lru_cache(None)
    def phi(a, b):
        if a == b:
            return 0.5 * (1 + (phi(*parents[a]) if len(parents[a]) == 2 else 0))
        if (ranks[a], a) < (ranks[b], b):
            a, b = b, a
        return sum(phi(p, b) for p in parents[a]) / len(parents[a]) if parents[a] else 0.0

    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(120)]
    got = {(r.a, r.b): r.phi for r in graph.kinship(edges, graph.topo_rank(nodes, edges), spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got.keys() == set(pairs) and all(abs(got[p] - phi(*p)) < 1e-12 for p in pairs)
    assert graph.kinship(edges, graph.topo_rank(nodes, edges), spark.createDataFrame([], "a long, b long")).count() == 0
