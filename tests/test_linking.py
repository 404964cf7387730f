"""Offsets, flat remaps and cycles against sequential models."""

import random

import pytest

from kinframe.operators import graph, linking, merge


def links_of(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, shift long")


def found(df):
    return {r.id: (r.root, r.offset) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_offsets_of_agreeing_links(spark, seed):
    rng = random.Random(seed)
    own = {i: rng.randint(-50, 50) for i in range(120)}
    pairs = [(a, b) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(90)) if a != b]
    got = found(linking.offsets(links_of(spark, [(a, b, own[a] - own[b]) for a, b in pairs])))
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    ends = {x for p in pairs for x in p}
    assert got == {x: (find(x), own[x] - own[find(x)]) for x in ends}


def test_offsets_of_a_long_path_and_of_nothing(spark):
    path = links_of(spark, [(i + 1, i, 3) for i in range(2000)])
    assert found(linking.offsets(path)) == {i: (0, 3 * i) for i in range(2001)}
    assert found(linking.offsets(links_of(spark, []))) == {} == found(linking.offsets(links_of(spark, [(1, 1, 5), (None, 2, 1)])))


def test_contradictions_are_named(spark):
    links = links_of(spark, [(2, 1, 5), (3, 2, 5), (3, 1, 99)])
    got = linking.offsets(links)
    odd = linking.contradictions(links, got).collect()
    assert len(odd) == 1 and odd[0]["is"] != odd[0].shift


def node_rows(files):
    return [(f, f"k{k}", f"n{k}", g, None, None, 1) for f, people in enumerate(files) for k, g in people]


SCHEMA = "file_ord int, key string, name string, gen int, birth int, death int, mult long"


def test_many_files_equal_the_loop(spark):
    """Every file shares somebody with an earlier one; generations agree but for a shift."""
    rng = random.Random(7)
    gen = {k: rng.randint(1, 30) for k in range(60)}
    files, seen = [], [0]
    for _ in range(8):
        people = {rng.choice(seen), *rng.sample(range(60), 6)}
        shift = rng.randint(-9, 9)
        files.append([(k, gen[k] + shift) for k in sorted(people)])
        seen += people
    tables = [spark.createDataFrame([r[1:] for r in node_rows([f])], SCHEMA.replace("file_ord int, ", "")) for f in files]
    loop = {r.key: (r.gen, r.mult) for r in merge.merge_files(tables).collect()}
    nodes = spark.createDataFrame(node_rows(files), SCHEMA)
    assert {r.key: (r.gen, r.mult) for r in linking.merge_many(nodes).collect()} == loop


def test_two_hundred_files_in_a_row(spark):
    files = [[(i, 5 * i % 7), (i + 1, 5 * i % 7 + 1)] for i in range(200)]
    got = {r.key: r.gen for r in linking.merge_many(spark.createDataFrame(node_rows(files), SCHEMA)).collect()}
    assert got == {f"k{i}": i for i in range(201)}


def test_files_apart_and_empty_tables(spark):
    nodes = spark.createDataFrame([*node_rows([[(1, 4)], [(2, 9)]]), (None, "k3", "n", 7, None, None, 1), (0, None, "x", None, None, None, 1)], SCHEMA)
    assert {(r.file_ord, r.root, r.offset) for r in linking.file_offsets(nodes).collect()} == {(0, 0, 0), (1, 1, 0)}
    assert {r.key: r.gen for r in linking.merge_many(nodes).collect()} == {"k1": 0, "k2": 5, "k3": 3, None: None}
    assert linking.merge_many(spark.createDataFrame([], SCHEMA)).collect() == []


def flat(rows):
    to = {}
    for d, c in rows:
        if d is not None and c is not None and d != c:
            to[d] = min(c, to.get(d, c))
    out = {}
    for d in to:
        seen, x = [], d
        while x in to and x not in seen:
            seen.append(x)
            x = to[x]
        end = min(seen[seen.index(x) :]) if x in seen else x
        if end != d:
            out[d] = end
    return out


@pytest.mark.parametrize("seed", range(4))
def test_flat_remaps(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([5, 40, 300])
    rows = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * 0.9))] + [(None, 1), (1, None), (2, 2)]
    if seed == 3:
        rows = [(i, i + 1) for i in range(1000)] + [(1000 + i, 1000 + (i + 1) % 70) for i in range(70)] + [(3000 - i, 3001 - i) for i in range(300)] + [(3001, 1005)]
    got = {r.dup: r.canon for r in linking.flatten(spark.createDataFrame(rows, "dup long, canon long")).collect()}
    assert got == flat(rows)
    assert linking.flatten(spark.createDataFrame([], "dup long, canon long")).collect() == []


def test_contraction_follows_chains_and_cycles(spark):
    nodes = spark.createDataFrame([(0, "", 1), (1, "b", 1), (2, "", 1), (3, "", 1), (7, "", 1), (8, "h", 1)], "id long, name string, mult long")
    edges = spark.createDataFrame([(1, 0), (3, 0), (8, 3), (7, 8)], "s long, t long")
    remap = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7)], "dup long, canon long")
    merged, e = graph.contract(nodes, edges, remap)
    assert {tuple(r) for r in merged.collect()} == {(0, None, 1), (3, "b", 3), (7, "h", 2)}
    assert {tuple(r) for r in e.collect()} == {(3, 0), (7, 3)}


def knots(rows):
    out = {}
    after = {}
    for s, t in rows:
        after.setdefault(s, set()).add(t)

    def reach(x):
        seen, todo = set(), list(after.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += after.get(y, ())
        return seen

    far = {x: reach(x) for x in after}
    for x in far:
        if x in far[x]:
            out[x] = min(y for y in far[x] if x in far.get(y, ()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cycles(spark, seed):
    rng = random.Random(seed)
    n = (6, 30, 60, 60)[seed]
    rows = [(rng.randrange(n), rng.randrange(n)) for _ in range((8, 33, 66, 80)[seed])]
    got = {r.id: r.cycle for r in linking.cycles(spark.createDataFrame(rows, "s long, t long")).collect()}
    assert got == knots(rows)
    assert linking.cycles(spark.createDataFrame([], "s long, t long")).collect() == []


def test_path_counts_end_on_cycles(spark):
    two = spark.createDataFrame([(1, 0), (0, 1)], "s long, t long")
    with pytest.raises(ValueError, match="cycle"):
        graph.path_counts(two, 0, max_gen=None)
    below = spark.createDataFrame([(1, 0), (2, 1), (7, 8), (8, 7)], "s long, t long")  # the cycle is out of reach
    assert {(r.id, r.ways) for r in graph.path_counts(below, 0, max_gen=None).collect()} == {(1, 1), (2, 1)}
    line = spark.createDataFrame([(i + 1, i) for i in range(60)], "s long, t long")  # long, without a cycle
    assert graph.path_counts(line, 0, max_gen=None).count() == 60


@pytest.mark.parametrize("unknown", ["renormalise", "half"])
def test_inbreeding_equals_kinship_of_parents(spark, unknown):
    """Rows of ancestors give what the pairs give, with one, two and no known parents."""
    rng = random.Random(5)
    edges = [(p, c) for c in range(24) for p in rng.sample(range(c + 1, min(c + 9, 30)), rng.choice([0, 1, 2, 2, 2]))]
    e = spark.createDataFrame(edges, "s long, t long")
    nodes = spark.createDataFrame([(i,) for i in range(30)], "id long")
    got = {r.id: (r.f, r.status) for r in graph.inbreeding(nodes, e, nodes, unknown).collect()}
    parents = {}
    for p, c in edges:
        parents.setdefault(c, []).append(p)
    pairs = spark.createDataFrame([(min(ps), max(ps)) for ps in parents.values() if len(ps) == 2], "a long, b long").distinct()
    phi = {(r.a, r.b): r.phi for r in graph.kinship(e, graph.topo_rank(nodes, e), pairs, unknown).collect()}
    for i in range(30):
        ps = parents.get(i, [])
        assert got[i] == ((pytest.approx(phi[min(ps), max(ps)], abs=1e-12), "ok") if len(ps) == 2 else (None, "undefined"))
    assert any(f > 0 for f, _ in got.values() if f)
    assert graph.inbreeding(nodes, e, nodes.limit(0)).collect() == []


def test_joins_of_written_tables_are_merged(spark):
    """A table that a loop wrote is never sent to the driver, however small it is."""
    from kinframe.operators.tables import cut, cut_counted

    a, b = cut(spark.range(50)), cut_counted(spark.range(20).withColumnRenamed("id", "t"))[0]
    for df in (spark.range(9).join(a, "id"), a.join(b.selectExpr("t AS id").distinct(), "id", "left_anti")):
        assert df.count() > 0
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_file_links_make_their_rows_once(spark):
    """What a person's files have is grouped once, not once for the person's first file again."""
    nodes = spark.createDataFrame(node_rows([[(0, 1), (1, 2)], [(1, 5), (2, 6)], [(2, 1), (0, 9)]]), SCHEMA)
    got = linking.file_links(nodes)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, -3, 1, 1), (2, 0, -8, 1, 1), (2, 1, 5, 1, 1)]


def test_folding_works_the_nodes_out_once(spark):
    """Years that a key lacks are found without a second copy of what the nodes are made of; keys of nobody stay alone."""
    rows = [("a|?", "a", 2, None, None, 1), ("a|1500", "a", 1, 1500, None, 2), ("a|1600", "a", 3, 1600, None, 2), ("b|?", "b", 1, None, None, 1), ("_us:1::x|?", "x", 1, None, None, 1), ("_us:2::y", "y", 1, None, None, 1)]
    folded, remap = merge.fold_yearless(spark.createDataFrame(rows, "key string, name string, gen int, birth int, death int, mult long"))
    assert "Join" not in folded._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in remap.collect()] == [("a|?", "a|1500")]
    assert {(r.key, r.gen, r.birth, r.mult) for r in folded.collect()} == {("a|1500", 1, 1500, 3), ("a|1600", 3, 1600, 2), ("b|?", 1, None, 1), ("_us:1::x|?", 1, None, 1), ("_us:2::y", 1, None, 1)}
