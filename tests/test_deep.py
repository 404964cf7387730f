"""Deep searches against the searches that go level by level, and against plain arithmetic on long lines."""

import random

import pytest

from kinframe.operators import deep, graph, tables

COLUMNS = "s long, t long"


def random_graph(seed, many, turns=False):
    """Lines of single steps with some junctions; with ``turns`` steps lead back as well."""
    rng = random.Random(seed)
    rows = {(i + 1, i) for i in range(many - 1) if rng.random() < 0.95}
    for _ in range(many // 12):
        a, b = sorted(rng.sample(range(many), 2))
        rows.add((b, a))
    if turns:
        for _ in range(3):
            a, b = sorted(rng.sample(range(many), 2))
            rows.add((a, b))
        rows.add((many + 1, many)), rows.add((many, many + 1)), rows.add((7, 7))
    return sorted(rows)


def as_rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def depths_of(steps, roots):
    """Least depths by a queue."""
    depth, queue = dict.fromkeys(roots, 0), list(roots)
    for a in queue:
        for b in (y for x, y in steps if x == a):
            if b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    return depth


@pytest.mark.parametrize("seed,turns,up", [(1, False, True), (2, True, True), (6, True, False)])
def test_bfs_equals_a_queue(spark, seed, turns, up):
    rows = random_graph(seed, 60, turns)
    edges = spark.createDataFrame([*rows, (None, 3), (4, None)], COLUMNS)
    roots = spark.createDataFrame([(0,), (31,), (59,), (59,), (500,)], "id long")
    got = {r.id: (r.depth, r.pred) for r in deep.deep_bfs(edges, roots, up).collect()}
    steps = [(t, s) if up else (s, t) for s, t in rows]
    assert {i: d for i, (d, _) in got.items()} == depths_of(steps, [0, 31, 59, 500])
    for b, (depth, pred) in got.items():
        before = [a for a, to in steps if to == b and a in got and got[a][0] == depth - 1]
        assert pred == (min(before) if depth else None)


def test_equal_to_the_searches_by_level(spark):
    edges = spark.createDataFrame(random_graph(3, 14, True), COLUMNS)
    root = spark.range(1)
    assert as_rows(deep.deep_bfs(edges, root), "id", "depth", "pred") == as_rows(graph.bfs(edges, root), "id", "depth", "pred")
    for nodes in (spark.range(16), spark.range(9)):  # some ends aren't nodes
        assert as_rows(deep.deep_ranks(nodes, edges), "id", "rank", "cyclic") == as_rows(graph.topo_rank(nodes, edges), "id", "rank", "cyclic")


@pytest.mark.parametrize("seed,turns", [(3, False), (4, True)])
def test_ranks_equal_peeling(spark, seed, turns):
    rows = random_graph(seed, 60, turns)
    got = {r.id: (r.rank, r.cyclic) for r in deep.deep_ranks(spark.range(62), spark.createDataFrame(rows, COLUMNS)).collect()}
    want, live, rank = {}, set(rows), 0
    while ready := [i for i in range(62) if i not in want and all(t != i for _, t in live)]:
        want.update((i, (rank, False)) for i in ready)
        live = {(s, t) for s, t in live if s not in want}
        rank += 1
    assert got == {i: want.get(i, (rank, True)) for i in range(62)}


def test_counts_equal_enumeration(spark):
    rows = random_graph(1, 40)
    want, frontier, depth = {}, {0: 1}, 0
    while frontier:
        depth, after = depth + 1, {}
        for a, n in frontier.items():
            for s, t in rows:
                if t == a:
                    after[s] = after.get(s, 0) + n
        want.update(((i, depth), n) for i, n in after.items())
        frontier = after
    got = {(r.id, r.depth): int(r.ways) for r in deep.deep_counts(spark.createDataFrame(rows, COLUMNS), 0).collect()}
    assert got == want and len({i for i, _ in want}) < len(want)


def test_two_lines_of_one_length_count_twice(spark):
    edges = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 2), (4, 3)], COLUMNS)
    assert [(r[0], int(r[2])) for r in as_rows(deep.deep_counts(edges, 0), "id", "depth", "ways")] == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_counts_refuse_cycles_above_the_root(spark):
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (1, 3)], COLUMNS)
    with pytest.raises(ValueError, match="cycle"):
        deep.deep_counts(edges, 0)
    below = spark.createDataFrame([(1, 0), (2, 1), (9, 8), (8, 9)], COLUMNS)
    assert as_rows(deep.deep_counts(below, 0), "id", "depth") == [(1, 1), (2, 2)]


def test_nothing(spark):
    none, ids = spark.createDataFrame([], COLUMNS), spark.createDataFrame([], "id long")
    assert deep.deep_bfs(none, ids).count() == 0 == deep.deep_ranks(ids, none).count() == deep.deep_counts(none, 1).count()
    assert as_rows(deep.deep_bfs(none, spark.range(2)), "id", "depth", "pred") == [(0, 0, None), (1, 0, None)]
    assert as_rows(deep.deep_ranks(spark.range(2), none), "id", "rank", "cyclic") == [(0, 0, False), (1, 0, False)]


def test_a_line_of_100000_takes_few_rounds(spark, monkeypatch):
    many, written = 100_000, []
    for name in ("cut", "cut_counted"):
        monkeypatch.setattr(deep, name, lambda df, f=getattr(tables, name): written.append(1) or f(df))
    edges = spark.range(many - 1).selectExpr("id + 1 AS s", "id AS t")
    found = deep.deep_bfs(edges, spark.range(1))
    assert found.where("depth = id AND (id = 0 OR pred = id - 1)").count() == many == found.count()
    assert len(written) < 40
    written.clear()
    ranked = deep.deep_ranks(spark.range(many), edges)
    assert ranked.where(f"rank = {many} - 1 - id AND NOT cyclic").count() == many == ranked.count()
    assert len(written) < 40
    written.clear()
    assert deep.deep_counts(edges, 0).where("depth = id AND ways = 1").count() == many - 1
    assert len(written) < 40
