"""Every registered query against its SQL oracle, on the smallest tables."""

import os

import duckdb
import pytest

from kinframe.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def canon(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalog.oracle_sql()[name]})").fetchall()
    assert canon(tuple(r) for r in df.select(columns).collect()) == canon(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_batches_merge_like_one(spark):
    """Splitting outlines into batches changes nothing but first-seen fields."""
    from pyspark.sql import functions as F

    from kinframe.streaming.incremental import merge_batch

    rows = [(f"s{i}", j, f"{1 + (i + j) % 3}. Person {chr(97 + (i * j) % 9)}{chr(98 + (i * j) % 9)} b. {1500 + (i * j) % 9}") for i in range(6) for j in range(8)]
    lines = spark.createDataFrame(rows, "src string, pos long, line string")
    whole = merge_batch(None, lines)
    parts = merge_batch(merge_batch(None, lines.where("src < 's3'")), lines.where("src >= 's3'"))
    pick = lambda g: {(r.key, r.gen, r.mult) for r in g[0].collect()}
    assert pick(whole) == pick(parts)
    assert {tuple(r) for r in whole[1].collect()} == {tuple(r) for r in parts[1].collect()}
    assert whole[0].agg(F.sum("mult")).first()[0] == len(rows)


def test_outlines_come_back_from_files(spark):
    """What was written as text is read as it was: every line in its source, at its place."""
    from kinframe.plans.relations import OUTLINE, relation

    columns = ["src", "pos", "gen", "name", "birth"]
    want = relation(spark, SF, OUTLINE).select(columns).collect()
    assert canon(tuple(r) for r in catalog.queries()["outline_files"](spark, SF).select(columns).collect()) == canon(tuple(r) for r in want)


def test_graphs_come_back_from_files(spark):
    from kinframe.plans.relations import PEOPLE, relation

    columns = ["id", "name", "gen", "birth", "cat", "mult"]
    want = relation(spark, SF, PEOPLE).select(columns).collect()
    assert canon(tuple(r) for r in catalog.queries()["graph_files"](spark, SF).select(columns).collect()) == canon(tuple(r) for r in want)
