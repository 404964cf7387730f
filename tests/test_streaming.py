"""Keyed state and bucketed upserts: replay, splits, restarts, killed batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kinframe.operators.outline import collapse
from kinframe.streaming import buckets, keyed
from kinframe.streaming.incremental import merge_batch

PEOPLE = "key string, src string, pos long, name string, gen int, birth int, death int, country string, region string, house string"


def invented(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.randrange(n // 4)
        rows.append((f"p{k}|?", f"s{rng.randrange(5)}", i, f"Name {i}", rng.randrange(1, 9), rng.choice([None, 1500 + i]), rng.choice([None, 1600 + i]), rng.choice(["", "Spain"]), rng.choice(["", None, f"r{i}"]), rng.choice(["", "h"])))
    return rows


def nodes(df):
    return sorted((tuple(r) for r in df.select(keyed.NODE.names).collect()), key=repr)


def whole(spark, rows):
    """The master of one batch."""
    df = spark.createDataFrame([r for r in dict.fromkeys(rows) if None not in r[:3]], PEOPLE)
    return nodes(collapse(df).withColumn("mult", F.col("mult").cast("long")))


def run(spark, source, master, checkpoint):
    people = spark.readStream.schema(PEOPLE).parquet(source)
    query = keyed.maintain(spark, people, master, checkpoint, buckets=4)
    query.awaitTermination()
    assert query.exception() is None


def put(spark, rows, source):
    spark.createDataFrame(rows, PEOPLE).coalesce(1).write.mode("append").parquet(source)


def test_keyed_state(spark, tmp_path):
    """Split, out of order, replayed, and started anew: the master of one batch."""
    rows = invented(1, 80)
    source, master, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "master", "check"))
    store = buckets.BucketStore(spark, master, 4)
    mixed = random.Random(2).sample(rows, len(rows))
    put(spark, [*mixed[:30], (None, "s", 1, "x", 1, None, None, "", "", ""), ("q|?", None, 1, "x", 1, None, None, "", "", "")], source)
    run(spark, source, master, checkpoint)
    assert nodes(store.read("nodes")) == whole(spark, mixed[:30])
    put(spark, [*mixed[30:], *mixed[:10]], source)  # another start on the same checkpoint, with rows replayed
    run(spark, source, master, checkpoint)
    assert nodes(store.read("nodes")) == whole(spark, rows)
    put(spark, mixed, source)  # everything once more
    run(spark, source, master, checkpoint)
    assert nodes(store.read("nodes")) == whole(spark, rows)
    assert os.path.isdir(f"{tmp_path}/check/state")


def test_few_calls_to_the_state():
    """A person of few places costs one read and one write; of many, no place is lost, and repeats change nothing."""
    from pyspark.sql import Row

    calls = []

    class Value:
        now = None

        def exists(self):
            calls.append("exists")
            return self.now is not None

        def get(self):
            calls.append("get")
            return self.now

        def update(self, value):
            calls.append("update")
            self.now = value

    class Map(dict):
        def containsKey(self, k):
            calls.append("containsKey")
            return k in self

        def updateValue(self, k, v):
            calls.append("updateValue")
            self[k] = v

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def getMapState(self, name, *schemas):
            return Map()

    def fed(state, *places):
        calls.clear()
        return list(state.handleInputRows(("k",), iter([Row(src=s, pos=p, name=f"{s}{p}", gen=p, birth=None, death=None, country="", region="", house="") for s, p in places]), None))

    few, many = keyed.PersonState(), keyed.PersonState()
    few.init(Handle())
    many.init(Handle())
    assert [(r.name, r.gen, r.mult) for r in fed(few, ("b", 2), ("a", 3), ("b", 2))] == [("a3", 2, 2)] and calls == ["get", "update"]
    assert fed(few, ("a", 3)) == [] and calls == ["get"]
    places = [("s", i) for i in range(100, 140)]
    assert [r.mult for r in fed(many, *places[20:], *places[25:30])] == [20]
    assert [(r.name, r.mult) for r in fed(many, *places)] == [("s100", 40)]
    assert fed(many, *places) == []


def lines(rows):
    return [(s, i, t) for s, texts in rows.items() for i, t in enumerate(texts)]


def outline(spark, seed, sources):
    rng = random.Random(seed)
    return spark.createDataFrame(lines({s: [f"{1 + k % 4}. Person {rng.randrange(40)}" + rng.choice(["", f" b. {1500 + rng.randrange(3)}"]) for k in range(12)] for s in sources}), "src string, pos long, line string")


def told(pair):
    return {(r.key, r.gen, r.mult, r.cat) for r in pair[0].collect()}, {(r.s, r.t) for r in pair[1].collect()}


def test_batches_in_buckets_equal_one_batch(spark, tmp_path):
    one, two = outline(spark, 1, ["a", "b", "c"]), outline(spark, 2, ["d", "e"])
    store = buckets.BucketStore(spark, f"file://{tmp_path}/m", 8)
    assert buckets.read_merged(store) is None
    buckets.merge_into(store, one, 0)
    assert told(buckets.read_merged(store)) == told(merge_batch(None, one))
    buckets.merge_into(store, two, 1)
    assert told(buckets.read_merged(store)) == told(merge_batch(None, one.unionByName(two)))
    assert buckets.merge_into(store, two, 1) == []  # a batch run again
    assert told(buckets.read_merged(store, 1)) == told(merge_batch(None, one))  # the older version is still there


def merge_counts(a, b):
    return a.unionByName(b).groupBy("key").agg(F.sum("n").alias("n"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    """A batch of 1 % of the keys rewrites the buckets of those keys and no others."""
    store = buckets.BucketStore(spark, f"file://{tmp_path}/m", 64)
    base = spark.range(2000).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))
    assert len(store.commit(0, {"t": buckets.Change(base, F.col("key"), merge_counts)})) == 64
    before = store.manifest()["tables"]["t"]
    batch = base.where("key < 20")
    expected = {r[0] for r in batch.select(F.pmod(F.xxhash64("key"), F.lit(64))).distinct().collect()}
    written = store.commit(1, {"t": buckets.Change(batch, F.col("key"), merge_counts)})
    after = store.manifest()["tables"]["t"]
    assert {int(f.rpartition("=")[2]) for f in written} == expected and len(expected) <= 20
    assert {b for b in after if after[b] != before[b]} == {str(b) for b in expected}
    assert {(r.key, r.n) for r in store.read("t").collect()} == {(k, 2 if k < 20 else 1) for k in range(2000)}
    assert store.vacuum(keep=1) == len(expected) and store.versions() == [2]
    assert store.read("t").count() == 2000


def test_a_killed_batch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = buckets.BucketStore(spark, f"file://{tmp_path}/m", 4)
    base = spark.createDataFrame([(1, 1), (2, 1)], "key long, n long")
    change = lambda df: {"t": buckets.Change(df, F.col("key"), merge_counts)}
    store.commit(0, change(base))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(buckets.BucketStore, "_swap", killed)
        with pytest.raises(KeyboardInterrupt):
            store.commit(1, change(base))
    assert {(r.key, r.n) for r in store.read("t").collect()} == {(1, 1), (2, 1)} and store.versions() == [1]
    store.commit(1, change(base))  # and it can be run again
    assert {(r.key, r.n) for r in store.read("t").collect()} == {(1, 2), (2, 2)}
    assert store.commit(2, change(base.limit(0))) == [] and store.manifest()["batch"] == 2


def test_ingest_into_buckets(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1. Ana Prueba b. 1900\n2. Luis Prueba b. 1870\n")
    start = lambda: buckets.ingest_buckets(spark, f"file://{folder}", f"file://{tmp_path}/m", f"file://{tmp_path}/c", 4).awaitTermination()
    start()
    (folder / "b.txt").write_text("1. Ana Prueba b. 1900\n2. Marta Solar b. 1880\n")
    start()
    start()  # nothing new
    found, edges = buckets.read_merged(buckets.BucketStore(spark, f"file://{tmp_path}/m", 4))
    assert {(r.key, r.mult) for r in found.collect()} == {("ana prueba|1900", 2), ("luis prueba|1870", 1), ("marta solar|1880", 1)}
    assert {(r.s, r.t) for r in edges.collect()} == {("luis prueba|1870", "ana prueba|1900"), ("marta solar|1880", "ana prueba|1900")}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_a_batch_numbers_its_own_sources_only(spark, monkeypatch):
    """The three batches of bucket_master choose their line items before these are sorted, and leave none out."""
    from kinframe.plans import catalog

    plans, counts = [], []

    def seen(self, batch, changes):
        rows = changes["nodes"].rows
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        counts.append(rows.agg(F.sum("mult")).first()[0])

    with monkeypatch.context() as m:
        m.setattr(buckets.BucketStore, "commit", seen)
        m.setattr(buckets.BucketStore, "read", lambda self, table: spark.createDataFrame([], "key string, gen int, mult long"))
        catalog.queries()["bucket_master"](spark, SF)
    assert [p.index(" % 3) = ") > p.index("Window ") for p in plans] == [True] * 3
    assert sum(counts) == spark.read.parquet(f"{SF}/lineitem.parquet").count() and min(counts) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_registered_queries(spark):
    """Clients in keyed state, and outlines in buckets, against plain groupings."""
    from kinframe.plans import catalog
    from kinframe.plans.relations import OUTLINE, relation

    got = {r.key: (r.name, r.gen, r.country, r.mult) for r in catalog.queries()["keyed_master"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/clients.parquet").collect():
        if r.client_id is None:
            continue
        key = f"m{r.client_id if r.master_id is None else r.master_id}"
        want.setdefault(key, {}).setdefault(("none" if r.source is None else r.source, r.client_id), r)
    assert set(got) == set(want)
    for key, rows in want.items():
        first = rows[min(rows)]
        name, gen, _, mult = got[key]
        assert mult == len(rows) and gen == min((r.nation_id for r in rows.values() if r.nation_id is not None), default=None)
        assert name == first.name
    made = {tuple(r) for r in catalog.queries()["bucket_master"](spark, SF).collect()}
    plain = relation(spark, SF, OUTLINE).groupBy("key").agg(F.min("gen").alias("gen"), F.count("*").alias("mult"))
    assert made == {tuple(r) for r in plain.collect()}
