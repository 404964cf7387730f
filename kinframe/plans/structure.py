"""Queries over many links: files aligned at once, chains of remaps, cycles, inbreeding by ancestors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinframe.operators import deep, graph, linking, merge, outline
from kinframe.operators.tables import work_dir
from kinframe.plans.catalog import query
from kinframe.plans.relations import OUTLINE, oracle, relation
from kinframe.streaming import buckets, keyed

#: One file per supplier, holding its parts as people, each with generations of its own zero.
FILES = """
SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS file_ord, 'p' || CAST(l_partkey AS STRING) AS key, 'Person ' || CAST(l_partkey AS STRING) AS name,
       CAST(l_partkey % 40 + (l_suppkey * 7) % 13 AS BIGINT) AS gen, CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN NULL ELSE CAST(1500 + l_partkey % 200 AS INT) END AS birth,
       CAST(NULL AS INT) AS death, CAST(1 AS BIGINT) AS mult
FROM {lineitem}
"""

#: The offset of each file reached from file to file over people they share, as all agree.
FILE_LINKS = f"""f AS ({oracle(FILES)}), first AS (SELECT key, min(file_ord) AS b FROM f GROUP BY key),
l AS (SELECT DISTINCT f.file_ord AS a, first.b, g.gen - f.gen AS shift FROM f JOIN first USING (key) JOIN f g ON g.key = f.key AND g.file_ord = first.b WHERE f.file_ord > first.b),
u AS (SELECT a, b, shift FROM l UNION SELECT b, a, -shift FROM l),
r AS (SELECT DISTINCT file_ord AS file, file_ord AS root, CAST(0 AS BIGINT) AS shift FROM f WHERE file_ord = (SELECT min(file_ord) FROM f)
  UNION SELECT u.a, r.root, r.shift + u.shift FROM r JOIN u ON u.b = r.file)"""


@query("file_offsets", f"WITH RECURSIVE {FILE_LINKS} SELECT file AS file_ord, root, shift AS \"offset\" FROM r")
def _file_offsets(spark, sf):
    return linking.file_offsets(relation(spark, sf, FILES))


@query("merge_many", f"""WITH RECURSIVE {FILE_LINKS}, m AS (SELECT f.*, f.gen + r.shift AS g FROM f JOIN r ON r.file = f.file_ord),
k AS (SELECT key, arg_min(name, file_ord) AS name, arg_min(g, file_ord) AS gen, CAST(arg_min(birth, CASE WHEN birth IS NOT NULL THEN file_ord END) AS BIGINT) AS birth, sum(mult)::BIGINT AS mult FROM m GROUP BY key)
SELECT key, name, gen - (SELECT min(gen) FROM k) AS gen, birth, mult FROM k""")
def _merge_many(spark, sf):
    return linking.merge_many(relation(spark, sf, FILES)).select("key", "name", "gen", "birth", "mult")


#: The same files, of which every eleventh has one person a generation off, and which share few.
@query("offset_conflicts", f"""WITH f AS (SELECT file_ord, key, gen + CASE WHEN file_ord % 11 = 5 AND key LIKE '%7' THEN 1 ELSE 0 END AS gen FROM ({oracle(FILES)})),
first AS (SELECT key, min(file_ord) AS b FROM f GROUP BY key),
l AS (SELECT f.file_ord AS a, first.b, f.key, g.gen - f.gen AS shift, g.gen AS g FROM f JOIN first USING (key) JOIN f g ON g.key = f.key AND g.file_ord = first.b WHERE f.file_ord > first.b),
d AS (SELECT a, b, arg_min(shift, g * 10000000 + CAST(substr(key, 2) AS BIGINT)) AS shift, count(*) AS people FROM l WHERE key = key GROUP BY a, b)
SELECT d.a, d.b, d.people, count(*) FILTER (WHERE l.shift <> d.shift) > 0 AS disputed FROM d JOIN l ON l.a = d.a AND l.b = d.b GROUP BY d.a, d.b, d.people""")
def _offset_conflicts(spark, sf):
    odd = (F.col("file_ord") % 11 == 5) & F.col("key").endswith("7")
    files = relation(spark, sf, FILES).withColumn("gen", F.col("gen") + F.when(odd, 1).otherwise(0))
    return linking.file_links(files).select("a", "b", "people", (F.col("agree") < F.col("people")).alias("disputed"))


#: Chains of 49 steps down to a multiple of 50; in every fourth block that one leads back to the top.
CHAINS = """
SELECT CAST(p_partkey AS BIGINT) AS dup, CAST(p_partkey - 1 AS BIGINT) AS canon FROM {part} WHERE p_partkey % 50 <> 0
UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey + 49 AS BIGINT) FROM {part} WHERE p_partkey % 200 = 50 AND p_partkey + 49 < (SELECT COUNT(*) FROM {part})
"""

FLAT = f"""c AS ({oracle(CHAINS)}), w AS (SELECT dup, canon AS spot, least(dup, canon) AS low, 1 AS n FROM c
  UNION ALL SELECT w.dup, c.canon, least(w.low, c.canon), n + 1 FROM w JOIN c ON c.dup = w.spot WHERE n < 60),
flat AS (SELECT dup, CASE WHEN max(n) = 60 THEN min(low) ELSE arg_max(spot, n) END AS canon FROM w GROUP BY dup)"""


@query("remap_chains", f"WITH RECURSIVE {FLAT} SELECT dup, canon FROM flat WHERE dup <> canon")
def _remap_chains(spark, sf):
    return linking.flatten(relation(spark, sf, CHAINS))


@query("contract_chains", f"""WITH RECURSIVE {FLAT}, e AS (SELECT p_partkey AS t, p_partkey + 37 AS s FROM part WHERE p_partkey + 37 < (SELECT count(*) FROM part)),
m AS (SELECT coalesce(a.canon, s) AS s, coalesce(b.canon, t) AS t FROM e LEFT JOIN flat a ON a.dup = s LEFT JOIN flat b ON b.dup = t)
SELECT DISTINCT s, t FROM m WHERE s <> t""")
def _contract_chains(spark, sf):
    nodes = relation(spark, sf, "SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name FROM {part}")
    edges = relation(spark, sf, "SELECT CAST(p_partkey + 37 AS BIGINT) AS s, CAST(p_partkey AS BIGINT) AS t FROM {part} WHERE p_partkey + 37 < (SELECT COUNT(*) FROM {part})")
    return graph.contract(nodes, edges, relation(spark, sf, CHAINS))[1]


#: Lines of 12 that lead on to the next line within blocks of five; every third line is closed to a ring, some have chords.
RINGS = """
SELECT CAST(p_partkey AS BIGINT) AS s, CAST(p_partkey + 1 AS BIGINT) AS t FROM {part} WHERE p_partkey % 60 <> 59 AND p_partkey + 1 < (SELECT COUNT(*) FROM {part})
UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey - 11 AS BIGINT) FROM {part} WHERE p_partkey % 36 = 11
UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey + 0 AS BIGINT) FROM {part} WHERE p_partkey % 97 = 3
UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey - 2 AS BIGINT) FROM {part} WHERE p_partkey % 61 = 25
"""


@query("cycle_members", f"""WITH RECURSIVE e AS (SELECT DISTINCT s, t FROM ({oracle(RINGS)})),
r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t)
SELECT a.s AS id, min(a.t) AS cycle FROM r a JOIN r b ON b.s = a.t AND b.t = a.s GROUP BY a.s""")
def _cycle_members(spark, sf):
    return linking.cycles(relation(spark, sf, RINGS))


def _new_folder(spark, name: str) -> str:
    """A folder of this call alone, which stays."""
    return f"{work_dir(spark)}/kinframe-{uuid.uuid4().hex}/{name}"


#: Client records as people: one person per master, seen by several sources.
CLIENTS = """
SELECT 'm' || CAST(COALESCE(master_id, client_id) AS STRING) AS key, COALESCE(source, 'none') AS src, CAST(client_id AS BIGINT) AS pos, name, CAST(nation_id AS INT) AS gen,
       CAST(NULL AS INT) AS birth, CAST(NULL AS INT) AS death, city AS country, segment AS region, email AS house
FROM {clients}
"""


@query("keyed_master")
def _keyed_master(spark, sf):
    """The clients as a stream into keyed state, whose changed nodes go into a bucketed master; what the master holds."""
    raw = spark.read.parquet(f"{sf}/clients.parquet")
    stream = spark.readStream.schema(raw.schema).parquet(f"{sf}/client[s].parquet")  # as a pattern the table may be one file, too
    people = spark.sql(CLIENTS, clients=stream)
    path = _new_folder(spark, "keyed")
    running = keyed.maintain(spark, people, f"{path}/master", f"{path}/checkpoint")
    running.awaitTermination()
    return buckets.BucketStore(spark, f"{path}/master").read("nodes")


@query("bucket_master")
def _bucket_master(spark, sf):
    """The outlines in three batches into a bucketed master; what its last version holds."""
    items, parts = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "part"))
    store = buckets.BucketStore(spark, _new_folder(spark, "buckets"))
    for n in range(3):
        # a batch is made of the items of its own sources: a remainder isn't pushed below the window that numbers them
        people = spark.sql(OUTLINE, lineitem=items.where(F.col("l_suppkey") % 3 == n), part=parts)
        nodes = outline.collapse(people).drop("first_seen")
        least = lambda a, b: merge.merge_nodes(a.withColumn("file_ord", F.lit(0)).unionByName(b.withColumn("file_ord", F.lit(1))), gen="min").select(a.columns)
        store.commit(n, {"nodes": buckets.Change(nodes, F.regexp_extract("key", r"^(.*)\\|", 1), least)})
    return store.read("nodes").select("key", "gen", "mult")


#: Lines of 100; the last of a line has two parents who begin lines of their own, and every third couple
#: shares one with the next line: the depth is 100 times the logarithm of the number of lines.
LONG = """
SELECT CAST(p_partkey + 1 AS BIGINT) AS s, CAST(p_partkey AS BIGINT) AS t FROM {part} WHERE p_partkey % 100 <> 99 AND p_partkey + 1 < (SELECT COUNT(*) FROM {part})
UNION SELECT s, t FROM (
  SELECT CAST(100 * (2 * ((p_partkey - p_partkey % 100) / 100) + k) AS BIGINT) AS s, CAST(p_partkey AS BIGINT) AS t FROM {part}
  CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) AS y WHERE p_partkey % 100 = 99 AND (k < 3 OR p_partkey % 300 = 99)
) AS x WHERE s < (SELECT COUNT(*) FROM {part})
"""

WITH_LONG = f"WITH RECURSIVE l AS ({oracle(LONG)})"


@query("deep_bfs", f"""{WITH_LONG}, b(id, depth) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT l.s, b.depth + 1 FROM b JOIN l ON l.t = b.id),
m AS (SELECT id, min(depth) AS depth FROM b GROUP BY id)
SELECT m.id, m.depth, min(p.id) AS pred FROM m LEFT JOIN l ON l.s = m.id LEFT JOIN m p ON p.id = l.t AND p.depth = m.depth - 1 GROUP BY m.id, m.depth""")
def _deep_bfs(spark, sf):
    return deep.deep_bfs(relation(spark, sf, LONG), spark.createDataFrame([(0,)], "id long"))


@query("deep_ranks", f"""{WITH_LONG}, b(id, rank) AS (SELECT p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey NOT IN (SELECT t FROM l) UNION SELECT l.t, b.rank + 1 FROM b JOIN l ON l.s = b.id)
SELECT id, max(rank) AS rank, false AS cyclic FROM b GROUP BY id""")
def _deep_ranks(spark, sf):
    return deep.deep_ranks(relation(spark, sf, "SELECT CAST(p_partkey AS BIGINT) AS id FROM {part}"), relation(spark, sf, LONG))


@query("deep_counts", f"""{WITH_LONG}, b(id, depth, ways) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS HUGEINT)
  UNION ALL SELECT l.s, b.depth + 1, CAST(sum(b.ways) AS HUGEINT) FROM b JOIN l ON l.t = b.id GROUP BY l.s, b.depth + 1)
SELECT id, depth, CAST(ways AS BIGINT) AS ways FROM b WHERE depth > 0""")
def _deep_counts(spark, sf):
    return deep.deep_counts(relation(spark, sf, LONG), 0)
