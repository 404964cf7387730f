"""Relations derived from the benchmark tables, in SQL that Spark and the oracle both run.

``{lineitem}`` and the like stand for tables. Spark gets DataFrames for them, the oracle
the names of its views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: Occurrences of an outline per supplier, in a total order, with jumps in generation.
OUTLINE = """
SELECT CAST(l_suppkey AS BIGINT) AS src,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS BIGINT) AS pos,
       CAST(1 + l_partkey % 6 AS INT) AS gen, p_name AS name,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(1500 + l_partkey % 200 AS INT) END AS birth,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(1560 + l_partkey % 200 AS INT) END AS death,
       CASE WHEN l_partkey % 4 = 0 THEN '' ELSE p_type END AS region, p_brand AS house, '' AS country,
       p_name || '|' || COALESCE(CAST(CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(1500 + l_partkey % 200 AS INT) END AS STRING), '?') AS key
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
"""

#: A deep, narrow graph with heavy collapse: parents have larger ids than their children.
EDGES = """
SELECT DISTINCT s, t FROM (
  SELECT p_partkey + 1 + (p_partkey * 7) % 5 AS s, p_partkey AS t FROM {part}
  UNION ALL SELECT p_partkey + 2 + (p_partkey * 3) % 11 AS s, p_partkey AS t FROM {part}
) AS x WHERE s < (SELECT COUNT(*) FROM {part})
"""

#: A pedigree that reaches all parts from 0: parents floor(7 p / 4) + 1 and + 2, so that every fourth
#: couple shares a parent with the next and the depth grows with the logarithm.
PEDIGREE = """
SELECT s, t FROM (
  SELECT 2 * p_partkey - CAST((p_partkey + 3 - (p_partkey + 3) % 4) / 4 AS BIGINT) + k AS s, p_partkey AS t FROM {part} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) AS y
) AS x WHERE s < (SELECT COUNT(*) FROM {part})
"""

#: A shallow graph over all parts: five generations, collapse within each.
LAYERS = """
SELECT DISTINCT s, t FROM (
  SELECT p_partkey + 1 + 5 * ((p_partkey * 3) % 11) AS s, p_partkey AS t FROM {part} WHERE p_partkey % 5 < 4
  UNION ALL SELECT p_partkey + 1 + 5 * ((p_partkey * 7) % 13) AS s, p_partkey AS t FROM {part} WHERE p_partkey % 5 < 4
) AS x WHERE s < (SELECT COUNT(*) FROM {part})
"""

#: People: one per part.
PEOPLE = """
SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, CAST(p_partkey % 40 AS INT) AS gen,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(900 + (p_partkey * 13) % 1000 AS INT) END AS birth,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(950 + (p_partkey * 13) % 1000 AS INT) END AS death,
       CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS house,
       CASE p_type WHEN 'ECONOMY' THEN 'royal' WHEN 'SMALL' THEN 'noble' WHEN 'LARGE' THEN 'clergy' ELSE 'untitled' END AS cat,
       CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'Toledo' ELSE 'Normandy' END AS region,
       CASE WHEN p_partkey % 2 = 0 THEN 'Spain' WHEN p_partkey % 5 = 1 THEN 'Mexico' ELSE '' END AS country,
       p_type AS titles, CAST(1 + p_partkey % 4 AS BIGINT) AS mult, p_partkey % 13 = 0 AS placeholder
FROM {part}
"""

#: The same people as three sources see them.
SOURCES = """
SELECT CAST(f AS INT) AS file_ord, 'src' || CAST(f AS STRING) AS source, name || '|' || COALESCE(CAST(birth AS STRING), '?') AS key, name,
       CAST(gen + 3 * f AS INT) AS gen, birth, death, CASE WHEN (id + f) % 2 = 0 THEN '' ELSE house END AS house, CASE WHEN (id + f) % 3 = 0 THEN 'untitled' ELSE cat END AS cat, mult
FROM (
  SELECT x.*, y.f FROM (
    SELECT CAST(MIN(p_partkey) AS BIGINT) AS id, p_name AS name, CAST(MIN(p_partkey) % 40 AS INT) AS gen, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(1500 + p_size AS INT) END AS birth,
           CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(1560 + p_size AS INT) END AS death, MIN(p_brand) AS house, MIN(CASE p_type WHEN 'ECONOMY' THEN 'royal' ELSE 'noble' END) AS cat, COUNT(*) AS mult
    FROM {part} GROUP BY p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(1500 + p_size AS INT) END, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(1560 + p_size AS INT) END
  ) AS x CROSS JOIN (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2) AS y
) AS z WHERE (id + f) % 4 <> 0
"""


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def oracle(sql: str) -> str:
    """The relation as the oracle reads it."""
    return sql.format(**{t: t for t in tables_of(sql)}).replace(" AS STRING)", " AS VARCHAR)")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores dealt over all cores, for costly expressions.

    Large tables have splits enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so that schemas agree with the oracle's casts."""
    return df.select(*(df[c].cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") or kind.startswith("decimal") else df[c] for c, kind in df.dtypes))
