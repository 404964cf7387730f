"""Scored lookup of pictures through an injected search client, with a resumable cache."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Client = Callable[[str], Sequence[tuple[str, str]]]

# fixed values
KEYWORDS = ("blason", "escudo", "wappen", "coat_of_arms", "coat of arms", "armas", "arms", "shield", "stemma", "blason")
TOO_GENERAL = ("_es.svg", "_pt.svg", "espana", "portugal", "castilla_generic")
#: A result this good ends the search; below the second figure the next wiki is asked; the third is accepted.
STOP, FALL_BACK, ACCEPT = 8, 6, 4
#: Searches asked of the first wiki, and of each later one.
ASKED = (4, 5)
SUFFIXES = ("svg", "png", "jpg", "jpeg")
HEADS = ("escudo casa ", "blason maison ", "coat of arms house ", "wappen ", "armas ", "escudo ")


def score(title: Column, house: Column, slug: Column) -> Column:
    """How well a file title fits a house."""
    t = F.lower(title)
    has = lambda k, n: F.when(F.contains(t, k), n).otherwise(0)
    total = sum((has(F.lit(k), 2) for k in KEYWORDS), F.lit(0))
    words = F.filter(F.split(F.lower(house), r"(?U)\W+"), lambda w: F.length(w) > 2)
    total = total + F.aggregate(words, F.lit(0), lambda s, w: s + F.when(F.contains(t, w), 4).otherwise(0))
    total = total + has(F.replace(slug, F.lit("-"), F.lit(" ")), 6) + F.when(F.contains(F.replace(t, F.lit(" "), F.lit("_")), slug), 6).otherwise(0)
    total = total + F.when(t.endswith(".svg"), 3).when(t.endswith(".png"), 1).otherwise(0)
    return total - sum((has(F.lit(k), 3) for k in TOO_GENERAL), F.lit(0))


def score_of(title: str, house: str, slug: str) -> int:
    """``score`` of one title, for workers that decide while they search."""
    t = title.lower()
    total = sum(2 for k in KEYWORDS if k in t) + sum(4 for w in re.split(r"\W+", house.lower()) if len(w) > 2 and w in t)
    total += 6 * (slug.replace("-", " ") in t) + 6 * (slug in t.replace(" ", "_"))
    total += 3 if title.lower().endswith(".svg") else 1 if title.lower().endswith(".png") else 0
    return total - sum(3 for k in TOO_GENERAL if k in t)


def queries_for(house: Column, slug: Column) -> Column:
    """Search texts for a house, best first."""
    words = F.replace(slug, F.lit("-"), F.lit(" "))
    return F.array(*(F.concat(F.lit(h), words) for h in HEADS), F.concat(F.lit("coat of arms "), house), house)


#: A row of a cache. A null url is a search without result; files of caches that hold less are read with nulls.
CACHE = "slug string, url string, found boolean, title string, source string, caption string, score int"
_TOLD = ("found", "score", "url", "title", "source", "caption")


def _one_each(rows: DataFrame) -> DataFrame:
    """One row per slug: a result before none, then the best score, then by value."""
    return rows.groupBy("slug").agg(F.max(F.struct(*_TOLD)).alias("best")).select("slug", "best.url", "best.found", "best.title", "best.source", "best.caption", "best.score")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a cache (``CACHE``), one per slug; an absent one is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE)
    return _one_each(spark.read.schema(CACHE).parquet(path))


def slots(rate: float) -> Callable[[], None]:
    """A wait for the next request of this task, of ``rate`` a second among all tasks of its barrier stage.

    Time is dealt in slots of 1 / rate, in turn to the tasks, counted from the moment at which
    all have met; so no clocks are compared. A request waits for its task's next slot; slots
    that went by meanwhile are lost, never made up for.
    """
    from pyspark import BarrierTaskContext

    context = BarrierTaskContext.get()
    many, mine = len(context.getTaskInfos()), context.partitionId()
    context.barrier()
    began, turn = time.monotonic(), -1

    def wait() -> None:
        nonlocal turn
        passed = (time.monotonic() - began) * rate
        turn = max(turn + 1, math.ceil((passed - mine) / many))
        time.sleep(max(0.0, began + (turn * many + mine) / rate - time.monotonic()))

    return wait


def best_of(house: str, slug: str, queries: Sequence[str], wikis: Sequence[Client], delay: float, failures: type | tuple = OSError, wait: Callable[[], None] = lambda: None) -> tuple[str | None, str | None, int, int, int]:
    """Title, url and score of the best file, its wiki's number, and how many requests failed.

    Each wiki is asked its share of the searches until a result reaches ``STOP``; a later
    wiki only while the best is below ``FALL_BACK``. Only picture files count.
    """
    best: tuple = (None, None, -1, -1)
    failed = 0
    for k, client in enumerate(wikis):
        if k and best[2] >= FALL_BACK:
            break
        for q in queries[: ASKED[min(k, 1)]]:
            wait()
            try:
                hits = client(q)
            except failures:  # a failed request is an empty one; any other error is the client's bug
                hits, failed = (), failed + 1
            time.sleep(delay)
            for title, url in hits:
                name = title.removeprefix("File:").removeprefix("Datei:")
                if url and name.rpartition(".")[2].lower() in SUFFIXES:
                    best = max(best, (name, url, score_of(name, house, slug), k), key=lambda x: x[2])
            if best[2] >= STOP:
                break
    return (*best, failed) if best[2] >= ACCEPT else (None, None, best[2], -1, failed)


def lookup(houses: DataFrame, cache: DataFrame, client: Client | Sequence[Client], delay: float = 0.0, rate: float | None = None, tasks: int = 4, sources: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Search the houses (house, slug) missing from the cache; (slug, title, url, score, wiki, failed, source, caption).

    ``client(query)`` returns (title, url) pairs and is called on the executors; of
    several clients the later ones are fallbacks. A result needs a score of ``ACCEPT``.
    ``sources`` names the clients, each by a key and the title that ends captions (else
    ``wiki0`` and so on). ``delay`` is the pause after each request, in seconds; time-outs
    are the client's.

    ``rate`` is the most requests a second of the whole cluster. The search is then one barrier
    stage of ``tasks`` tasks that share the time (``slots``): as many cores must be free, and
    the cluster may not allocate executors dynamically. A lost task begins the stage anew.
    """
    import pyarrow as pa

    wikis = [client] if callable(client) else list(client)
    names = [*sources, *((f"wiki{k}", f"wiki{k}") for k in range(len(sources), len(wikis)))]
    todo = houses.join(cache.select("slug"), "slug", "left_anti").select("house", "slug", queries_for(F.col("house"), F.col("slug")).alias("queries"))

    def run(batches):
        wait = slots(rate) if rate else lambda: None
        for batch in batches:
            out = []
            for house, slug, queries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best = best_of(house, slug, queries, wikis, delay, wait=wait)
                told = (names[best[3]][0], f"Arms of the House of {house} — {names[best[3]][1]}") if best[1] else (None, None)
                out.append((slug, *best, *told))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["slug", "title", "url", "score", "wiki", "failed", "source", "caption"])

    schema = "slug string, title string, url string, score int, wiki int, failed int, source string, caption string"
    return todo.repartition(tasks).mapInArrow(run, schema, barrier=True) if rate else todo.mapInArrow(run, schema)


def extend_cache(cache: DataFrame, found: DataFrame, keep_failed: bool = True) -> DataFrame:
    """The cache with new results, one row per slug; searches without a result are remembered as not found.

    Without ``keep_failed`` those whose requests failed are left out, to be asked again.
    """
    told = found if keep_failed else found.where("failed = 0 OR url IS NOT NULL")
    empty = cache.sparkSession.createDataFrame([], CACHE)
    new = told.select("slug", "url", F.col("url").isNotNull().alias("found"), "title", "source", "caption", "score")
    return _one_each(empty.unionByName(cache, allowMissingColumns=True).unionByName(new))


def lookup_into(houses: DataFrame, path: str, client: Client | Sequence[Client], chunks: int = 16, delay: float = 0.0, keep_failed: bool = True, rate: float | None = None, tasks: int = 4, sources: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The cache at ``path`` after searching all houses that it lacks.

    Houses are searched in ``chunks`` parts by the hash of their slug; each part's results
    are appended to the cache as soon as they are there, so a lost job asks at most one part again.
    """
    spark = houses.sparkSession
    for k in range(chunks):
        part = houses.where(F.pmod(F.xxhash64("slug"), F.lit(chunks)) == k).dropDuplicates(["slug"])
        found = lookup(part, read_cache(spark, path), client, delay, rate, tasks, sources)
        extend_cache(spark.createDataFrame([], CACHE), found, keep_failed).write.mode("append").parquet(path)
    return read_cache(spark, path)
