"""People as keyed state: one state per person in a state store, kept up by a stream.

``transformWithState`` holds, for each key, what the merged node is made of and which rows have
been seen, in RocksDB, so a state may be larger than memory and survives a restart with the
stream's checkpoint. Every field is decided by the row's place (source, position), never by the
time of arrival: a replayed file changes nothing, and a stream that is split into any batches
ends in the master that one batch gives.

Defined results: rows with a null key, source or position are dropped, as they can't be told
from their repeats; of rows with the same place the first one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fields that take the first known value, and those that take the first row's value.
FIRST_KNOWN = ("birth", "death", "region", "house")
FIRST = ("name", "country")
_KINDS = {"birth": IntegerType(), "death": IntegerType(), "region": StringType(), "house": StringType(), "name": StringType(), "country": StringType()}
NODE = StructType(
    [StructField("key", StringType()), StructField("name", StringType()), StructField("gen", IntegerType())]
    + [StructField(c, _KINDS[c]) for c in ("birth", "death", "country", "region", "house")] + [StructField("mult", LongType())]
)
_PLACE = StructType([StructField("src", StringType()), StructField("pos", LongType())])
#: So many places stand beside a person's fields; further ones have an entry each in a map.
HELD = 16
#: Of each field its value and the place (source, position) that gave it; the first places taken in.
_STATE = StructType([StructField("gen", IntegerType()), StructField("mult", LongType())] + [f for c in (*FIRST, *FIRST_KNOWN) for f in (StructField(c, _KINDS[c]), StructField(f"{c}_src", StringType()), StructField(f"{c}_pos", LongType()))] + [StructField("held", ArrayType(_PLACE))])
_SEEN = StructType([StructField("seen", IntegerType())])


class PersonState(StatefulProcessor):
    """The state of one person: the merged fields, and the places already taken in.

    Every call to the state is a message to the JVM and back, which costs more than the merging,
    so the places of most people are read and written with their fields.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.node = handle.getValueState("node", _STATE)
        self.places = handle.getMapState("places", _PLACE, _SEEN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        there = self.node.get()  # None for a new person
        now = dict.fromkeys(_STATE.names) if there is None else dict(zip(_STATE.names, there, strict=True))
        held = {tuple(p) for p in now["held"] or ()}
        changed = False
        for r in rows:
            place = (r.src, r.pos)
            if place in held:
                continue
            if len(held) < HELD:  # until then the map is empty
                held.add(place)
            elif self.places.containsKey(place):
                continue
            else:
                self.places.updateValue(place, (1,))
            changed = True
            now["mult"] = (now["mult"] or 0) + 1
            if r.gen is not None and (now["gen"] is None or r.gen < now["gen"]):
                now["gen"] = r.gen
            for c in (*FIRST, *FIRST_KNOWN):
                value = getattr(r, c)
                if c in FIRST_KNOWN and (value is None or value == ""):
                    continue
                at = (now[f"{c}_src"], now[f"{c}_pos"])
                if at[0] is None or place < at:
                    now[c], now[f"{c}_src"], now[f"{c}_pos"] = value, *place
        if changed:
            now["held"] = sorted(held)
            self.node.update(tuple(now[c] for c in _STATE.names))
            told = {c: now[c] for c in NODE.names if c in now} | {"key": key[0]}
            for c in ("region", "house"):
                told[c] = told[c] or ""
            yield Row(**{c: told[c] for c in NODE.names})

    def close(self) -> None:
        pass


def keyed_nodes(people: DataFrame) -> DataFrame:
    """A stream of people (key, src, pos, name, gen, ...) as a stream of the nodes that they change."""
    known = people.where("key IS NOT NULL AND src IS NOT NULL AND pos IS NOT NULL").select(
        "key", F.col("src").cast("string").alias("src"), F.col("pos").cast("long").alias("pos"), F.col("name").cast("string").alias("name"), F.col("gen").cast("int").alias("gen"),
        *(F.col(c).cast(_KINDS[c]).alias(c) for c in ("birth", "death", "country", "region", "house")))
    return known.groupBy("key").transformWithState(PersonState(), NODE, "Update", "None")


def maintain(spark: SparkSession, people: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Start the stream: the changed nodes of each batch replace theirs in a master of hash buckets."""
    from kinframe.streaming.buckets import BucketStore, Change

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def step(batch: DataFrame, n: int) -> None:
        newer = lambda there, new: there.join(new.select("key"), "key", "left_anti").select(new.columns).unionByName(new)
        BucketStore(spark, path, buckets).commit(n, {"nodes": Change(batch.select(NODE.names), F.col("key"), newer)})

    try:
        return keyed_nodes(people).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
