"""Near-duplicate embeddings by random-hyperplane sign hashing in several tables.

Each vector gets ``bits`` signs in each of ``tables`` tables; vectors of one label
that agree on all signs of a table share a bucket. Two vectors at the threshold
cosine agree on a sign with probability p = 1 - arccos(c) / pi. The number of bits grows
with the number of distinct vectors (``BITS`` at least, one more for each doubling above
2 ** ``BITS``), so buckets of unlike vectors don't grow with the table, and the number of tables
with the bits, so that a pair at the threshold is missed in all of them with probability
(1 - p ** bits) ** tables of at most ``MISSED``, a closer one less: 16 tables of 16 bits at 0.98. Every pair in a bucket is verified by its exact double-precision cosine, in
blocks of a matrix product, and counts in the first table in which it meets only.

Equal vectors are one weighted class from the start, so copies may hold any share of
the rows. Buckets with one class are dropped before vectors are shipped; a bucket of
more than ``BLOCK`` classes is dealt out as pairs of blocks. A block task returns,
per member, its number of links and one edge to its part of the block, never pairs.
Connected components of those edges are found by distributed contraction.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts,
and rows with a null label or id, link with nothing; vectors of different lengths
never link; equal rows (also with equal ids) link with each other; other columns are
ignored. A row with a null id has a null component and isn't kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm._components import components
from kinframe.llm._work import put, tidy, tidy_group

#: Signs per table at least and at most, and the odds at which a pair at the threshold is missed.
BITS, MOST_BITS = 16, 31
MISSED = 0.0012
BLOCK = 1024


def plan(classes: int, threshold: float) -> tuple[int, int]:
    """Bits and tables for so many distinct vectors."""
    bits = min(MOST_BITS, max(BITS, (max(1, classes) - 1).bit_length()))
    met = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if met >= 1 else max(1, math.ceil(math.log(MISSED) / math.log1p(-met)))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """The hyperplanes' normals for vectors of a length; the same in every task."""
    return np.random.Generator(np.random.PCG64(dim * 1_000_003 + bits * 101 + tables)).standard_normal((dim, bits * tables))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The sign pattern of each row in each table."""
    signs = (x @ planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps huge and tiny vectors from over- and underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def verify(left: tuple, right: tuple, table: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link mask between two blocks, and per row the summed weights of new links.

    A block: unit vectors, signatures, weights. Links whose pair already met in an
    earlier table are in the mask but not in the sums.
    """
    (x, sx, wx), (y, sy, wy) = left, right
    mask = x @ y.T >= threshold
    if same:
        np.fill_diagonal(mask, False)
    new = mask.copy()
    for t in range(table):
        new &= sx[:, t][:, None] != sy[:, t][None, :]
    return mask, new @ wy, wx @ new


def _parts(mask: np.ndarray) -> np.ndarray:
    """The least row of each row's connected part, by repeated minima and jumps."""
    label = np.arange(len(mask))
    while True:
        near = np.where(mask, label[None, :], len(mask)).min(1, initial=len(mask))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, bits: int | None = None, tables: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    import pyarrow as pa

    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    own = own.withColumn("h", F.when(usable, F.xxhash64("v"))).withColumn("g", F.when(usable, F.xxhash64(F.lit(7), "v", F.size("v"))))
    classes = put(own.where("h IS NOT NULL").groupBy("label", "h", "g").agg(F.min("vec_id").alias("cid"), F.count("*").alias("w")), "classes")
    if bits is None or tables is None:
        bits, tables = plan(classes.count(), threshold)
    # one row of each class; equal rows of the least id are told apart by nothing, any will do
    firsts = own.join(classes.withColumnRenamed("cid", "vec_id"), ["label", "h", "g", "vec_id"]).dropDuplicates(["label", "vec_id", "h", "g"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            unit, codes = [b""] * len(rows), [b""] * len(rows)
            for dim in {len(r) for r in rows}:
                pick = [i for i, r in enumerate(rows) if len(r) == dim]
                x = _unit([rows[i] for i in pick])
                for i, u, s in zip(pick, x, signatures(x, bits, tables), strict=True):
                    unit[i], codes[i] = u.tobytes(), s.astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, pa.binary()), pa.array(codes, pa.binary()), batch.column(3)], names=["cls", "cid", "unit", "codes", "w"])

    # a class is named by a hash of label and content, as ids may repeat
    named = firsts.select(F.xxhash64("label", "h", "g").alias("cls"), F.col("vec_id").alias("cid"), "v", "w", "label")
    labels = named.select("cls", "label")
    signed = put(named.select("cls", "cid", "v", "w").mapInArrow(tidy(sign), "cls long, cid long, unit binary, codes binary, w long"), "signed")
    labels = put(labels.withColumn("label", F.xxhash64("label")), "labels")
    four = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("t"), F.substring("codes", t * 4 + 1, F.lit(4)).alias("code")))
    dealt = signed.join(labels, "cls").select("cls", "label", F.octet_length("unit").alias("dim"), F.explode(four).alias("s"))
    dealt = put(dealt.select("cls", F.col("s.t").alias("t"), F.xxhash64("label", "dim", "s.t", "s.code").alias("bucket")), "buckets")
    shared = put(dealt.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int")), "shared")
    members = dealt.join(shared, "bucket").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("cls", "t", "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def link(group: pa.Table) -> pa.Table:
        side = np.array(group.column("side").to_pylist())
        ids = np.array(group.column("cls").to_pylist(), np.int64)
        order = np.lexsort((ids, side))
        side, ids = side[order], ids[order]
        x = np.stack([np.frombuffer(b, np.float64) for b in group.column("unit").to_pylist()])[order]
        s = np.stack([np.frombuffer(b, np.int32) for b in group.column("codes").to_pylist()])[order]
        w = np.array(group.column("w").to_pylist(), np.int64)[order]
        t = group.column("t")[0].as_py()
        n, split = len(ids), int((side == 0).sum())
        if group.column("x")[0].as_py() == group.column("y")[0].as_py():
            mask, links, _ = verify((x, s, w), (x, s, w), t, threshold, True)
        else:
            a, b = slice(0, split), slice(split, n)
            part, left, right = verify((x[a], s[a], w[a]), (x[b], s[b], w[b]), t, threshold, False)
            links = np.concatenate([left, right])
            mask = np.zeros((n, n), bool)
            mask[a, b], mask[b, a] = part, part.T
        root = _parts(mask)
        keep = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pa.table({"cls": ids[keep], "root": ids[root[keep]], "links": links[keep].astype(np.int64)})

    found = put(members.join(signed, "cls").groupBy("bucket", "x", "y").applyInArrow(tidy_group(link), "cls long, root long, links long"), "links")
    of_class = found.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = components(found, "cls", "root").withColumnRenamed("id", "cls")
    lowest = put(signed.select("cls", "cid").join(linked, "cls").groupBy("component").agg(F.min("cid").alias("lowest")), "lowest")
    told = signed.select("cls", "cid", "w").join(of_class, "cls", "left").join(linked, "cls", "left").join(lowest, "component", "left")
    told = put(told.select("cls", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("lowest", "cid").alias("component_id")), "told")
    out = own.select("vec_id", F.when(F.col("h").isNotNull(), F.xxhash64("label", "h", "g")).alias("cls")).join(told, "cls", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
