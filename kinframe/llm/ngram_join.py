"""Exact Jaccard self-join of word-shingle sets with count-vector R-trees.

1. *Shards.* One R-tree over all documents can't be held by one executor, so the
   documents are first parted into candidate groups that can't lose a link. A set is
   cut by hash range into m parts. Sets with Jaccard >= t differ in at most
   (1 - t) / t * (smaller size) shingles, each of which spoils one part, so for m above
   that figure, plus the parts that may be empty, two linked sets agree on the content
   of a whole non-empty part. m is fixed per size band (powers of two); a set also takes
   part in all bands below that hold sets small enough to be linked with it. Shingles in a ``HOT``-th of
   all documents (counted over all of them) are left out of the parts, so that common
   lines connect nothing: that keeps the guarantee for every set that still has more
   parts than can be spoiled, and the others, made of common lines, take part with
   their rarest shingles too (prefix filter). Sets that agree on a part are connected with
   the least of them, and connected sets form a group; one above ``BLOCK`` members, mostly
   a chain of sets with a few shingles in common by chance, is parted into stars, a set
   and all that agree with it on a part of which it is the least. Equal sets count once in
   a map task; a part that many sets agree on takes 16 bytes for each in one task.
2. *R-tree.* Each set is a point: its shingles hashed into groups (about one for
   eight shingles) and counted. In a group, or a pair of blocks of a large one, the
   points are packed into an R-tree; the overlap of two sets is at most the sum of their
   coordinate minima, that of two nodes at most that of their upper corners. Trees are
   gone down together: pairs of nodes, then pairs of points, below the needed overlap are
   dropped with all below them. Surviving pairs are
   verified; their connected parts are the only sets whose shingles are shipped.
3. *Verification.* Surviving pairs are verified exactly on the shingle sets. A task
   returns one edge from each member to its part, never all pairs. In both steps groups
   above ``BLOCK`` members are cut by size band and salt; blocks are first held against a
   pivot block, and only blocks whose members are still apart against each other. Texts
   that surely have no near copy are told by a map of bits and not shuffled.

Words and shingles are compared by 64-bit hashes; equal sets are one class,
identified by a 64-bit sum of hashes and the size.

Defined results: null or empty text, or text without words, gives an empty set,
linked with nothing. Rows with a null id get a null component and link with
nothing. Repeated rows and equal texts fall into one component. All other columns
of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm import _words as W
from kinframe.llm._components import components
from kinframe.llm._work import among, forget, marks, put, tidy, tidy_group

#: Coordinates at least, and shingles per coordinate at most, of a count vector.
DIMENSIONS = 32
PER_DIMENSION = 8
LEAF = 32
#: Most members of a candidate group, or of a block of one, in a task.
BLOCK = 1024
#: Keys gathered by a map task before they are combined and passed on.
FLUSH = 1_500_000
#: Shingles in this share of the documents are common; at most so many are kept.
HOT = 1_000
HOT_MOST = 500_000


class Threshold:
    """Jaccard >= num / den, in integers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.ratio = math.log(den / num * 1.0001)
        self._parts: dict[int, int] = {}

    def spoiled(self, n: int) -> int:
        """Most shingles in which a set of n and a linked, no smaller one can differ."""
        return n * (self.den - self.num) // self.num

    def prefix(self, n: int) -> int:
        """How many first shingles of a set of n meet those of any linked set."""
        return n + 1 + (-self.num * n) // self.den

    def groups(self, band: int) -> int:
        """Parts in a band: one more than can be spoiled or are likely to be empty."""
        if band not in self._parts:
            top = (2 << band) - 1
            m = spoiled = self.spoiled(top) + 1
            for _ in range(20):
                empty = m * math.exp(-top / m)
                m = spoiled + math.ceil(empty + 7 * math.sqrt(empty)) + (top > 8)
            self._parts[band] = m
        return self._parts[band]

    def needed(self, total):
        """Least overlap of two linked sets with ``total`` shingles together."""
        return -((-self.num * total) // (self.num + self.den))


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in W.chunks([len(t) for t in texts]):
        words = W.Words(texts[lo:hi], W.SPACED, True)
        every = W.grams(words.hashes, size)
        for k in range(hi - lo):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if b - a >= size:
                yield np.unique(every[a : b - size + 1])
            else:
                yield W.grams(words.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """The id of a set's class: equal for equal sets only, in signed 64 bits."""
    with np.errstate(over="ignore"):
        return int(W.mix(np.array([W.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def vector_of(s: np.ndarray) -> np.ndarray:
    """Counts of the shingles in groups; the number of groups is a power of two, so it folds."""
    dim = DIMENSIONS
    while dim * PER_DIMENSION < len(s):
        dim *= 2
    return np.bincount((s & np.uint64(dim - 1)).astype(np.int64), minlength=dim).astype(np.uint16)


def fold(v: np.ndarray, dim: int) -> np.ndarray:
    """Counts in fewer groups; wider numbers where 16 bits don't hold them."""
    if len(v) <= dim:
        return v
    out = v.reshape(-1, dim).sum(0, dtype=np.int64)
    return out.astype(np.uint16) if out.max() < 1 << 16 else out


def keys_of(s: np.ndarray, t: Threshold, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Keys of a set: its rare parts; and its rarest shingles, if too few parts are rare.

    ``rank`` has the places of the common shingles, the rarer first. Of two linked sets
    one with more rare parts than can be spoiled has an unspoiled one, which the other has
    too. Where neither has enough both give their first shingles in one order of all
    shingles, the rarest first (prefix filter).
    """
    n, out, short = len(s), [], False
    band = n.bit_length() - 1
    value = W.mix(s ^ np.uint64(0x5851F42D4C957F2D))
    place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    rare = hot[place] != s if len(hot) else np.ones(n, bool)
    lowest = max(1, -(-t.num * n // t.den)).bit_length() - 1  # the band of the smallest set that can be linked
    for at in range(band, lowest - 1, -1):
        m = t.groups(at)
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        name = (part[begin] * np.uint64(64) + np.uint64(at)) * np.uint64(0x9E3779B97F4A7C15)
        left = np.add.reduceat(rare.astype(np.int64), begin) > 0
        out.append(W.mix(np.add.reduceat(value * rare, begin)[left] + name[left]))
        short |= left.sum() <= min(t.spoiled(n), t.spoiled((2 << at) - 1))
    if short:
        common = s[~rare][np.argsort(rank[place[~rare]], kind="stable")] if len(hot) else s[:0]
        out.append(W.mix(np.r_[s[rare], common][: t.prefix(n)] ^ np.uint64(0x2545F4914F6CDD1D)))
    return np.concatenate(out)


def combine(keys: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Distinct pairs of the least member of a key and another one."""
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    if not len(keys):
        return np.empty((0, 2), np.int64)
    head = np.r_[True, keys[1:] != keys[:-1]]
    first = members[np.flatnonzero(head)][np.cumsum(head) - 1]
    other = members != first
    return _distinct(np.stack([first[other], members[other]], 1))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, axis=0) if len(pairs) else pairs.reshape(0, 2)


def _cells(docs: DataFrame, size: int, t: Threshold, hot: np.ndarray, rank: np.ndarray, parts: int) -> DataFrame:
    """Distinct pairs (a, b) of classes with a common key, a being the least class that has it."""
    import pyarrow as pa

    told = docs.sparkSession.sparkContext.broadcast((hot, rank))  # HOT_MOST shingles at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        about: dict[int, int] = {}  # by class: equal sets count once
        count = 0

        def flush() -> pa.RecordBatch:
            k, m = np.concatenate(keys), np.repeat(np.array([*about], np.int64), [*about.values()])
            pid = ((k >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(pid, kind="stable")
            cut = np.searchsorted(pid[order], np.arange(parts + 1))
            k, m = k[order], m[order]
            keys.clear(), about.clear()
            split = lambda x: pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in range(parts)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), split(k), split(m)], names=["pid", "keys", "members"])

        for batch in batches:
            for s in shingle_sets(W.as_bytes(batch.column(0)), size):
                if len(s) and (cls := class_of(s)) not in about:
                    keys.append(keys_of(s, t, *told.value))
                    about[cls] = len(keys[-1])
                    count += len(keys[-1])
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        pair = combine(whole("keys", np.uint64), whole("members", np.int64))
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    dealt = docs.select("text").mapInArrow(tidy(deal), "pid int, keys binary, members binary")
    return dealt.groupBy("pid").applyInArrow(tidy_group(meet), "a long, b long").distinct()


def _candidates(shared: DataFrame) -> DataFrame:
    """(cls, grp): groups in which all pairs with a common key meet.

    Classes connected by keys are a group. One of over ``BLOCK`` classes is mostly a chain
    of sets that share a few chance shingles each, so that all its pairs would be far more
    than those with a common key; it is parted into stars, a class with all those whose
    keys it is the least class of.
    """
    found = components(shared)
    wide = put(found.groupBy("component").agg(F.count("*").alias("many")).where(F.col("many") > BLOCK).select("component"), "wide")
    whole = found.join(wide, "component", "left_anti").select(F.col("id").alias("cls"), F.col("component").alias("grp"))
    stars = shared.join(found.join(wide, "component", "left_semi").select(F.col("id").alias("a")), "a").select("a", "b")
    return whole.union(stars.select("b", "a")).union(stars.select("a", F.col("a").alias("grp")).distinct())


class RTree:
    """Points packed into nodes, level by level: each node is halved along its widest
    coordinate until it has at most ``LEAF`` points. A node keeps the upper corner of
    its points and the least of their sizes."""

    def __init__(self, coarse: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> None:
        level = [rows]
        self.corner: list[np.ndarray] = []
        self.least: list[np.ndarray] = []
        self.first: list[np.ndarray] = []  # a node's first child in the level below; one more at the end
        while True:
            self.corner.append(np.stack([coarse[x].max(0) for x in level]))
            self.least.append(np.array([sizes[x].min() for x in level]))
            if all(len(x) <= LEAF for x in level):
                break
            below: list[np.ndarray] = []
            first = []
            for x in level:
                first.append(len(below))
                if len(x) <= LEAF:
                    below.append(x)
                    continue
                whole = np.c_[coarse[x], sizes[x]]
                axis = int(np.argmax(whole.max(0) - whole.min(0)))
                order = x[np.argsort(whole[:, axis], kind="stable")]
                below += [order[: len(order) // 2], order[len(order) // 2 :]]
            self.first.append(np.array([*first, len(below)]))
            level = below
        self.leaves = level

    def children(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first child of each node and the number of its children; below the leaves a node is its own child."""
        if depth >= len(self.first):
            return node, np.ones(len(node), np.int64)
        first = self.first[depth]
        return first[node], first[node + 1] - first[node]


def meeting_leaves(left: RTree, right: RTree, t: Threshold) -> list[tuple[int, int]]:
    """Pairs of leaves that the nodes above them don't rule out: both trees are gone down
    together, and a pair of nodes whose corners bound the overlap below what is needed is
    dropped with all below it. A tree is held against itself once per pair."""
    i = j = np.zeros(1, np.int64)
    for depth in range(max(len(left.corner), len(right.corner))):
        at, of = min(depth, len(left.corner) - 1), min(depth, len(right.corner) - 1)
        if depth:
            a, many = left.children(depth - 1, i)
            b, other = right.children(depth - 1, j)
            pairs = [(a[m] + x, b[m] + y) for x in (0, 1) for y in (0, 1) if (m := (x < many) & (y < other)).any()]
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (i[:0], j[:0])
            if left is right:
                i, j = i[i <= j], j[i <= j]
        bound = np.minimum(left.corner[at][i], right.corner[of][j]).sum(1)
        near = bound >= t.needed(left.least[at][i] + right.least[of][j])
        i, j = i[near], j[near]
    return list(zip(i.tolist(), j.tolist(), strict=True))


def survivors(vectors: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, t: Threshold) -> np.ndarray:
    """Mask of the pairs whose summed coordinate minima reach the needed overlap.

    Rows of side 0 are held against those of side 1, or all against all if there are
    none: R-trees rule out pairs of nodes first, then points are held against points.
    """
    n = len(vectors)
    coarse = np.stack([fold(v, DIMENSIONS) for v in vectors]).astype(np.int32)
    both = bool(side.any())
    sides = [np.flatnonzero(side == k) for k in range(1 + both)]
    mask = np.zeros((n, n), bool)
    if not all(len(x) for x in sides):
        return mask
    trees = [RTree(coarse, sizes, x) for x in sides]
    left, right = trees[0], trees[-1]
    folded: dict[tuple[int, int, int], np.ndarray] = {}

    def points(which: int, k: int, rows: np.ndarray, dim: int) -> np.ndarray:
        if (which, k, dim) not in folded:
            folded[which, k, dim] = np.stack([fold(vectors[i], dim) for i in rows])
        return folded[which, k, dim]

    dims = [[min(len(vectors[i]) for i in rows) for rows in tree.leaves] for tree in trees]
    for i, j in meeting_leaves(left, right, t):
        a, b = left.leaves[i], right.leaves[j]
        dim = min(dims[0][i], dims[-1][j])
        x, y = points(0, i, a, dim), points(int(both), j, b, dim)
        near = np.minimum(x[:, None, :], y[None, :, :]).sum(2, dtype=np.int32) >= t.needed(sizes[a][:, None] + sizes[b][None, :])
        mask[np.ix_(a, b)] = near
        mask[np.ix_(b, a)] = near.T
    np.fill_diagonal(mask, False)
    return mask


def parts(mask: np.ndarray) -> np.ndarray:
    """The least row of each row's connected part."""
    label = np.arange(len(mask))
    while True:
        near = np.where(mask, label[None, :], len(mask)).min(1, initial=len(mask))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(mask: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, t: Threshold) -> np.ndarray:
    """The pairs of the mask that are linked, by their exact overlaps."""
    i, j = np.nonzero(np.triu(mask))
    out = np.zeros_like(mask)
    if not len(i):
        return out
    if len(i) > 4 * len(sets):
        out = mask & (_overlaps(sets) >= t.needed(sizes[:, None] + sizes[None, :]))
        return out
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= t.needed(int(sizes[a] + sizes[b]))
    return out


def _overlaps(sets: list[np.ndarray], wide: int = 8192) -> np.ndarray:
    """All overlaps of the sets of a task, as products of blocks of a 0/1 matrix."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    # shingles of one set alone overlap with nothing
    shared = np.bincount(column) > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        block = np.zeros((len(sets), wide), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        total += block @ block.T
    return total.astype(np.int64)


def _tasks(members: DataFrame, t: Threshold, block: int) -> tuple[DataFrame, DataFrame]:
    """Members of small groups by group, and of large ones with their blocks.

    The sizes of groups are counted from (grp, n) alone; large groups are at most one
    in ``block`` rows, and that table is joined by Spark's choice.
    """
    band = F.floor(F.log("n") / F.lit(t.ratio)).cast("int")
    counts = members.groupBy("grp", band.alias("band")).agg(F.count("*").alias("many"))
    sizes = counts.groupBy("grp").agg(F.sum("many").alias("many"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("many") / block).cast("int").alias("salts")))).alias("bands"))
    big = put(sizes.where(F.col("many") > block).drop("many"), "big")
    small = members.join(big.select("grp"), "grp", "left_anti")
    large = members.withColumn("band", band).join(big, "grp")
    return small, large.withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("bands")[F.col("band")]).cast("int"))


def _pairs_of_blocks(large: DataFrame, which: str) -> DataFrame:
    """Each member once for every pair of blocks its block is in.

    ``first``: a block with itself and with the pivot block (salt 0) of its band
    and of the bands beside it. ``rest``: the pairs left out by that.
    """
    own = F.struct("band", "salt")
    none = F.array().cast("array<struct<band:int,salt:int>>")

    def blocks(d: int):
        count = F.coalesce(F.try_element_at("bands", F.col("band") + d), F.lit(0))
        made = F.transform(F.sequence(F.lit(0), count - 1), lambda s: F.struct((F.col("band") + d).cast("int").alias("band"), s.cast("int").alias("salt")))
        return F.when(count > 0, made).otherwise(none)

    out = large.withColumn("other", F.explode(F.concat(blocks(-1), blocks(0), blocks(1)))).withColumn("own", own)
    chosen = (F.col("other.salt") == 0) | (F.col("own.salt") == 0) | (F.col("other") == F.col("own"))
    out = out.where(chosen if which == "first" else ~chosen)
    return out.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).withColumn("side", F.when(F.col("own") == F.col("x"), 0).otherwise(1))


def _join(tasks: DataFrame, keys: list[str], t: Threshold, exact: bool) -> DataFrame:
    """Edges (a, b) from members to their parts, by surviving or by verified pairs."""
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("cls").to_pylist(), np.int64)
        side = np.array(group.column("side").to_pylist())
        _, order = np.unique(ids * 2 + side, return_index=True)  # a repeated row counts once
        pick = order.tolist()
        take = lambda name, kind: [np.frombuffer(x, kind) for x in group.column(name).take(pick).to_pylist()]
        ids, side = ids[order], side[order]
        sizes = np.array(group.column("n").to_pylist(), np.int64)[order]
        mask = survivors(take("vec", np.uint16), sizes, side, t)
        if exact:
            mask = verified(mask, take("shingles", np.uint64), sizes, t)
        root = parts(mask)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(ids[root[moved]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})

    columns = [*keys, "cls", "n", "vec", "side"] + ["shingles"] * exact
    return tasks.select(columns).groupBy(*keys).applyInArrow(tidy_group(run), "a long, b long")


def _classes(docs: DataFrame, size: int, t: Threshold) -> DataFrame:
    """doc_id, text_md5, cls, n, vec of every row (cls is null for empty sets), and
    rows with the common shingles of each stretch of rows (shingle, n)."""
    import pyarrow as pa

    names = ["doc_id", "text_md5", "cls", "n", "vec", "shingle"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[np.ndarray] = []
        count = 0

        def often() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(first), return_counts=True)
            # what is in a HOT-th of all documents is so in one stretch at least
            keep = times >= max(2, len(first) // HOT)
            value, times = value[keep].view(np.int64), times[keep]
            if len(value) > HOT_MOST:
                pick = np.argsort(-times, kind="stable")[:HOT_MOST]
                value, times = value[pick], times[pick]
            first.clear()
            none = [None] * len(value)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([none, none, none, times, none, value], kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for s in shingle_sets(W.as_bytes(batch.column(2)), size):
                rows.append((class_of(s), len(s), vector_of(s).tobytes()) if len(s) else (None, 0, None))
                if len(s):
                    first.append(s)
                    count += len(s)
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(list(c), k) for c, k in zip(columns, kinds[2:5], strict=True)), pa.nulls(len(rows), pa.int64())], names=names)
            if count >= 3 * FLUSH:
                yield often()
                count = 0
        if count:
            yield often()

    return docs.select("doc_id", F.md5("text").alias("text_md5"), "text").mapInArrow(tidy(run), "doc_id long, text_md5 string, cls long, n long, vec binary, shingle long")


def _members(docs: DataFrame, size: int) -> DataFrame:
    """grp, cls, n, vec and shingles of the documents that stand for their classes."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingle_sets(W.as_bytes(batch.column(0)), size), strict=True)
            for cls, grp, s in rows:
                if len(s) and class_of(s) == cls:  # ids may repeat with other texts
                    kept.append((grp, cls, len(s), vector_of(s).tobytes(), s.tobytes()))
            columns = list(zip(*kept, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["grp", "cls", "n", "vec", "shingles"])

    return docs.select("text", "cls", "grp").mapInArrow(tidy(run), "grp long, cls long, n long, vec binary, shingles binary")


def ngram_jaccard(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and text_md5 of every row.

    Links join documents whose sets of ``size``-word shingles have a Jaccard
    similarity of at least ``num / den``, found exactly.
    """
    spark = docs.sparkSession
    t = Threshold(num, den)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = docs.where("doc_id IS NOT NULL")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = put(_classes(docs, size, t), "classes")
    every = told.where("shingle IS NULL")
    least = max(16, every.count() // HOT)
    often = told.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    hot = np.array([r["shingle"] for r in often.orderBy(F.desc("n"), "shingle").limit(HOT_MOST).select("shingle").collect()], np.int64)
    hot, rank = np.unique(hot[::-1].view(np.uint64), return_index=True)

    # candidate groups, then the parts of them that the count vectors can't rule out
    groups = _candidates(put(_cells(named, size, t, hot, rank, spread), "cells"))
    classes = every.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("vec").alias("vec"))
    first = put(classes.select("cls", "doc_id"), "first")
    points = put(classes.select("cls", "n", "vec").join(groups, "cls"), "points")
    groups = _linked(points, t, False).withColumnRenamed("component", "grp")
    forget(points)

    chosen = put(groups.join(first, "cls"), "chosen")
    near = among(named, "doc_id", put(marks(chosen, "doc_id"), "marks"))
    # merged at any size: what is chosen follows the input, and so should the plan
    members = put(_members(near.join(chosen.hint("merge"), "doc_id"), size), "members")
    linked = _linked(members, t, True)
    forget(members)
    tied = put(first.join(linked, "cls"), "tied")
    lowest = put(tied.groupBy("component").agg(F.min("doc_id").alias("lowest")), "lowest")
    of_class = tied.join(lowest, "component").select("cls", F.col("lowest").alias("component_id"))
    alone = first.join(linked, "cls", "left_anti").select("cls", F.col("doc_id").alias("component_id"))
    of_class = put(of_class.union(alone), "of_class")
    return every.join(of_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "text_md5"
    )


def _linked(members: DataFrame, t: Threshold, exact: bool) -> DataFrame:
    """(cls, component) of the classes joined by surviving, or by verified, pairs of their group.

    In a large group each block meets itself and the pivot blocks first; of the other
    pairs of blocks only those whose members aren't all in one part yet are dealt out,
    so a group of near copies takes a number of tasks in step with its size.
    """
    small, large = _tasks(members, t, BLOCK)
    found = put(_join(small.withColumn("side", F.lit(0)), ["grp"], t, exact).union(_join(_pairs_of_blocks(large, "first"), ["grp", "x", "y"], t, exact)), "links")
    linked = components(found).withColumnRenamed("id", "cls")
    left = large.join(linked, "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
    pairs = put(_uneven(left), "pairs")
    if not pairs.isEmpty():
        block = lambda x, side: pairs.select("grp", f"{x}.band", f"{x}.salt", "x", "y", F.lit(side).alias("side"))
        dealt = large.join(block("x", 0).union(block("y", 1)), ["grp", "band", "salt"])
        found = put(found.union(_join(dealt, ["grp", "x", "y"], t, exact)), "links")
        linked = components(found).withColumnRenamed("id", "cls")
    return linked


def _uneven(left: DataFrame) -> DataFrame:
    """(grp, x, y): the pairs of blocks left out at first whose members aren't all in one part yet."""
    blocks = left.groupBy("grp", "band", "salt").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("bands").alias("bands"))
    pairs = _pairs_of_blocks(blocks, "rest").groupBy("grp", "x", "y")
    return pairs.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("grp", "x", "y")
