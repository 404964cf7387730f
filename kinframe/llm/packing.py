"""Packing of token sequences into as few sequences of a fixed length as local search finds.

Documents are encoded, ended by an id, and cut only where they are longer than a sequence: into
whole sequences, the first piece being the shorter one. The pieces are dealt at random into
groups of bounded size. In each group a best-fit packing of the pieces by falling length is
improved by swap-based local search: from the emptiest bins pieces are moved, exchanged one for
one, or two for one (either way) with fuller bins, always so that the sum of the squared fills
grows, until bins are empty and go; all pieces and pairs of the two bins are tried. The bins that are not full are then dealt into new groups,
so that room that is left over in one group meets that of others, until a round empties hardly
any bin; within a round every group is a task of its own, whatever the number of documents.

Pieces are rows of a few numbers; the ids stay in the table that the encoding wrote, and
``packed_ids`` puts the sequences together from it.

Defined results: a null text is empty and has just the end id; rows that are equal, or that
have a null doc_id, are packed each on its own; other columns are ignored, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinframe.llm import _words as W
from kinframe.llm._work import put, tidy
from kinframe.llm.token_store import _library

#: Pieces of a group, on average.
GROUP = 4096
#: The search ends when so many of the emptiest bins have no step; each is tried with all its pieces and pairs against all bins.
DONORS = 6
#: A further round is made if the last one emptied one in so many bins.
WORTH = 2000


def write_pieces(docs: DataFrame, vocabulary_path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """place (a number of its own), doc_id, piece, start, length, ids_crc32 (and ``ids``) of every piece, as a table."""
    import pyarrow as pa
    from pyspark import TaskContext

    end = np.array([end_id], "<u4")
    names = ["place", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = _library(vocabulary_path)
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for name, got in zip(batch.column(0).to_pylist(), coder.encode(W.as_bytes(batch.column(1))), strict=True):
                ids = np.concatenate([got.astype("<u4"), end])
                cuts = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
                for piece, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    raw = ids[lo:hi].tobytes()
                    rows.append((place, name, piece, lo, hi - lo, zlib.crc32(raw), *[raw] * keep_ids))
                    place += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return put(own.mapInArrow(tidy(run), "place long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids), "pieces")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: by falling length, into the fullest bin with room."""
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = made = 0  # there: bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = there >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                there &= ~(1 << r)
        else:
            r, b = capacity, made
            made += 1
        bins[i] = b
        room[r - n].append(b)
        there |= 1 << (r - n)
    return bins


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int, donors: int = DONORS) -> np.ndarray:
    """Bins after local search. Every step raises the sum of squared fills, so it ends.

    A step takes net tokens from one of the emptiest bins to another bin with room: a move,
    an exchange of one piece for a smaller one, of two for one, or of one for two.
    """
    bins = bins.copy()
    fill = np.bincount(bins, lengths, int(bins.max()) + 1).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    stuck: set[int] = set()
    while True:
        left = capacity - fill
        live = np.flatnonzero(fill)
        if not len(live):
            return bins
        order = live[np.argsort(fill[live], kind="stable")]
        # no bin can be emptied if all other room can't hold the emptiest one
        if int(left[live].sum()) - int(left[order[0]]) < int(fill[order[0]]):
            return bins
        donor = next((b for b in order[:donors].tolist() if b not in stuck), None)
        if donor is None:
            return bins
        best = _step(lengths, bins, fill, left, donor)
        if best is None:
            stuck.add(donor)
            continue
        out, back, to = best
        bins[out], bins[back] = to, donor
        net = int(lengths[out].sum() - lengths[back].sum())
        fill[donor] -= net
        fill[to] += net
        stuck.clear()


def _pairs(where: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All pairs of neighbours in ``where`` (sorted, as are the sizes in it), as rows of two places; a size counts twice at most."""
    kept = np.flatnonzero(np.r_[[True] * min(2, len(size)), (where[2:] != where[:-2]) | (size[2:] != size[:-2])])
    own, found = where[kept], []
    for lag in range(1, len(kept)):
        same = np.flatnonzero(own[lag:] == own[:-lag])
        if not len(same):
            break
        found.append(np.stack([kept[same], kept[same + lag]], 1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _sizes(parts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different sums of the rows of pieces, rising, and a row for each."""
    size, first = np.unique(lengths[parts].sum(1), return_index=True)
    return size, parts[first]


def _step(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, left: np.ndarray, donor: int):
    """(pieces out, pieces back, bin) of the step to a bin with room that adds most to the squared fills, or None.

    All pieces and all pairs count. For what comes back from a bin the largest net that has room
    there gains most, so the sizes that the donor can give are searched, not tried one by one.
    """
    target = (fill > 0) & (left > 0)
    target[donor] = False
    to = np.flatnonzero(target)
    if not len(to):
        return None
    own = np.flatnonzero(bins == donor)
    own = own[np.argsort(lengths[own], kind="stable")]
    one, two = (_sizes(parts, lengths) for parts in (own[:, None], own[_pairs(np.zeros(len(own), np.int64), lengths[own])]))
    # other bins' pieces that may come back, by bin and length
    other = np.flatnonzero(target[bins])
    other = other[np.lexsort((lengths[other], bins[other]))]
    top, choice = 0, None

    def weigh(given: tuple[np.ndarray, np.ndarray], back: np.ndarray, to: np.ndarray):
        nonlocal top, choice
        size, parts = given
        if not len(size) or not len(to):
            return
        back_size = lengths[back].sum(1)
        at = np.searchsorted(size, back_size + left[to], "right") - 1
        net = size[at] - back_size
        # 2 net (fill(to) - fill(donor) + net) is what the squares gain
        gain = np.where((at >= 0) & (net > 0), net * (fill[to] - fill[donor] + net), 0)
        k = int(gain.argmax())
        if gain[k] > top:
            top, choice = int(gain[k]), (parts[at[k]].tolist(), back[k].tolist(), int(to[k]))

    weigh(one, np.empty((len(to), 0), np.int64), to)
    weigh(one, other[:, None], bins[other])
    weigh(two, other[:, None], bins[other])
    both = other[_pairs(bins[other], lengths[other])]
    weigh(one, both, bins[both[:, 0]])
    return choice


def _packed(capacity: int, search_only: bool):
    """For one group: pieces with the sequence, the offset there, and its fill."""
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lengths, place = (group.column(c).to_numpy() for c in ("length", "place"))
        if search_only:
            before = group.column("sequence_id").to_numpy()
            _, bins = np.unique(before, return_inverse=True)
        else:
            bins = best_fit(lengths, capacity)
        bins = improve(lengths, bins, capacity)
        order = np.lexsort((place, bins))
        sizes, own = lengths[order], bins[order]
        end = np.cumsum(sizes)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        member = np.cumsum(np.r_[True, own[1:] != own[:-1]]) - 1
        offset = end - sizes - (end - sizes)[first][member]
        fill = np.add.reduceat(sizes, first)[member]
        out = group.select(["place", "doc_id", "piece", "start", "length", "ids_crc32"]).take(pa.array(order))
        # a sequence is called by the least place in it
        for name, x in (("sequence_id", place[order][first][member]), ("offset", offset), ("fill", fill)):
            out = out.append_column(name, pa.array(x.astype(np.int64)))
        return out

    return run


def pack(pieces: DataFrame, length: int = 2048, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and place, fill) of every piece."""
    schema = "place long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
    own = pieces.select("place", "doc_id", "piece", "start", "length", "ids_crc32")
    whole = own.where(F.col("length") == length).select("*", F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill"))
    done, todo, key, search_only = [whole], own.where(F.col("length") < length), "place", False
    many, bins = todo.count(), None
    while many:
        groups = -(-many // group)
        # a new deal in every round, by the numbers of the pieces or of the bins
        dealt = todo.withColumn("deal", F.pmod(F.xxhash64(key, F.lit(len(done))), F.lit(groups)))
        if search_only:
            dealt = dealt.drop("offset", "fill")
        seen = Observation()
        first = (F.col("offset") == 0)
        packed = dealt.groupBy("deal").applyInArrow(_packed(length, search_only), schema)
        found = put(packed.observe(seen, F.count_if(first).alias("bins"), F.count_if(F.col("fill") < length).alias("open"), F.count_if(first & (F.col("fill") < length)).alias("open_bins")), "packed")
        got = seen.get
        emptied = (got["bins"] * WORTH if bins is None else bins - got["bins"])
        if groups == 1 or emptied * WORTH < got["bins"]:
            done.append(found)
            break
        done.append(found.where(F.col("fill") == length))
        todo, key, search_only, many, bins = found.where(F.col("fill") < length), "sequence_id", True, got["open"], got["open_bins"]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed_ids(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of every sequence, little-endian, in order of the offsets; a sequence has a bounded size."""
    both = pieces.select("place", "ids").join(packed.select("place", "sequence_id", "offset"), "place")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda made, x: F.concat(made, x["ids"]))
    return both.groupBy("sequence_id").agg(joined.alias("ids"))


def best_fit_packing(docs: DataFrame, vocabulary_path: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    packed = pack(write_pieces(docs, vocabulary_path, length, end_id), length)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
