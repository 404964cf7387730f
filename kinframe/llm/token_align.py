"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide pair counts.

The tokens of both are the two sides of a bipartite graph whose edges join tokens that share
bytes; union-find over these edges gives its connected components, which are the smallest
groups of tokens that cover the same bytes. The members of a component expand the links:
the pairs of it whose byte ranges end together, or all its overlapping pairs.

Both vocabularies are kept from joining across the start of a run of white space after a
word, so texts are cut there into units. Distinct units are tokenized and aligned once while
a bounded cache holds them, all new units of a chunk in one union-find over arrays, and a
text's result is put together from its units. Texts for which that may not hold (white space
outside ASCII, or white space that the second vocabulary has inside pieces) are one unit each.

Pairs are counted in two steps. Each task cuts its documents into blocks of bounded bytes and
writes, per block, its distinct pairs with their numbers, and per document the places of its
pairs in that list; so the pairs that are shuffled are those that differ within a block, and a
pair that is frequent everywhere is one row per block. The sums come back to each block's list,
and each block's documents meet that list alone. The highest count of each id of the second
vocabulary, at most one row per id of it, is broadcast.

Defined results: null and empty texts, and texts whose tokens don't give the text back with a
space before it, have no tokens: zeros and ''. Repeated rows are each counted; rows with a null
doc_id are rows like any other; other columns are ignored, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm import _words as W
from kinframe.llm._units import _HINTS, _WIDE, Pool, UnitCoder
from kinframe.llm._work import put, tidy, tidy_group

#: Bytes of text after which a block ends.
BLOCK_BYTES = 16 << 20
CHUNK = 1 << 20
_SPACE = "▁"
_SIDE = np.uint64(32)


class Aligned(NamedTuple):
    """``documents``: one row each; ``pairs``: (a, b, n, best) of all linked id pairs."""

    documents: DataFrame
    pairs: DataFrame


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n members' components, for edges a-b.

    Rounds over whole arrays: the larger of two roots is hooked onto the smaller one, then
    all paths are compressed by pointer jumping, until no edge joins two roots.
    """
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            nearer = root[root]
            if np.array_equal(nearer, root):
                break
            root = nearer
    return root


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of tokens that share bytes, of two cuts of the same bytes."""
    stretch = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, stretch), np.searchsorted(b_ends, stretch)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Sides:
    """Both tokenizers: ids and bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        added = {i: str(t.content) for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [added[i].encode() if i in added else bytes(alphabet[c] for c in self.a.id_to_token(i) or "") for i in range(size)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # units may be cut out only if no piece goes on past a word into white space, and spaces stay as they are
        joins = any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.cuts = not joins and self.b.normalize(" a  b ") == f"{_SPACE * 2}a{_SPACE * 2}b{_SPACE}"
        self.odd = [c.encode() for c in "\t\n\x0b\x0c\r" if any(c in p and len(p) > 1 for p in pieces)]

    def b_ids(self, text: str) -> np.ndarray:
        """Ids of a text that begins with a space; the model adds it itself."""
        return np.array(self.b.encode(text[1:], num_threads=1), np.int64)


def _matches(ids: np.ndarray, known: list[bytes], raw: bytes) -> bool:
    return b"".join([known[i] for i in ids.tolist()]) == raw


def _split(ids: np.ndarray, size: np.ndarray, ends: np.ndarray) -> list[np.ndarray] | None:
    """The ids between the given ends of bytes, if tokens end at all of them."""
    at = np.cumsum(size[ids])
    cut = np.searchsorted(at, ends, "right")
    if not len(at) or at[-1] != ends[-1] or not (at[cut - 1] == ends).all():
        return None
    return [ids[lo:hi] for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


class Aligner(UnitCoder):
    """Aligned units of texts: numbers of tokens, groups and links, the groups as text, and link keys."""

    def __init__(self, sides: Sides, links: str = "ends") -> None:
        self.sides, self.links = sides, links
        super().__init__(self._encode_units, [])

    def _fresh(self) -> None:
        super()._fresh()
        self.nums, self.keys, self.groups = Pool(np.int64), Pool(np.uint64), Pool(np.uint8)

    def _encode_units(self, units: list[str]) -> list[np.ndarray]:
        nums, keys, groups = self._aligned(units)
        self.nums.add(nums)
        self.keys.add(keys)
        self.groups.add(groups)
        return [np.empty(0, np.uint32)] * len(units)  # the ids themselves are in the groups

    def _tokens(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each unit by both; empty where they don't give its bytes back."""
        sides = self.sides
        raw = [u.encode() for u in units]
        a = b = None
        if len(units) > 1:
            # units don't join, so many go through one call of each library
            whole, ends = " x" + "".join(units), np.cumsum([2, *map(len, raw)])
            a = _split(np.array(sides.a.encode(whole, add_special_tokens=False).ids, np.int64), sides.a_size, ends)
            b = _split(sides.b_ids(whole), sides.b_size, ends)
        if a is None:
            a = [np.array(e.ids, np.int64) for e in sides.a.encode_batch(units, add_special_tokens=False)]
        if b is None:
            b = [self._alone(u) for u in units]
        for i, text in enumerate(raw):
            if not (_matches(a[i], sides.a_bytes, text) and _matches(b[i], sides.b_bytes, text)):
                a[i] = b[i] = np.empty(0, np.int64)
        return a, b

    def _alone(self, unit: str) -> np.ndarray:
        """Ids of a unit by the second vocabulary, without the space that the model puts before it."""
        if len(unit) > 1 and unit.startswith(" "):  # a space alone would be an empty text
            return self.sides.b_ids(unit)
        ids = self.sides.b_ids(" x" + unit)
        at = np.cumsum(self.sides.b_size[ids])
        first = int(np.searchsorted(at, 2, "right"))
        return ids[first:] if first and at[first - 1] == 2 else np.empty(0, np.int64)

    def _aligned(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Per unit: (tokens by a, by b, groups, links; -1s where the bytes differ), link keys, and groups as text."""
        a, b = self._tokens(units)
        a_ids, b_ids = np.concatenate(a), np.concatenate(b)
        a_ends, b_ends = np.cumsum(self.sides.a_size[a_ids]), np.cumsum(self.sides.b_size[b_ids])
        over_a, over_b = overlaps(a_ends, b_ends)
        n = len(a_ids)
        root = union_find(n + len(b_ids), over_a, n + over_b)
        _, group = np.unique(root, return_inverse=True)  # in the order of their first tokens
        a_group, b_group = group[:n], group[n:]
        if self.links == "ends":
            # tokens of a component that end together: its bytes end where both sides' last tokens do
            link_a, link_b = (np.flatnonzero(np.r_[x[1:] != x[:-1], True]) if len(x) else np.empty(0, np.int64) for x in (a_group, b_group))
        else:
            link_a, link_b = over_a, over_b
        keys = (a_ids[link_a].astype(np.uint64) << _SIDE) | b_ids[link_b].astype(np.uint64)
        a_cut, b_cut = (np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in (a, b))
        group_cut = np.searchsorted(a_group, np.arange(int(a_group[-1]) + 2 if n else 1)) if n else np.zeros(1, np.int64)
        link_cut = np.searchsorted(link_a, a_cut)
        told_a, told_b = (list(map(str, x.tolist())) for x in (a_ids, b_ids))
        b_group_cut = np.searchsorted(b_group, np.arange(len(group_cut)))
        told = [",".join(told_a[i:j]) + "|" + ",".join(told_b[k:m]) + ";" for i, j, k, m in zip(group_cut[:-1].tolist(), group_cut[1:].tolist(), b_group_cut[:-1].tolist(), b_group_cut[1:].tolist(), strict=True)]
        unit_group = np.searchsorted(group_cut, a_cut)
        nums, out_keys, out_told = [], [], []
        for i in range(len(units)):
            lo, hi = int(unit_group[i]), int(unit_group[i + 1])
            x, y = int(link_cut[i]), int(link_cut[i + 1])
            nums.append(np.array([len(a[i]), len(b[i]), hi - lo, y - x] if len(a[i]) else [-1, -1, -1, -1]))
            out_keys.append(keys[x:y])
            out_told.append(np.frombuffer("".join(told[lo:hi]).encode(), np.uint8))
        return nums, out_keys, out_told

    def align(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
        """(numbers, link keys, groups) of each text, in order; numbers are 0 where there are no tokens."""
        nothing = (np.zeros(4, np.int64), np.empty(0, np.uint64), b"")
        for lo, hi in W.chunks([len(t) for t in texts], CHUNK):
            some = [i for i in range(lo, hi) if texts[i]]
            odd = {i for i in some if self._whole(texts[i])}
            plain = [i for i in some if i not in odd]
            found = dict(zip(plain, self._chunked([b" " + texts[i] for i in plain]), strict=True)) if plain else {}
            for i in range(lo, hi):
                got = self._one(b" " + texts[i]) if i in odd else found.get(i, nothing)
                yield nothing if got[0][0] <= 0 else got

    def _whole(self, t: bytes) -> bool:
        if not self.sides.cuts or any(c in t for c in self.sides.odd):
            return True
        return not t.isascii() and any(h in t for h in _HINTS) and _WIDE.search(t.decode()) is not None

    def _one(self, text: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
        nums, keys, groups = self._aligned([text.decode()])
        return nums[0], keys[0], groups[0].tobytes()[:-1]

    def _chunked(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        word = W.SPACED[buf]
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=first[1:])
        begins = np.zeros(len(buf), bool)
        begins[1:] = word[:-1] & ~word[1:]
        begins[first[:-1]] = True
        at = np.flatnonzero(begins)
        end = np.r_[at[1:], len(buf)]
        entry = self._find(W.byte_spans(buf, at, end), buf, at, end)
        again, _ = self.raw.take(entry)
        if len(again) != len(buf) or not np.array_equal(again, buf):  # a collision of hashes
            return [self._one(t) for t in texts]
        cut = np.searchsorted(at, first)
        nums = self.nums.take(entry)[0].reshape(-1, 4)
        bad = np.logical_or.reduceat(nums[:, 0] < 0, cut[:-1])
        total = np.add.reduceat(nums, cut[:-1], axis=0)
        total[bad] = 0
        keys, n_keys = self.keys.take(entry)
        told, n_told = self.groups.take(entry)
        key_cut, told_cut = (np.concatenate([[0], np.cumsum(n)])[cut].tolist() for n in (n_keys, n_told))
        raw = told.tobytes()
        return [(total[i], keys[key_cut[i] : key_cut[i + 1]], raw[told_cut[i] : told_cut[i + 1] - 1]) for i in range(len(texts))]


@lru_cache(2)
def _aligner(byte_path: str, piece_path: str, links: str) -> Aligner:
    return Aligner(Sides(byte_path, piece_path), links)


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", links: str = "ends", keep_groups: bool = False, block_bytes: int = BLOCK_BYTES) -> Aligned:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and ``groups``) per document.

    ``links``: ``ends`` links the tokens of a group that end together, ``overlap`` all that
    share bytes. ``n_best`` counts links whose pair has its b id's highest count over all
    documents, ``count_sum`` adds the counts of all links' pairs.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    if links not in ("ends", "overlap"):
        raise ValueError("links is 'ends' or 'overlap'")
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    told = ["groups_sha256"] + ["groups"] * keep_groups
    schema = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + ", groups string" * keep_groups + ", places array<int>, times array<int>, keys array<long>, ns array<long>"
    many, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [pa.int64()] * 6 + [pa.string()] * len(told) + [many, many, longs, longs]
    names = ["block", "doc_id", *numbers, *told, "places", "times", "keys", "ns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path, links)
        block, held, rows, keys = TaskContext.get().partitionId() << 32, 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            """The block's documents, with the places of their pairs among its distinct ones, then those."""
            nonlocal block, held
            size = np.array([len(k) for k in keys], np.int64)
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            ns = np.bincount(place, minlength=len(distinct))
            own, times = np.unique(np.repeat(np.arange(len(keys)), size) * max(1, len(distinct)) + place, return_counts=True)
            doc, place = np.divmod(own, max(1, len(distinct)))
            cut = np.searchsorted(doc, np.arange(len(keys) + 1)).astype(np.int32)
            columns = [pa.array([block] * len(rows), pa.int64()), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds[1:-4], strict=True))]
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (place, times)]
            empty = [pa.nulls(len(rows), longs)] * 2
            whole = pa.RecordBatch.from_arrays(columns + lists + empty, names=names)
            for lo in range(0, len(rows), 512):
                yield whole.slice(lo, 512)
            if len(distinct):
                alone = [pa.nulls(1, k) for k in kinds[1:-2]]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *alone, pa.array([distinct.astype(np.int64)], longs), pa.array([ns], longs)], names=names)
            block, held = block + 1, 0
            rows.clear(), keys.clear()

        for batch in batches:
            texts = W.as_bytes(batch.column(1))
            for doc_id, text, (nums, key, groups) in zip(batch.column(0).to_pylist(), texts, aligner.align(texts), strict=True):
                rows.append((doc_id, *nums.tolist(), hashlib.sha256(groups).hexdigest() if groups else "", *[groups.decode()] * keep_groups))
                keys.append(key)
                held += len(text)
            if held >= block_bytes:
                yield from flush()
        if rows:
            yield from flush()

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    made = put(own.mapInArrow(tidy(run), schema), "aligned")
    lists = made.where("keys IS NOT NULL").select("block", F.posexplode(F.arrays_zip("keys", "ns")).alias("place", "x")).select("block", "place", F.col("x.keys").alias("key"), F.col("x.ns").alias("n"))
    counts = lists.groupBy("key").agg(F.sum("n").alias("n"))
    b_id = F.col("key").bitwiseAND(0xFFFFFFFF)
    counts = put(counts, "pairs")
    best = F.broadcast(counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most")))  # at most one row per id of the vocabulary
    pairs = counts.join(best, b_id == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    summed = lists.select("block", "place", "key").join(pairs, "key").select(F.col("block").alias("list_block"), "place", "n", "best")

    def meet(docs_part: pa.Table, list_part: pa.Table) -> pa.Table:
        place = list_part.column("place").to_numpy()
        n, best_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best_of[place] = list_part.column("n").to_numpy(), list_part.column("best").to_numpy()
        docs_part = docs_part.combine_chunks()
        sums = []
        for values in (best_of, n):
            parts = []
            for chunk in zip(docs_part.column("places").chunks, docs_part.column("times").chunks, strict=True):
                at, times = (c.flatten().to_numpy() for c in chunk)
                running = np.concatenate([[0], np.cumsum(values[at] * times)])
                cut = chunk[0].offsets.to_numpy() - chunk[0].offsets[0].as_py()
                parts.append(running[cut[1:]] - running[cut[:-1]])
            sums.append(pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))
        return pa.table([docs_part.column("doc_id"), *(docs_part.column(c) for c in numbers), *sums, *(docs_part.column(c) for c in told)], names=["doc_id", *numbers, "n_best", "count_sum", *told])

    result = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * keep_groups
    texts = made.where("keys IS NULL").drop("keys", "ns")
    documents = texts.groupBy("block").cogroup(summed.groupBy("list_block")).applyInArrow(tidy_group_pair(meet), result)
    told_pairs = pairs.select(F.shiftright("key", 32).alias("a"), b_id.alias("b"), "n", "best")
    return Aligned(documents, told_pairs)


def tidy_group_pair(run):
    """``tidy_group`` for a pair of groups."""

    def wrapped(left, right):
        return tidy_group(lambda x: run(x, right))(left)

    return wrapped
