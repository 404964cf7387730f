"""Duplicate word spans by relative Lempel-Ziv parsing against indexed reference blocks.

*Reference blocks.* The reference of a text is all texts with smaller ids. It is cut into
blocks by content, so that a block found in two texts is cut alike in both: in each
window of ``window`` words the least hash of its ``seed``-word sequences is the window's
anchor, and the words of the consecutive windows with one anchor are a block. The index
holds one row per distinct block: its fingerprint and the first text and place with it.

*Parsing.* A text is factored greedily from left to right: at a block that the index
knows from an earlier text a factor (place, length, reference text, reference place)
starts, and it is extended block by block as long as the reference goes on alike. Such
factors are at least ``window`` words long, so they are duplicate spans as they are.

*Factor boundaries.* Where the factors stop, a window may still begin in an earlier text
inside a block that goes on differently there. Equal windows have equal anchors, so this
can only be in blocks that are first of their content under an anchor that other texts
hold with other words around it. These blocks' windows are looked up one by one among
the first occurrences under such anchors; later occurrences add nothing, as their windows
begin in the first text too. What is found joins the factors.

So every window of the input that also starts in a text with a smaller id is found,
exactly, judged on the input. The index is never at one place: seeds (anchors) and
fingerprints meet in grouped minima and joins, which combine early and split when
skewed: no group is collected, and no pairs of a group are made. Only the parse itself is
a map over texts, each with its own references (at most one per block of the text).

Words and blocks are compared by 64-bit hashes. Defined results: null, empty and
short texts keep all their words; rows with equal ids never remove each other's
words; a null id neither removes nor loses words; repeated rows are kept and cost no
more than as many different rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm import _words as W
from kinframe.llm._work import forget, put, tidy

SEED = 10


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def blocks(words: W.Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Text, anchor, fingerprint, first and last window of each block."""
    h, first = words.hashes, words.first
    if len(h) < window:
        return (np.empty(0, np.int64),) + (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    anchor = _least(W.grams(h, seed), window - seed + 1)
    at = np.arange(len(anchor))
    text = np.searchsorted(first, at, "right") - 1
    inside = np.flatnonzero(at + window <= first[text + 1])
    at, text, anchor = at[inside], text[inside], anchor[inside]
    if not len(at):
        return text, anchor, anchor, at, at
    fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    lo = np.flatnonzero(fresh)
    hi = np.r_[lo[1:], len(at)] - 1
    base = first[text[lo]]
    return text[lo], anchor[lo], W.spans(W.prefix(h), at[lo], at[hi] + window), at[lo] - base, at[hi] - base


def _index(docs: DataFrame, window: int, seed: int) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_bytes(batch.column(2))
            doc, rid = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in W.chunks([len(t) for t in texts]):
                text, anchor, print_, a, b = blocks(W.Words(texts[lo:hi], W.SPACED, False), window, seed)
                out = [doc[lo + text], rid[lo + text], anchor.view(np.int64), print_.view(np.int64), a.astype(np.int32), b.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc_id", "rid", "anchor", "fp", "lo", "hi"])

    return docs.select("doc_id", "rid", "text").mapInArrow(tidy(run), "doc_id long, rid long, anchor long, fp long, lo int, hi int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """Hash, doc_id, rid, first and last place of each run of equal windows in the given ranges."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_bytes(batch.column(2))
            doc, rid = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ranges = batch.column(3).to_pylist()
            for lo, hi in W.chunks([len(t) for t in texts]):
                words = W.Words(texts[lo:hi], W.SPACED, False)
                total, out = W.prefix(words.hashes), ([], [], [], [])
                for k in range(lo, hi):
                    at = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges[k]]))
                    begin = at + words.first[k - lo]
                    wh = W.spans(total, begin, begin + window).view(np.int64)
                    # a text of one word over and over has one run, not a row per window
                    fresh = np.flatnonzero(np.r_[True, (wh[1:] != wh[:-1]) | (at[1:] != at[:-1] + 1)])
                    out[0].append(wh[fresh])
                    out[1].append(np.full(len(fresh), k))
                    out[2].append(at[fresh].astype(np.int32))
                    out[3].append(at[np.r_[fresh[1:], len(at)] - 1].astype(np.int32))
                wh, row, first, last = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(wh), pa.array(doc[row]), pa.array(rid[row]), pa.array(first), pa.array(last)], names=["wh", "doc_id", "rid", "lo", "hi"])

    return docs.select("doc_id", "rid", "text", "ranges").mapInArrow(tidy(run), "wh long, doc_id long, rid long, lo int, hi int")


def parse(references: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (place, words, reference text, reference place) of a text, left to right.

    References: first and last window of a block (or of a looked-up run of equal windows),
    and the text and place in which its first window begins.
    """
    out: list[list[int]] = []
    for lo, hi, doc, at in sorted(references):
        if out:
            place, words, ref, ref_at = out[-1]
            if lo <= place + words - window + 1 and ref == doc and ref_at + lo - place == at:
                out[-1][1] = max(words, hi + window - place)  # the reference goes on alike
                continue
        out.append([lo, hi + window - lo, doc, at])
    return [tuple(f) for f in out]


def _cut(docs: DataFrame, window: int, keep_text: bool, keep_factors: bool) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, references in zip(W.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                kept = words
                factors = parse([(r["lo"], r["hi"], r["ref"], r["at"]) for r in references or ()], window)
                if factors:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, [at for at, _, _, _ in factors], 1)
                    np.add.at(gone, [at + n for at, n, _, _ in factors], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                left = b" ".join(kept)
                row = [len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest()] + [left.decode()] * keep_text
                rows.append(row + [[dict(zip(parts, f, strict=True)) for f in factors]] * keep_factors)
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    parts = ("at", "words", "ref_doc", "ref_at")
    kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_text + [pa.list_(pa.struct([(p, pa.int64()) for p in parts]))] * keep_factors
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text + ["factors"] * keep_factors
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return docs.select("doc_id", "text", "references").mapInArrow(tidy(run), schema + ", factors array<struct<at: long, words: long, ref_doc: long, ref_at: long>>" * keep_factors)


def substring_dedup(docs: DataFrame, window: int = 50, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, keep_factors: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (``kept`` and ``factors``) of every row.

    Words are removed that lie in a window of ``window`` words which also starts in
    a text with a smaller id.
    """
    seed = min(seed, window)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    named = docs.where("doc_id IS NOT NULL")
    index = put(_index(named, window, seed), "blocks")
    shared = index.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("fp").alias("c"), F.max("fp").alias("d"))
    # minima are written before they are joined, so that both sides of each join can be split
    shared = put(shared.where("a <> b").select("anchor", (F.col("c") != F.col("d")).alias("mixed")), "shared")
    held = put(index.join(shared, "anchor").select("doc_id", "rid", "fp", "lo", "hi", "mixed"), "held")
    forget(index, shared)
    first = F.min(F.struct("doc_id", "lo")).alias("first")
    reference = put(held.groupBy("fp").agg(first).select("fp", F.col("first.doc_id").alias("ref"), F.col("first.lo").alias("at")), "reference")
    known = put(held.join(reference, "fp"), "known")
    forget(held, reference)
    whole = known.where("doc_id > ref").select("rid", "lo", "hi", "ref", "at")
    edges = known.where("doc_id = ref AND mixed").groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    lookups = put(_windows(named.join(edges, "rid"), window), "windows")
    earliest = lookups.groupBy("wh").agg(first, F.max("doc_id").alias("last")).where("first.doc_id < last")
    earliest = put(earliest.select("wh", F.col("first.doc_id").alias("ref"), F.col("first.lo").alias("at")), "earliest")
    single = lookups.join(earliest, "wh").where("doc_id > ref").select("rid", "lo", "hi", "ref", "at")
    references = whole.union(single).groupBy("rid").agg(F.collect_set(F.struct("lo", "hi", "ref", "at")).alias("references"))
    return _cut(docs.join(references, "rid", "left"), window, keep_text, keep_factors)
