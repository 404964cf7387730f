"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (lower-case, hashed into ``WORDS`` terms), the trigrams of
its byte classes (``CLASSES``, so layout, case, digits and symbols in any language) and
binned rates of repetition: words equal to the word before, distinct words, distinct word
trigrams, repeated lines, word length, and text length. Counts are damped and weighted by
inverse document frequency; the leading singular directions of the labelled sample are
the latent space. The labelled vectors are broadcast (at most ``max_labelled`` x ``rank``
numbers), each document's exact cosines with all of them are computed in blocks, and its
``neighbours`` nearest vote with weights that grow with the similarity.

The model is fitted on at most ``max_labelled`` labelled rows outside the held-out
fifth, those with the smallest hash of their id; every document is scored over its
whole text. Nothing but the text enters a score.

Defined results: null text is empty; an empty text is scored like any other (its
terms say it is empty); a null id isn't held out; contradicting labels of an id are
averaged, and of rows with one id a single one is learnt from, the same in every run;
with no usable labels every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.llm import _words as W
from kinframe.llm._work import tidy

#: Most labelled rows that the model is fitted on.
MAX_LABELLED = 4096
RANK = 48
NEIGHBOURS = 25
#: Weight of a neighbour: its cosine to this power.
SHARPNESS = 24
#: A document is accepted at this score.
ACCEPT = 0.3
FOLDS = 5
BLOCK_ROWS = 256

#: Byte classes: lower, upper, digit, blank, line end, then groups of symbols, other.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "|", "!?", "#*", "$%&")
_N = len(CLASSES) + 2  # and bytes of other scripts, and other symbols
_OF = np.full(256, _N - 1, np.int32)
_OF[128:] = _N - 2
for _k, _chars in enumerate(CLASSES):
    _OF[list(_chars.encode())] = _k
_BINS = 8
_RATES = 6
#: Hashed word terms, and their weight beside the other terms.
WORDS = 2048
WORD_WEIGHT = 0.2
_SHAPES = _N**3
_AT_WORDS = _SHAPES + _RATES * _BINS
TERMS = _AT_WORDS + WORDS


def terms(texts: list[bytes]) -> np.ndarray:
    """Damped term frequencies of each text, one row each."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for lo, hi in W.chunks([len(t) for t in texts]):
        words = W.Words(texts[lo:hi], W.SPACED, True)
        c = _OF[words.buf]
        code = (c[:-2] * _N + c[1:-1]) * _N + c[2:]
        h, first = words.hashes, words.first
        again = np.r_[False, h[1:] == h[:-1]] if len(h) else np.empty(0, bool)
        triples = W.grams(h, 3)
        for k in range(hi - lo):
            text, (a, b), at = texts[lo + k], first[k : k + 2], words.offsets[k]
            n = int(b - a)
            if n:
                bucket = (h[a:b] >> np.uint64(20)).astype(np.int64) % WORDS
                out[lo + k, _AT_WORDS:] = WORD_WEIGHT * np.sqrt(np.bincount(bucket, minlength=WORDS) / n)
            # the blanks beside a text belong to every text alike
            seen = np.bincount(code[at - 1 : at + len(text) - 1], minlength=_SHAPES) if len(text) else np.zeros(_SHAPES)
            out[lo + k, : _SHAPES] = np.sqrt(seen / max(1, len(text)))
            lines = [x for x in text.split(b"\n") if x.strip()]
            rates = (
                again[a:b].mean() if n else 0.0,
                len(np.unique(h[a:b])) / n if n else 0.0,
                len(np.unique(triples[a : b - 2])) / (n - 2) if n > 2 else 1.0,
                1 - len(set(lines)) / len(lines) if lines else 0.0,
                min(1.0, len(text) / max(1, n) / 24),
                min(1.0, np.log1p(n) / 10),
            )
            for r, x in enumerate(rates):
                place = min(float(x), 1.0) * (_BINS - 1)
                low = min(int(place), _BINS - 2)
                at_bin = _SHAPES + r * _BINS + low
                out[lo + k, at_bin : at_bin + 2] = 0.25 * (low + 1 - place), 0.25 * (place - low)
    return out


def packed(x: np.ndarray) -> bytes:
    """The terms of a text that it has."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    out = np.zeros(TERMS, np.float32)
    out[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return out


class Model:
    """Weights, latent directions, and the labelled vectors."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK) -> None:
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        w = x * self.idf
        start = np.random.Generator(np.random.PCG64(7)).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
        basis = np.linalg.qr(start)[0]
        for _ in range(8):  # subspace iteration on the term covariance
            basis = np.linalg.qr(w.T @ (w @ basis))[0]
        left, _, _ = np.linalg.svd(basis.T @ (w.T @ (w @ basis)))
        self.directions = np.ascontiguousarray((basis @ left)[:, :rank])
        self.vectors = self.project(x)

    def project(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.idf) @ self.directions
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        cosine = self.project(x) @ self.vectors.T
        near = np.argpartition(-cosine, min(neighbours, cosine.shape[1]) - 1, axis=1)[:, :neighbours]
        weight = np.clip(np.take_along_axis(cosine, near, 1), 1e-6, 1).astype(np.float64) ** SHARPNESS
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model from at most ``max_labelled`` labelled rows outside the held-out fold."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [packed(r) for r in terms(W.as_bytes(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["k", "y", "x"])

    marked = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("double").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").where(fold("k") != 0)
    marked = marked.groupBy("k").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_labelled)
    mine = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(marked), "k")  # max_labelled rows at most
    # one row for each labelled id, so max_labelled at most
    rows = mine.select("k", "y", "t").mapInArrow(tidy(run), "k long, y double, x binary").groupBy("k", "y").agg(F.min("x").alias("x")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    return Model(np.stack([unpacked(bytes(r["x"])) for r in rows]), np.array([r["y"] for r in rows]))


def quality_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), accept: float = ACCEPT) -> DataFrame:
    """``keep`` columns, then doc_id, held_out, score and predicted of every row."""
    import pyarrow as pa
    from pyspark.sql import types as T

    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = W.as_bytes(batch.column(batch.num_columns - 1)), []
            for at in range(0, len(texts), BLOCK_ROWS):
                part = texts[at : at + BLOCK_ROWS]
                scores.append(told.value.score(terms(part)) if told.value else np.full(len(part), 0.5))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(score, 0, 1), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    own = docs.select(*(F.col(c) for c in keep if c != id_col), F.col(id_col), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("_scored_text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return own.mapInArrow(tidy(run), schema).withColumn("predicted", (F.col("score") >= accept).cast("int"))
