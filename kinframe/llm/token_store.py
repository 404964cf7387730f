"""Token ids in binary shards with Elias-Fano coded document boundaries.

A shard is one self-contained record of bounded size:

    magic "KFT1" | ids per value in bytes | documents, ids, null ids | base
    ids: unsigned little-endian integers, 2 bytes if the vocabulary allows, else 4
    boundaries: Elias-Fano sequence of the documents' ends in the shard
    doc_ids: Elias-Fano sequence of the ascending document ids, less the first

An Elias-Fano sequence of n values up to u keeps the low floor(log2(u / n)) bits of
each packed and the high parts in unary in a bit vector of n + (u >> low) bits: about
2 + log2(u / n) bits a value and no 64-bit table. Beside the bit vector the shard stores
the place of every ``SAMPLE``-th one; ``select`` finds the i-th one by popcounts from its
sample on, and ``window`` a stretch of them from the samples around it. All reading goes
through these two, so no table of boundaries is made, in the file or in memory.

Texts are encoded by the public tokenizers library, each distinct unit (white space and
the word after it) once while it is in a worker's bounded cache. Documents are dealt by ranges of doc_id and sorted, so
shards are in ascending order; shards are rows of a Parquet table, written by Spark's
committer, so lost executors and repeated tasks leave no half-written file. Each range's
total is read back from the table's small columns; its running sum, one number
per range, gives the base of each range.

Defined results: null text is empty and has just the end id; rows with a null
doc_id come first; ties of doc_id are all kept, in any order; other columns are
ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinframe.llm import _words as W
from kinframe.llm._units import UnitCoder
from kinframe.llm._work import fresh_path, short_batches, tidy

MAGIC = b"KFT1"
SAMPLE = 512
#: Most ids of a shard, unless one document has more.
SHARD_IDS = 1 << 21
_HEAD = struct.Struct("<4sBxxxqqqq")
_EF = struct.Struct("<qqB7xq")


class EliasFano:
    """A non-decreasing sequence of integers from 0 on, with select."""

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, samples: np.ndarray, high: np.ndarray) -> None:
        self.n, self.top, self.low_bits, self.low, self.samples, self.high = n, top, low_bits, low, samples, high

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << low_bits) - 1)
        bits = (low[:, None] >> np.arange(low_bits, dtype=np.uint64)).astype(np.uint8) & 1
        high = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high[ones] = 1
        return cls(n, top, low_bits, np.packbits(bits.ravel(), bitorder="little"), ones[::SAMPLE].astype("<u8"), np.packbits(high, bitorder="little"))

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.top, self.low_bits, len(self.high)) + self.low.tobytes() + self.samples.tobytes() + self.high.tobytes()

    @classmethod
    def from_buffer(cls, buf: bytes, at: int) -> tuple[EliasFano, int]:
        n, top, low_bits, size = _EF.unpack_from(buf, at)
        at += _EF.size
        low_size, many = (n * low_bits + 7) // 8, -(-n // SAMPLE)
        low = np.frombuffer(buf, np.uint8, low_size, at)
        samples = np.frombuffer(buf, "<u8", many, at + low_size)
        high = np.frombuffer(buf, np.uint8, size, at + low_size + 8 * many)
        return cls(n, top, low_bits, low, samples, high), at + low_size + 8 * many + size

    def _lows(self, lo: int, hi: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(hi - lo, np.int64)
        first = lo * self.low_bits
        last = hi * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 : first % 8 + last - first]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        at, left = divmod(int(self.samples[i // SAMPLE]), 8)
        seen = i // SAMPLE * SAMPLE - int(self.high[at] & ((1 << left) - 1)).bit_count()  # ones before this byte
        while True:
            block = np.bitwise_count(self.high[at : at + 64]).astype(np.int64)
            ones = int(block.sum())
            if seen + ones > i:
                break
            at, seen = at + 64, seen + ones
        byte = int(np.searchsorted(np.cumsum(block), i - seen, "right"))
        seen += int(block[:byte].sum())
        bit = np.flatnonzero(np.unpackbits(self.high[at + byte : at + byte + 1], bitorder="little"))[i - seen]
        return (((at + byte) * 8 + int(bit) - i) << self.low_bits) | int(self._lows(i, i + 1)[0])

    def decode(self) -> np.ndarray:
        """All values, for small sequences."""
        return self.window(0, self.n)

    def window(self, lo: int, hi: int) -> np.ndarray:
        """The values lo to hi - 1, from the samples around them."""
        if hi <= lo:
            return np.empty(0, np.int64)
        k, end = lo // SAMPLE, -(-hi // SAMPLE)
        first = int(self.samples[k]) // 8
        last = int(self.samples[end]) // 8 + 1 if end < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + first * 8
        ones = ones[np.searchsorted(ones, int(self.samples[k])) :][lo - k * SAMPLE : hi - k * SAMPLE]
        return ((ones - np.arange(lo, hi)) << self.low_bits) | self._lows(lo, hi)


@lru_cache(2)
def _library(path: str) -> tuple[UnitCoder, int]:
    """A text encoder on the tokenizers library, by distinct units, and the vocabulary's size."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    special = {str(t.content): i for i, t in library.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.single_word)}
    fence, fence_id = next(iter(special.items()), ("", -1))

    def encode_many(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        alone = [i for i, t in enumerate(texts) if not fence or len(t) > 256 or any(s in t for s in special)]
        for i, got in zip(alone, library.encode_batch([texts[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(got.ids, np.uint32)
        # the library encodes what stands between special tokens on its own, so many
        # short texts go through one call with special tokens between them
        together = np.setdiff1d(np.arange(len(texts)), alone).tolist()
        for lo in range(0, len(together), 2048):
            part = together[lo : lo + 2048]
            ids = np.array(library.encode(fence.join([texts[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == fence_id)
            for i, a, b in zip(part, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
                out[i] = ids[a:b]
        return out

    strings = [str(t.content) for t in library.get_added_tokens_decoder().values()]
    return UnitCoder(encode_many, strings), library.get_vocab_size(with_added_tokens=True)


def shard(doc_ids: list[int | None], ids: list[np.ndarray], base: int, width: int) -> bytes:
    """A shard of the documents, in the order given (null ids first)."""
    ends = np.cumsum([len(x) for x in ids])
    given = [d for d in doc_ids if d is not None]
    first = given[0] if given else 0
    values = np.concatenate(ids).astype(f"<u{width}")
    head = _HEAD.pack(MAGIC, width, len(ids), len(values), len(doc_ids) - len(given), base)
    names = EliasFano.encode(np.array([d - first for d in given], np.uint64)).to_bytes()
    return b"".join([head, struct.pack("<q", first), EliasFano.encode(ends).to_bytes(), names, values.tobytes()])


class Shard:
    """A reader of one shard."""

    def __init__(self, buf: bytes) -> None:
        magic, width, self.n, self.total, self.nulls, self.base = _HEAD.unpack_from(buf, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        (self.first,) = struct.unpack_from("<q", buf, _HEAD.size)
        self.ends, at = EliasFano.from_buffer(buf, _HEAD.size + 8)
        self.names, at = EliasFano.from_buffer(buf, at)
        self.ids = np.frombuffer(buf, f"<u{width}", self.total, at)

    def doc_ids(self) -> list[int | None]:
        return [i for ids, _, _ in self.windows() for i in ids]

    def windows(self, most: int = SAMPLE) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """doc_ids, begins and ends of up to ``most`` documents at a time."""
        before = 0
        for lo in range(0, self.n, most):
            hi = min(self.n, lo + most)
            ends = self.ends.window(lo, hi)
            begins = np.concatenate([[before], ends[:-1]])
            before = int(ends[-1])
            named = self.names.window(max(0, lo - self.nulls), max(0, hi - self.nulls)) + self.first
            yield [None] * (hi - lo - len(named)) + named.tolist(), begins, ends

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by two selects."""
        return self.ids[self.ends.select(k - 1) if k else 0 : self.ends.select(k)]


def write_tokens(docs: DataFrame, vocabulary_path: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> str:
    """Encode every whole text and write the shards in ascending doc_id order; the table's path."""
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, size = _library(vocabulary_path)
        width = 2 if max(size - 1, end_id) < 1 << 16 else 4
        part, number, base = TaskContext.get().partitionId(), 0, 0
        names: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, base, held
            row = [part, number, base, held, shard(names, ids, base, width)]
            number, base, held = number + 1, base + held, 0
            names.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=columns)

        for batch in batches:
            for name, got in zip(batch.column(0).to_pylist(), coder.encode(W.as_bytes(batch.column(1))), strict=True):
                names.append(name)
                ids.append(np.concatenate([got, end]))
                held += len(got) + 1
                if held >= shard_ids:
                    yield flush()
        if names:
            yield flush()

    columns = ["part", "number", "base", "n_ids", "shard"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    dealt = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    with short_batches(spark):
        dealt.mapInArrow(tidy(run), "part int, number int, base long, n_ids long, shard binary").write.mode("overwrite").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and ``ids``) of each document of a store."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, buf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = Shard(buf)
                for doc_ids, begins, ends in got.windows():
                    ids, at = got.ids[begins[0] : ends[-1]].astype("<u4"), begins[0]
                    raw = [ids[a:b].tobytes() for a, b in zip((begins - at).tolist(), (ends - at).tolist(), strict=True)]
                    columns = [doc_ids, begins + before + got.base, ends - begins, [zlib.crc32(x) for x in raw]] + [raw] * keep_ids
                    kinds = [pa.int64()] * 4 + [pa.binary()] * keep_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    store = spark.read.schema("part int, number int, base long, n_ids long, shard binary").parquet(path)
    # one row per written range, at most as many as the shuffle has partitions
    totals = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return store.join(F.broadcast(before), "part").select("before", "shard").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
