"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a run of neighbouring documents inside a task, of about ``SHARD_BYTES`` (or one
longer text). Its suffix array holds all word suffixes that can match at all: those in
stretches of words that occur in the tests, as long as the shortest window at least; a
suffix ends with its stretch. It is built by prefix doubling (groups that are still tied
are sorted by the ranks one doubled step on), to the length of the longest test item.

Every test suffix is binary-searched in every shard, word by word: the range of suffixes
that agree so far is narrowed by the next word until the range is empty. The range at a
window's length gives all its occurrences; going on gives every place's longest verbatim
match (each place keeps the greatest depth whose range holds it). Places are marked once
per distinct range, and documents are paired with items once per distinct range, so
neither repetitive texts nor repetitive tests multiply: memory is linear in a shard and
in the answer.

Nothing is shuffled: the tests are broadcast while they are within ``MAX_TEST_BYTES``;
larger test sets are cut into blocks of at most that size, the shards are searched once
per block and the hits of a document are united.

Words are compared by 64-bit hashes. Defined results: null or empty text has no
words and no hits; a test item without words never matches; rows are kept one to
one, repeated rows too; items with a null id mark words as hit but aren't listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm import _words as W
from kinframe.llm._work import put, tidy

#: Most bytes of test text that are broadcast at once.
MAX_TEST_BYTES = 32 << 20
#: Bytes of text after which a shard is searched.
SHARD_BYTES = 4 << 20
OUT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "runs", "longest_match", "longest_at", "text_md5")
#: Pairs of document and item that are gathered before repeats are dropped.
GATHERED = 1 << 20


class Tests:
    """The words of a block of test items as numbers, and the window that begins at each word."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        words = W.Words([(text or "").encode() for _, text in items], W.ALNUM, True)
        self.names = [name for name, _ in items]
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        self.ids = ids.astype(np.int64) + 1  # 0 is any other word
        first = words.first
        sizes = first[1:] - first[:-1]
        self.longest = int(sizes.max(initial=0))
        item = np.repeat(np.arange(len(items)), sizes)
        size = np.minimum(window, sizes)[item]
        end = first[1:][item]
        at = np.arange(len(ids))
        valid = at + size <= end
        #: places where a window begins, its item and size, and the item's end
        self.at, self.item, self.size, self.end = at[valid], item[valid], size[valid], end[valid]
        self.least = int(self.size.min(initial=1))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The concatenated ranges lo:hi."""
    many = hi - lo
    return np.arange(int(many.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many)


class SuffixArray:
    """Sorted word suffixes of the stretches that can match."""

    def __init__(self, words: W.Words, tests: Tests) -> None:
        n = len(words.hashes)
        near = np.minimum(np.searchsorted(tests.vocabulary, words.hashes), max(0, len(tests.vocabulary) - 1))
        known = tests.vocabulary[near] == words.hashes if len(tests.vocabulary) else np.zeros(n, bool)
        word = np.where(known, near + 1, 0)
        # stretches of known words end at unknown ones and with their document
        fresh = np.ones(n, bool)
        fresh[1:] = known[1:] != known[:-1]
        fresh[words.first[:-1][words.first[:-1] < n]] = True
        start = np.flatnonzero(fresh)
        stop = np.append(start[1:], n)
        keep = known[start] & (stop - start >= tests.least) if n else known[:0]
        start, stop = start[keep], stop[keep]
        #: place in the shard of each word kept, its number, and where its stretch ends among those kept
        self.place = _ranges(start, stop)
        self.word = word[self.place]
        self.end = np.repeat(np.cumsum(stop - start), stop - start)
        self.order = self._sorted(tests.longest)

    def _sorted(self, longest: int) -> np.ndarray:
        n = len(self.word)
        order = np.argsort(self.word, kind="stable")
        ranked = self.word[order]
        rank = np.empty(n, np.int64)
        head = np.ones(n, bool)
        head[1:] = ranked[1:] != ranked[:-1]
        begin = np.flatnonzero(head)
        rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
        tied = np.flatnonzero(np.repeat(np.diff(np.append(begin, n)) > 1, np.diff(np.append(begin, n))))
        step = 1
        while len(tied) and step < longest:
            own = order[tied]
            on = own + step
            inside = on < self.end[own]
            then = np.where(inside, rank[np.minimum(on, n - 1)] + 1, 0)
            again = np.lexsort((then, rank[own]))
            own, then = own[again], then[again]
            was = rank[own]
            order[tied] = own
            head = np.ones(len(tied), bool)
            head[1:] = (was[1:] != was[:-1]) | (then[1:] != then[:-1])
            begin = np.flatnonzero(head)
            many = np.diff(np.append(begin, len(tied)))
            rank[own] = np.repeat(tied[begin], many)
            # what has ended stays tied for good
            tied = tied[np.repeat(many > 1, many) & (then > 0)]
            step *= 2
        return order

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, beyond: bool) -> np.ndarray:
        """First suffix in lo:hi whose word at the depth isn't below (beyond: is above) the given one."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            at = self.order[np.minimum(mid, len(self.order) - 1)]
            on = at + depth
            found = np.where(on < self.end[at], self.word[np.minimum(on, len(self.word) - 1)], 0)
            up = open_ & ((found <= word) if beyond else (found < word))
            lo = np.where(up, mid + 1, lo)
            hi = np.where(open_ & ~up, mid, hi)

    def search(self, tests: Tests) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Longest match at each suffix (0 below a window), and per window size the
        ranges (lo, hi) of the windows found with their items."""
        match, hits = np.zeros(len(self.order), np.int64), []
        if not len(self.order):
            return match, hits
        here = np.zeros(len(tests.vocabulary) + 2, np.int64)
        here[self.word] = 1
        sums = np.concatenate([[0], np.cumsum(here[tests.ids])])
        live = np.flatnonzero(sums[tests.at + tests.size] - sums[tests.at] == tests.size)  # all words of the window are here
        # test suffixes that agree so far share one range
        lo, hi, of = np.zeros(1, np.int64), np.full(1, len(self.order)), np.zeros(len(live), np.int64)
        depth, words = 0, len(tests.vocabulary) + 1
        while len(live):
            key, to = np.unique(of * words + tests.ids[tests.at[live] + depth], return_inverse=True)
            lo, hi, word = lo[key // words], hi[key // words], key % words
            lo = self._bound(lo, hi, depth, word, False)
            hi = self._bound(lo, hi, depth, word, True)
            depth += 1
            some = (lo < hi)[to]
            live, of = live[some], to[some]
            size = tests.size[live]
            done = size == depth
            if done.any():
                hits.append((depth, lo[of[done]], hi[of[done]], tests.item[live[done]]))
            told = np.unique(of[size <= depth])
            match[_ranges(lo[told], hi[told])] = depth
            goes_on = tests.at[live] + depth < tests.end[live]
            live, of = live[goes_on], of[goes_on]
        return match, hits


def search(words: W.Words, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: whether each word is hit, the longest match that begins at it, and the
    distinct pairs of document (as ordered) and item."""
    n = len(words.hashes)
    array = SuffixArray(words, tests)
    found, hits = array.search(tests)
    match, edge = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    match[array.place[array.order]] = found
    whole = max(1, len(tests.names))
    pairs, held, gathered = [np.empty(0, np.int64)], 0, np.empty(0, np.int64)
    for size, lo, hi, item in hits:
        ranges, which = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
        at = array.place[array.order[_ranges(ranges[:, 0], ranges[:, 1])]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        # documents and items of each distinct range, each once
        docs = np.searchsorted(words.first, at, "right") - 1
        of = np.repeat(np.arange(len(ranges)), ranges[:, 1] - ranges[:, 0])
        docs_of = np.unique(np.stack([of, docs], 1), axis=0)
        items_of = np.unique(np.stack([which.ravel(), item], 1), axis=0)
        a, b = (np.searchsorted(x[:, 0], np.arange(len(ranges) + 1)) for x in (docs_of, items_of))
        for k in range(len(ranges)):
            mine, theirs = docs_of[a[k] : a[k + 1], 1], items_of[b[k] : b[k + 1], 1]
            pairs.append((mine[:, None] * whole + theirs).ravel())
            held += len(pairs[-1])
            if held > GATHERED:
                gathered, pairs, held = np.unique(np.concatenate([gathered, *pairs])), [], 0
    gathered = np.unique(np.concatenate([gathered, *pairs]))
    return np.cumsum(edge[:-1]) > 0, match, gathered // whole, gathered % whole


def _documents(words: W.Words, tests: Tests) -> Iterator[tuple]:
    """Words, disjoint runs of hit words, items, and the longest verbatim match of each document."""
    hit, match, doc, item = search(words, tests)
    cut = np.searchsorted(doc, np.arange(len(words.first)))
    for k in range(len(words.first) - 1):
        a, b = int(words.first[k]), int(words.first[k + 1])
        if not hit[a:b].any():
            yield b - a, [], [], 0, None
            continue
        turns = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
        best = int(np.argmax(match[a:b]))
        names = sorted({tests.names[i] for i in item[cut[k] : cut[k + 1]].tolist() if tests.names[i] is not None})
        yield b - a, [{"s": int(x), "e": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)], names, int(match[a + best]), best


def _search(docs: DataFrame, items: list, window: int, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql import types as T

    tests = docs.sparkSession.sparkContext.broadcast(Tests(items, window))
    run_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    names = ["n_words", "runs", "items", "longest_match", "longest_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [t for batch in held for t in W.as_bytes(batch.column(batch.num_columns - 1))]
            found = iter([x for lo, hi in W.chunks([len(t) for t in texts], SHARD_BYTES) for x in _documents(W.Words(texts[lo:hi], W.ALNUM, True), tests.value)])
            for batch in held:
                columns = list(zip(*(next(found) for _ in range(batch.num_rows)), strict=True)) or [()] * 5
                kinds = [pa.int64(), run_type, pa.list_(pa.string()), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names[:-1], *names])

        for batch in batches:
            held.append(batch)
            size += batch.column(batch.num_columns - 1).nbytes
            if size >= SHARD_BYTES:
                yield from flush()
                held, size = [], 0
        yield from flush()

    text = F.col(text_col).cast("string")
    own = docs.select(*(F.col(c) for c in keep), F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("text_md5"), text.alias("_searched_text"))
    run_kind = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    made = [T.LongType(), run_kind, T.ArrayType(T.StringType()), T.LongType(), T.LongType()]
    schema = T.StructType([*own.schema.fields[:-1], *(T.StructField(n, k) for n, k in zip(names, made, strict=True))])
    return own.mapInArrow(tidy(run), schema)


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_test_bytes: int = MAX_TEST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: hit words, items found, longest verbatim match and its place.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items,
    runs (disjoint word ranges), longest_match (words), longest_at (word index),
    text_md5; before them the ``keep`` columns of the documents, but for those of these names.
    """
    keep = tuple(c for c in keep if c not in OUT)
    tests = tests.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total * 5 // (4 * max_test_bytes))) if total > max_test_bytes else 1
    if blocks == 1:
        found = _search(docs, [tuple(r) for r in tests.collect()], window, id_col, text_col, keep)
    else:
        parts = None
        for k in range(blocks):
            mine = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
            part = put(_search(docs, [tuple(r) for r in mine.collect()], window, id_col, text_col), f"tests-{k}")
            parts = part if parts is None else parts.unionByName(part)
        found = (
            parts.groupBy("doc_id", "text_md5", "n_words")
            .agg(
                (F.count("*") / blocks).cast("int").alias("copies"),
                F.flatten(F.collect_set("runs")).alias("runs"),
                F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
                F.max(F.struct("longest_match", "longest_at")).alias("m"),
            )
            .select("doc_id", "text_md5", "n_words", "runs", "items", "m.longest_match", "m.longest_at", "copies")
        )
        if keep:
            own = docs.select(*(F.col(c) for c in keep), F.col(id_col).cast("long").alias("_id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_md5"))
            found = own.join(found, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_md5") == F.col("text_md5")))
        else:
            found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    united = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda x, r: F.struct((x.n + F.greatest(F.lit(0), r.e - F.greatest(r.s, x.to))).alias("n"), F.greatest(x.to, r.e).alias("to")),
    )["n"]
    return found.select(
        *keep,
        "doc_id",
        "n_words",
        united.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        "items",
        "runs",
        "longest_match",
        "longest_at",
        "text_md5",
    )
