"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For each prefix of a pre-token the unique last token of its encoding is stored.
An Aho-Corasick automaton over the vocabulary (suffix automaton matches) lists
the tokens that end at the prefix; a candidate is the last token exactly when it
is compatible with the last token of the prefix in front of it, that is, when no
merge would cross the seam between the two. Following the stored tokens backward
from the end emits the ids. Results are cached per distinct unit (white space and the
word after it) and pre-token in tables of bounded size, the seam tests per token pair.

Defined results: a null or empty text has no ids; extra columns are ignored;
repeated rows give repeated results; special token strings in a text become the
special id, as in the public tokenizers library's default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from kinframe.llm import _words as W
from kinframe.llm._units import Pool, UnitCoder
from kinframe.llm._work import tidy

#: Most distinct pre-tokens in each of two generations, and most token pairs, that a worker remembers.
CACHE_WORDS = 20_000
CACHE_PAIRS = 150_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def _classes() -> tuple[str, str, str]:
    """Letters, numbers and white space as explicit character ranges for ``re``."""
    import unicodedata

    def ranges(kind: str) -> str:
        out = []
        for at, run in groupby(range(0x110000), lambda c: unicodedata.category(chr(c))[0] == kind):
            if at:
                run = list(run)
                out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" if len(run) > 1 else f"\\U{run[0]:08x}")
        return "".join(out)

    white = r"\t-\r\x20\x85\xa0  -     　"
    return ranges("L"), ranges("N"), white


@lru_cache(1)
def splitter() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern, spelled with explicit classes."""
    letter, number, white = _classes()
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


class Vocabulary:
    """Tokens, merges and special strings of a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        model, special = spec["model"], {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.special = special
        self.size = 1 + max([*model["vocab"].values(), *special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in model["vocab"].items():
            self.bytes[i] = token.encode() if token in special else raw(token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        ids = model["vocab"]
        self.order, self.left, self.right = [-1] * self.size, [0] * self.size, [0] * self.size
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made, pair = ids[a + b], (ids[a], ids[b])
            self.pairs.setdefault(pair, rank)
            if self.order[made] < 0:
                self.order[made], (self.left[made], self.right[made]) = rank, pair
        made = {i for i in ids.values() if i not in special.values() and (self.order[i] >= 0 or len(self.bytes[i]) == 1)}
        self.usable = sorted(made)


class Encoder:
    """Encodes pre-tokens; ``words`` maps a pre-token to its ids as little-endian bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seams: dict[int, bool] = {}
        self.trie = ahocorasick.Automaton()
        for i in vocabulary.usable:
            self.trie.add_word(vocabulary.bytes[i].decode("latin-1"), (i, len(vocabulary.bytes[i])))
        self.trie.make_automaton()
        self.tokens = Pool(np.uint8)
        self.tokens.add([np.frombuffer(b, np.uint8) for b in vocabulary.bytes])
        self.units = UnitCoder(self.encode_many, vocabulary.special)
        self.split = splitter().findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _seam_holds(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay as they are under the merges."""
        order, pairs, never = self.v.order, self.v.pairs, 1 << 60
        before = never
        while True:
            if pairs.get((a, b), never) < before:
                return False
            made_a, made_b = order[a], order[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, a = made_a, self.v.right[a]
            else:
                before, b = made_b + 1, self.v.left[b]

    def prefixes(self, raw: bytes) -> list[int]:
        """The last token of the encoding of each non-empty prefix."""
        last = [-1] * (len(raw) + 1)
        seams = self.seams
        for end, (token, size) in self.trie.iter(raw.decode("latin-1")):
            at = end + 1
            if last[at] >= 0:
                continue
            front = at - size
            if front == 0:
                if self._whole(token):
                    last[at] = token
                continue
            before = last[front]
            if before < 0:
                continue
            key = before << 20 | token
            holds = seams.get(key)
            if holds is None:
                holds = seams[key] = self._seam_holds(before, token)
            if holds:
                last[at] = token
        return last

    def _whole(self, token: int) -> bool:
        """Whether a token's bytes are encoded as that token alone."""
        v = self.v
        return v.order[token] < 0 or self._seam_broken_last(token)

    def _seam_broken_last(self, token: int) -> bool:
        key = -1 - token
        known = self.seams.get(key)
        if known is None:
            v, stack, ok = self.v, [token], True
            while stack and ok:
                t = stack.pop()
                if v.order[t] >= 0:
                    a, b = v.left[t], v.right[t]
                    ok = self._holds_until(a, b, v.order[t])
                    stack += (a, b)
            known = self.seams[key] = ok
        return known

    def _holds_until(self, a: int, b: int, rank: int) -> bool:
        """Whether nothing crosses the seam before the merge of ``rank`` joins a and b."""
        v, never = self.v, 1 << 60
        if v.pairs.get((a, b), never) != rank:
            return False
        while True:
            made_a, made_b = v.order[a], v.order[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, a = made_a, v.right[a]
            else:
                before, b = made_b + 1, v.left[b]
            if v.pairs.get((a, b), never) < before:
                return False

    def encode_word(self, word: str) -> bytes:
        """Ids of a pre-token that the younger generation of the cache doesn't hold."""
        out = self.older.get(word) or self.fresh(word)
        if len(self.words) >= CACHE_WORDS:
            self.words, self.older = {}, self.words
        if len(word) <= 64:
            self.words[word] = out
        return out

    def fresh(self, word: str) -> bytes:
        raw = word.encode()
        last, ids, at = self.prefixes(raw), [], len(raw)
        while at:
            ids.append(last[at])
            at -= len(self.v.bytes[last[at]])
        if len(self.seams) >= CACHE_PAIRS:
            self.seams.clear()
        return np.array(ids[::-1], "<u4").tobytes()

    def _plain(self, text: str, out: list[bytes]) -> None:
        known, encode = self.words, self.encode_word  # a dict replaced midway stays valid, only older
        # pre-tokens are never empty, so their ids are never empty either
        out += [known.get(w) or encode(w) for w in self.split(text)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        out: list[bytes] = []
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            self._plain(text[at : found.start()], out)
            out.append(np.array([self.v.special[found.group()]], "<u4").tobytes())
            at = found.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.encode(t), np.uint32) for t in texts]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.tokens.take(ids.astype(np.int64))[0].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(Vocabulary(path))


def bpe_codec(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode and decode every whole text: n_tokens and digests of ids and of the decoded text.

    ``keep_ids`` / ``keep_text`` add the ids (little-endian 32-bit) and the decoded
    text themselves. A narrow map: no shuffle, one batch in memory at a time.
    """
    import pyarrow as pa


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary_path)
        for batch in batches:
            rows = []
            for ids in codec.units.encode(W.as_bytes(batch.column(1))):
                raw, decoded = ids.astype("<u4").tobytes(), codec.decode(ids)
                row = [len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()]
                rows.append(row + [raw] * keep_ids + [decoded] * keep_text)
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_ids + [pa.string()] * keep_text
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids + ", decoded string" * keep_text
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(tidy(run), schema)
