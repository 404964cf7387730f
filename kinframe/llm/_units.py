"""Encoding of texts through their distinct units, in whole arrays.

A unit is a run of white space with the word after it, or what follows the letters
of a word from a symbol on. Byte-level pre-tokenizers never join across the start of
such a run, so a text's ids are those of its units, one after another. The units of a chunk are found and hashed by array operations,
only the distinct ones that aren't in a bounded cache are encoded, and the ids are
gathered. The chunk is rebuilt from the cached units' bytes and compared, so a hash
collision can't change a result.

A text with white space outside ASCII may have runs that mix both kinds; such texts,
and those with special tokens' strings, are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

from kinframe.llm import _words as W

#: Most units in the cache; it starts anew beyond that.
CACHE_UNITS = 1_000_000
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
CHUNK = 1 << 20
_WIDE = re.compile("[\x85\xa0      　]")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOL = W.SPACED & ~_LETTER
_SYMBOL[:33] = _SYMBOL[48:58] = _SYMBOL[127:] = False
_HINTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


class Pool:
    """Byte strings or id lists one after another, with their places."""

    def __init__(self, kind: type) -> None:
        self.items = np.empty(1 << 16, kind)
        self.at = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.n = self.used = 0

    def add(self, parts: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        end = self.used + int(sizes.sum())
        while end > len(self.items):
            self.items = np.concatenate([self.items, np.empty_like(self.items)])
        while self.n + len(parts) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        if len(parts):
            np.concatenate(parts, out=self.items[self.used : end])
            self.at[self.n : self.n + len(parts)] = self.used + np.cumsum(sizes) - sizes
            self.size[self.n : self.n + len(parts)] = sizes
        self.n, self.used = self.n + len(parts), end

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen parts one after another, and their sizes."""
        size = self.size[which]
        end = np.cumsum(size)
        place = np.repeat(self.at[which] - end + size, size)
        place += np.arange(len(place))
        return self.items[place], size


class UnitCoder:
    """``encode_many`` gives the ids of each of a list of strings.

    Texts that hold one of the ``special`` strings are encoded whole.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[np.ndarray]], special: Iterable[str]) -> None:
        self.encode_many = encode_many
        self.special = [s.encode() for s in special]
        self._fresh()

    def _fresh(self) -> None:
        self.ids, self.raw = Pool(np.uint32), Pool(np.uint8)
        self.slots = np.zeros(SLOTS, np.uint64)
        self.entry = np.zeros(SLOTS, np.int32)

    def _find(self, h: np.ndarray, buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The cache entry of each unit; units without one are encoded first."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.entry[slot].astype(np.int64)
        miss = np.flatnonzero(self.slots[slot] != h)
        if not len(miss):
            return out
        distinct, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
        if self.raw.n and self.raw.n + len(distinct) > CACHE_UNITS:
            self._fresh()
            return self._find(h, buf, at, end)
        first = miss[where]
        raw = [buf[a:b] for a, b in zip(at[first].tolist(), end[first].tolist(), strict=True)]
        made = np.arange(self.raw.n, self.raw.n + len(raw))
        self.raw.add(raw)
        self.ids.add(self.encode_many([r.tobytes().decode() for r in raw]))
        out[miss] = made[back]
        # a slot keeps the last of its units; the others are encoded again when met again
        self.slots[slot[first]] = distinct
        kept = self.slots[slot[first]] == distinct
        self.entry[slot[first[kept]]] = made[kept]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        plain, odd = [], []
        for i, t in enumerate(texts):
            if t:
                whole = any(s in t for s in self.special) or not t.isascii() and any(h in t for h in _HINTS) and _WIDE.search(t.decode())
                (odd if whole else plain).append(i)
        for lo, hi in W.chunks([len(texts[i]) for i in plain], CHUNK):
            for i, ids in zip(plain[lo:hi], self._chunk([texts[i] for i in plain[lo:hi]]), strict=True):
                out[i] = ids
        for i, ids in zip(odd, self.encode_many([texts[i].decode() for i in odd]), strict=True):
            out[i] = ids
        return out

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        word = W.SPACED[buf]
        # a unit begins at each text, where white space follows a word, and at a symbol after a letter
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=first[1:])
        begins = np.zeros(len(buf), bool)
        begins[1:] = word[:-1] & ~word[1:] | _LETTER[buf[:-1]] & _SYMBOL[buf[1:]]
        begins[first[:-1]] = True
        at = np.flatnonzero(begins)
        end = np.r_[at[1:], len(buf)]
        entry = self._find(W.byte_spans(buf, at, end), buf, at, end)
        again, _ = self.raw.take(entry)
        if len(again) != len(buf) or not np.array_equal(again, buf):
            return self.encode_many([t.decode() for t in texts])
        ids, size = self.ids.take(entry)
        cuts = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(at, first)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
