"""Vectorised word scan: byte classes, 64-bit word hashes and n-gram hashes.

Texts are handled as UTF-8 bytes. All word classes used here are decided by
ASCII bytes alone, so a byte scan finds exactly the words that the character
classes describe (every byte of a non-ASCII character is 0x80 or above).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MIX = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD1B54A32D192ED03 | 1
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _not_in(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = _not_in((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z)
ALNUM = _not_in((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class _Powers:
    """p**i and p**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 16, 2 * len(self.up))
            self.up, self.down = (self._row(b, n) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three shift-multiply rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a few texts: byte spans, hashes, and where each text's words begin."""

    __slots__ = ("buf", "hashes", "starts", "ends", "first", "offsets")

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: bool) -> None:
        joined = b" " + b" ".join(texts) + b" "
        raw = np.frombuffer(joined, np.uint8)
        buf = LOWER[raw] if lower else raw
        inside = is_word[buf].view(np.int8)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.buf, self.starts, self.ends = raw, edge[0::2], edge[1::2]
        self.hashes = byte_spans(buf, self.starts, self.ends)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.offsets = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.starts, self.offsets)  # text k has words first[k]:first[k + 1]


def byte_spans(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each byte range lo:hi."""
    up, down = _BYTES.get(len(buf))
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_MIX[buf] * up[: len(buf)], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items of ``h``; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = prefix(h)
    return spans(total, np.arange(n), np.arange(k, n + k))


def prefix(h: np.ndarray) -> np.ndarray:
    up, _ = _WORDS.get(len(h) + 1)
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * up[: len(h)], out=total[1:])
    return total


def spans(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each item sequence lo:hi, from its prefix sums."""
    _, down = _WORDS.get(len(total))
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(_P))


def chunks(sizes: list[int], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``most`` bytes together, or one longer text."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n + 1
    if len(sizes) > lo:
        yield lo, len(sizes)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
