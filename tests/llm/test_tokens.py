"""BPE (op 9) and the token store (op 3) against the public tokenizers library."""

import random
import zlib

import numpy as np
import pytest

from kinframe.llm import bpe, token_store
from kinframe.llm.catalog import VOCABULARY

from .helpers import AWKWARD, docs, empty, sha


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def strings(n, seed=1):
    rng = random.Random(seed)
    pool = [chr(c) for c in (*range(600), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0xAC00, 0x660, 0x2160, 0x300, 0xFEFF, 0x10FFFF)] + ["<|endoftext|>", "  ", "\n\n", "'s", "'ll", "the", " ing", "\x85", "\xa0"]
    return ["".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice("then of \n\xa0") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoders_match_the_library(library):
    texts = strings(3000) + [t or "" for _, t in AWKWARD] + ["a" * 3000, "ab1" * 2000, " " * 500]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    codec = bpe.encoder(VOCABULARY)
    for coder in (codec.units, token_store._library(VOCABULARY)[0]):
        got = coder.encode([t.encode() for t in texts])
        assert [g.tolist() for g in got] == want
        assert [g.tolist() for g in coder.encode([t.encode() for t in texts])] == want  # now from the cache
    assert [codec.decode(np.array(i, np.uint32)) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert [np.frombuffer(codec.encode(t), "<u4").tolist() for t in texts[:500]] == want[:500]


def test_cache_restarts(library, monkeypatch):
    from kinframe.llm import _units

    monkeypatch.setattr(_units, "CACHE_UNITS", 50)
    monkeypatch.setattr(_units, "CHUNK", 200)
    coder = _units.UnitCoder(bpe.encoder(VOCABULARY).encode_many, ["<|endoftext|>"])
    texts = strings(300, 2)
    assert [g.tolist() for g in coder.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_codec(spark, library):
    rows = bpe.bpe_codec(docs(spark), VOCABULARY, keep_text=True).collect()
    assert len(rows) == len(AWKWARD)
    want = sorted((repr(d), len(i := library.encode(t or "", add_special_tokens=False).ids), sha(np.array(i, "<u4").tobytes()), sha(t or "")) for d, t in AWKWARD)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.bpe_codec(empty(spark), VOCABULARY).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 0), (1, 0), (1, 9), (1000, 3), (5000, 10**6), (600, 10**13), (700, 700)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    made = token_store.EliasFano.encode(values)
    got, at = token_store.EliasFano.from_buffer(b"xx" + made.to_bytes(), 2)
    assert (got.decode() == values).all() and at == 2 + len(made.to_bytes())
    assert all(got.select(i) == values[i] for i in range(n))
    assert got.samples.dtype == np.dtype("<u8") and len(got.samples) == -(-n // token_store.SAMPLE)
    for lo in range(0, n, 37):
        for size in (0, 1, 36, 511, 512, 600):
            assert (got.window(lo, min(n, lo + size)) == values[lo : lo + size]).all()
    if n > 500:
        assert 8 * len(made.to_bytes()) / n < 2.6 + max(0, np.log2(top / n)) + 0.5


def test_token_store(spark, library):
    path = token_store.write_tokens(docs(spark), VOCABULARY, shard_ids=40)
    got = token_store.read_tokens(spark, path, keep_ids=True).collect()
    assert len(got) == len(AWKWARD)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(d for d, _ in AWKWARD if d is not None)
    want = sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in AWKWARD)
    assert sorted(bytes(r.ids) for r in got) == want
    assert token_store.read_tokens(spark, token_store.write_tokens(empty(spark), VOCABULARY)).count() == 0


def test_shard_document_access():
    ids = [np.arange(n, dtype=np.uint32) for n in (3, 1, 700)]
    s = token_store.Shard(token_store.shard([None, -5, 7], ids, 10, 2))
    assert s.doc_ids() == [None, -5, 7] and [s.document(k).tolist() for k in range(3)] == [i.tolist() for i in ids] and s.base == 10


def test_shards_are_read_in_windows():
    """Boundaries and ids of many documents come window by window, null ids first."""
    rng = np.random.default_rng(4)
    ids = [np.arange(k, dtype=np.uint32) for k in rng.integers(1, 40, 1500)]
    names = [None] * 600 + np.sort(rng.integers(-(10**12), 10**12, 900)).tolist()
    s = token_store.Shard(token_store.shard(names, ids, 5, 2))
    got = list(s.windows())
    assert [len(x) for x, _, _ in got] == [512, 512, 476] and [i for x, _, _ in got for i in x] == names
    ends = np.cumsum([len(x) for x in ids])
    assert (np.concatenate([e for _, _, e in got]) == ends).all() and (np.concatenate([b for _, b, _ in got]) == ends - [len(x) for x in ids]).all()
    assert s.document(0).tolist() == ids[0].tolist() and s.document(1499).tolist() == ids[1499].tolist()
