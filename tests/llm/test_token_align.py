"""Cross-tokenizer alignment (op 12) against a token-by-token model."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinframe.llm import catalog, token_align

from .helpers import AWKWARD, docs, empty, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    return token_align.Sides(catalog.VOCABULARY, catalog.PIECES)


def tokens(sides, text):
    """(id, end) of both sides' tokens, or None."""
    if not text:
        return None
    a = [(i, sides.a_bytes[i]) for i in sides.a.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, sides.b_bytes[i]) for i in sides.b.encode(text)]
    want = (" " + text).encode()
    if any(b"".join(x for _, x in side) != want for side in (a, b)):
        return None
    out = []
    for side in (a, b):
        at, ends = 0, []
        for i, raw in side:
            at += len(raw)
            ends.append((i, at))
        out.append(ends)
    return out


def model(sides, rows, links="ends"):
    told, count = [], Counter()
    for doc_id, text in rows:
        found = tokens(sides, text)
        if found is None:
            told.append((doc_id, 0, 0, [], ""))
            continue
        a, b = found
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, e in a if low < e <= cut) + "|" + ",".join(str(i) for i, e in b if low < e <= cut))
            low = cut
        if links == "ends":
            at = dict((e, i) for i, e in b)
            pairs = [(i, at[e]) for i, e in a if e in at]
        else:
            spans = lambda s: [(i, p, e) for (i, e), p in zip(s, [0, *(e for _, e in s)], strict=False)]
            pairs = [(i, j) for i, p, e in spans(a) for j, q, f in spans(b) if p < f and q < e]
        count.update(pairs)
        told.append((doc_id, len(a), len(b), pairs, ";".join(groups)))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = [(d, na, nb, groups.count(";") + 1 if groups else 0, len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), sha(groups) if groups else "") for d, na, nb, pairs, groups in told]
    return sorted(out, key=repr), {(a, b, n, n == best[b]) for (a, b), n in count.items()}


def strange(n, seed=3):
    rng = random.Random(seed)
    pool = ["the", " market", "  ", "\n", "\n\n", "\t", "\r\n", ";\r", "é", "é", "ñ", "日本", "\U0001f600", "▁", "\xa0", " \xa0 ", "　", "<|endoftext|>", "<s>", "<0x41>", "1234", "'ll", ".", "...", "x" * 30, "\x00", "Straße", "ﬁ", "\x85"]
    return [(i, "".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))) for i in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("links", ["ends", "overlap"])
def test_against_the_model(spark, sides, links):
    rows = [(d, t if d != 8 else "long " * 500) for d, t in AWKWARD] + strange(150)
    got = token_align.align_tokenizers(docs(spark, rows), catalog.VOCABULARY, catalog.PIECES, links=links, block_bytes=300)
    want, pairs = model(sides, rows, links)
    assert rows_of(got.documents) == want
    assert {tuple(r) for r in got.pairs.collect()} == pairs
    assert sum(w[1] == 0 for w in want) > 5 and any(w[5] < w[4] for w in want)


def test_units_are_whole_texts(sides):
    """Texts put together from cached units are as texts tokenized whole."""
    aligner = token_align.Aligner(sides)
    texts = [t.encode() for _, t in strange(600, 9)]
    for _ in range(2):
        for text, (nums, keys, groups) in zip(texts, aligner.align(texts), strict=True):
            alone = token_align.Aligner(sides)._one(b" " + text) if text else (np.zeros(4), [], b"")
            if alone[0][0] <= 0:
                alone = (np.zeros(4), [], b"")
            assert (nums == alone[0]).all() and list(keys) == list(alone[1]) and groups == alone[2]


def test_union_find():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 20), (400, 380), (300, 5000), (1000, 999)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        if m == 999:
            a, b = np.arange(999)[::-1], np.arange(1, 1000)[::-1]  # one path
        root = token_align.union_find(n, a, b)
        want = list(range(n))

        def find(x, want=want):
            while want[x] != x:
                x = want[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = sorted((find(x), find(y)))
            want[y] = x
        assert [find(x) for x in range(n)] == root.tolist()


def test_empty_and_groups(spark):
    assert token_align.align_tokenizers(empty(spark), catalog.VOCABULARY, catalog.PIECES).documents.count() == 0
    got = token_align.align_tokenizers(docs(spark, [(1, "hello  world"), (2, None)]), catalog.VOCABULARY, catalog.PIECES, keep_groups=True).documents.orderBy("doc_id").collect()
    assert got[0].groups.count("|") == got[0].n_groups and sha(got[0].groups) == got[0].groups_sha256 and got[1].groups == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_query(spark, sides):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.queries()["op12_token_align"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == model(sides, rows)[0]
