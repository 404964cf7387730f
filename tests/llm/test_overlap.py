"""Jaccard join (op 4), substring removal (op 6) and decontamination (op 8) by brute force."""

import random
import re
from collections import defaultdict

import pytest

from kinframe.llm import decontaminate, ngram_join, substring_dedup
from kinframe.llm._components import components

from .helpers import AWKWARD, docs, empty, invented, sha

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def jaccard(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and min(len(a), len(b)) * den >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("k", "num", "den", "block", "hot"), [(3, 90, 100, 1024, 1000), (5, 80, 100, 8, 20), (1, 50, 100, 16, 1000), (2, 100, 100, 8, 5), (1, 30, 100, 8, 20)])
def test_ngram_join(spark, monkeypatch, k, num, den, block, hot):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = AWKWARD + [(d + 50, t) for d, t in invented(random.Random(k), 260)]
    got = ngram_join.ngram_jaccard(docs(spark, rows), k, num, den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == jaccard(rows, k, num, den)


@pytest.mark.parametrize("share", [0.3, 1.0])
def test_ngram_join_with_too_few_parts(spark, monkeypatch, share):
    """The guarantee holds where parts are empty or fewer than can be spoiled."""
    monkeypatch.setattr(ngram_join.Threshold, "groups", lambda t, band: max(1, int(share * t.spoiled((2 << band) - 1))))
    monkeypatch.setattr(ngram_join, "HOT", 30)
    rows = invented(random.Random(21), 200)
    got = ngram_join.ngram_jaccard(docs(spark, rows), 2, 70, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == jaccard(rows, 2, 70, 100)


def test_ngram_join_dense_group(spark, monkeypatch):
    """Many near copies, few of which are linked with the first."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(60)] = f"x{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_jaccard(docs(spark, rows), 1, 90, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == jaccard(rows, 1, 90, 100)


def test_links_over_several_size_bands(spark):
    """15 of 40 shingles at a threshold of 0.3: the sizes lie two powers of two apart."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:15])), (3, " ".join(words[:11]))]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), 1, 30, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_jaccard(empty(spark)).count() == 0


def removed(rows, n):
    first = {}
    for d, t in rows:
        w = SPACED.findall(t or "")
        for j in range(len(w) - n + 1):
            if d is not None:
                first[tuple(w[j : j + n])] = min(d, first.get(tuple(w[j : j + n]), d))
    out = []
    for d, t in rows:
        w, gone = SPACED.findall(t or ""), set()
        for j in range(len(w) - n + 1 if d is not None else 0):
            if first[tuple(w[j : j + n])] < d:
                gone.update(range(j, j + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [50, 12, 3])
def test_substring_dedup(spark, window):
    rows = AWKWARD + [(d + 50, t) for d, t in invented(random.Random(window), 200)] + [(2000, "x y " * 200), (2001, "x y " * 150 + "z"), (1999, "y x " * 60)]
    got = substring_dedup.substring_dedup(docs(spark, rows), window, keep_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == removed(rows, window)
    assert all(sha(r.kept) == r.kept_sha256 for r in got)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_factors_are_copies_of_the_reference(spark):
    """Each factor is found at its reference in an earlier text; copies are one factor, not one per block."""
    rng = random.Random(8)
    rows = [(d + 50, t) for d, t in invented(rng, 120)]
    long = " ".join(f"v{rng.randint(0, 3000)}" for _ in range(900))
    rows += [(5000, long), (5001, "before " + long + " after"), (5002, long[: len(long) // 2] + " other " + long)]
    words = defaultdict(list)
    for d, t in rows:
        words[d].append(SPACED.findall(t or ""))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 20, keep_factors=True).collect()}
    found = 0
    for d, r in got.items():
        covered = set()
        for f in r.factors:
            own = words[d][0][f.at : f.at + f.words]
            assert f.ref_doc < d and len(own) == f.words >= 20 and any(w[f.ref_at : f.ref_at + 20] == own[:20] for w in words[f.ref_doc])
            if len(set(own)) > 1:  # runs of one word stand for all their windows
                assert any(w[f.ref_at : f.ref_at + f.words] == own for w in words[f.ref_doc])
            covered.update(range(f.at, f.at + f.words))
            found += 1
        assert len(covered) == r.n_removed
    assert found > 50
    assert [(f.at, f.words, f.ref_doc, f.ref_at) for f in got[5001].factors] == [(1, 900, 5000, 0)]


def test_repeated_rows_are_linear(spark):
    """A row repeated many times beside one that shares its passages."""
    text = " ".join(f"w{i % 97}" for i in range(300))
    rows = [(7, text)] * 1500 + [(8, "x " + text + " y")] * 700 + [(9, " ".join(f"w{i % 97}" for i in range(100)) + " tail")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(tuple(r) for r in got) == [(7, 300, 0, 1500), (8, 302, 300, 700), (9, 101, 100, 1)]


TESTS = [(1, "p3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 p14"), (2, "Anna went to The market"), (10, "nothing of the kind is in there at all, or is it so"), (3, None), (4, " . "), (5, "a"), (2, "Anna went to The market"), (None, "p5 p6 p7 p8 p9 p10 p11 p12 p13 p14")]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_decontaminate(spark, most):
    rows = AWKWARD + invented(random.Random(9), 150)
    wins = defaultdict(set)
    for i, t in TESTS:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[j : j + n])].add(i)
    want = []
    for d, t in rows:
        w, hit, items = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in wins}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit.update(range(j, j + n))
                    items |= wins[tuple(w[j : j + n])]
        items = sorted(str(i) for i in items - {None})
        want.append((d, len(w), len(hit), len(items), sha(",".join(items)), bool(hit)))
    found = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(TESTS, "item_id long, text string"), max_test_bytes=most)
    got = found.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == sorted(want, key=repr)
    assert all((r.longest_match > 0) == r.contaminated for r in got)
    kept = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(TESTS, "item_id long, text string"), max_test_bytes=most, keep=("text", "cls")).collect()
    assert sorted(((r.doc_id, r.text or "", r.n_hit) for r in kept), key=repr) == sorted(((d, t or "", h) for (d, t), (_, _, h, *_) in zip(rows, want, strict=True)), key=repr)


def brute_longest(text, items, window=10):
    """The longest run of words of the text that an item holds too, of those that hold a window."""
    w, best = ALNUM.findall(text.translate(LOW)), 0
    for t in items:
        v = ALNUM.findall((t or "").translate(LOW))
        row = [0] * (len(v) + 1)
        for x in w:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(v)]
            best = max([best] + [n for n in row if v and n >= min(window, len(v))])
    return best


@pytest.mark.parametrize("shard", [200, 1 << 22])
def test_longest_matches(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rng = random.Random(31)
    items = [" ".join(f"p{i}" for i in range(70)), " ".join(rng.choice("ab") for _ in range(40)), "a b a", "", None, "x " * 25]
    rows = [(i, " ".join(rng.choice(("a", "b", "x", "q", "P12 p13 p14 p15 p16 p17 p18 p19 p20 p21 p22")) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(100, items[0].upper()), (101, items[1] + " z " + items[1]), (102, "x " * 60)]
    tests = decontaminate.Tests([(str(k), t) for k, t in enumerate(items)], 10)
    words = decontaminate.W.Words([t.encode() for _, t in rows], decontaminate.W.ALNUM, True)
    found = list(decontaminate._documents(words, tests))
    for (_, text), (_, runs, _, longest, at) in zip(rows, found, strict=True):
        assert longest == brute_longest(text, items) and bool(runs) == (longest > 0)
        if longest:
            own = ALNUM.findall(text.translate(LOW))[at : at + longest]
            assert any(" ".join(own) in " ".join(ALNUM.findall((t or "").translate(LOW))) for t in items)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.longest_match, len(r.runs)) for r in decontaminate.decontaminate(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {i: (f[3], len(f[1])) for (i, _), f in zip(rows, found, strict=True)}


def test_suffixes_are_sorted():
    rng = random.Random(2)
    items = [" ".join(rng.choice("abc") for _ in range(50)) for _ in range(3)]
    texts = [" ".join(rng.choice("abcz") for _ in range(rng.randint(0, 120))) for _ in range(30)] + ["a " * 40]
    tests = decontaminate.Tests(list(enumerate(items)), 4)
    array = decontaminate.SuffixArray(decontaminate.W.Words([t.encode() for t in texts], decontaminate.W.ALNUM, True), tests)
    whole = [tuple(array.word[i : array.end[i]][: tests.longest]) for i in array.order.tolist()]
    assert whole == sorted(whole) and len(set(array.order.tolist())) == len(array.word) > 500


def test_repetitive_texts_stay_small():
    """One repeated word against itself: places and owners aren't multiplied."""
    import tracemalloc

    tests = decontaminate.Tests([("x", "long " * 3600), ("y", "long " * 3000)], 10)
    words = decontaminate.W.Words([b"long " * 30_000, b"short text", b"long " * 9], decontaminate.W.ALNUM, True)
    tracemalloc.start()
    (_, runs, items, longest, _), other, nine = decontaminate._documents(words, tests)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert runs == [{"s": 0, "e": 30_000}] and items == ["x", "y"] and longest == 3600 and not other[1] and not nine[1]
    assert peak < 60 << 20


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty(spark), none).count() == 0
    assert decontaminate.decontaminate(docs(spark), none).where("contaminated").count() == 0
