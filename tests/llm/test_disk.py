"""What the near-duplicate join ships: no texts of documents that stay, and no pairs of all members of a chain."""

import random

from kinframe.llm import ngram_join

from .test_overlap import jaccard

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(8))


def shuffled(spark):
    """Bytes written to shuffles since the session began."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, *(getattr(store, f"stageList$default${k}")() for k in range(2, 6)))
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_stay_where_they_are(spark):
    import corpus_pipeline as C

    rng = random.Random(8)
    texts = [" ".join(word(rng) for _ in range(700)) for _ in range(150)]
    data = [(i, t, "en", "s", t and len(t)) for i, t in enumerate([*texts, *texts[:4], texts[5] + " end", None])] + [(None, texts[9], "en", "s", 1)] * 2 + [(3, texts[3], "en", "s", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).localCheckpoint()
    before = shuffled(spark)
    left = [r.doc_id for r in C.near_duplicates(spark, docs, "").collect()]
    assert sorted(left, key=repr) == sorted([*range(150), 155, None], key=repr)
    assert shuffled(spark) - before < 1.5 * sum(map(len, texts))


def test_chain_of_chance_shingles(spark, monkeypatch):
    """Sets that share some shingles with the next one connect all documents, and no two are linked."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(12)
    chain = [[word(rng) for _ in range(15)] for _ in range(301)]
    rows = [(i, " ".join([*chain[i], *chain[i + 1], *(word(rng) for _ in range(10))])) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(0, 300, 25)]
    held, join = [], ngram_join._join
    monkeypatch.setattr(ngram_join, "_join", lambda tasks, *a: held.append(tasks.count()) or join(tasks, *a))
    got = ngram_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == jaccard(rows, 1, 80, 100)
    assert sum(held) < 6 * len(rows)
