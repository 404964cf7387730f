"""Cases that the text operators once cut short."""

import numpy as np

from kinframe.llm import ngram_join, site_style


def test_near_copies_of_very_long_texts_survive():
    """Above 32 * 65,535 shingles the folded counts need more than 16 bits."""
    s = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 2_300_000, dtype=np.uint64))
    for share, linked in ((95, True), (60, False)):
        sets = [s, s[: len(s) * share // 100]]
        sizes = np.array([len(x) for x in sets])
        mask = ngram_join.survivors([ngram_join.vector_of(x) for x in sets], sizes, np.zeros(2, int), ngram_join.Threshold(4, 5))
        assert mask[0, 1] == mask[1, 0] == linked
    for dim in (32, 64):
        assert ngram_join.fold(ngram_join.vector_of(s), dim).sum(dtype=np.int64) == len(s)


def test_repeated_articles_keep_their_wrapped_prose(spark):
    """Variants of one article: nothing in it is new on any page, and all of it is kept."""
    story = "<div class='prose'><p>The very same story.</p><ul><li>one</li><li>two</li></ul></div>"
    rows = [(10 * i + k, f"http://{tag}.example/", f"<body><p>menu {i}</p><{tag}>{story}</{tag}></body>") for k, tag in enumerate(("article", "main")) for i in range(8)]
    got = site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 16 and {r.text for r in got} == {"The very same story. one two"}


def test_trees_lose_no_pair():
    """Every pair with the needed overlap survives, within one side and between two."""
    rng = np.random.default_rng(1)
    t = ngram_join.Threshold(4, 5)
    sets = []
    for _ in range(300):
        if sets and rng.random() < 0.6:
            b = sets[rng.integers(len(sets))]
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) < 0.93], rng.integers(0, 1 << 63, max(1, len(b) // 25), dtype=np.uint64)])))
        else:
            sets.append(np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64)))
    sizes = np.array([len(s) for s in sets])
    found = 0
    for side in (np.zeros(300, int), rng.integers(0, 2, 300)):
        mask = ngram_join.survivors([ngram_join.vector_of(s) for s in sets], sizes, side, t)
        assert (mask == mask.T).all() and not mask.diagonal().any()
        for i in range(300):
            for j in range(i):
                if side.any() and side[i] == side[j]:
                    assert not mask[i, j]
                elif len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= t.needed(int(sizes[i] + sizes[j])):
                    assert mask[i, j]
                    found += 1
    assert found > 200


def test_settings_of_the_session_stay(spark):
    """Batches are short while tables are written, and the session's setting is put back, after a failure too."""
    import pytest

    from kinframe.llm._work import PIECE_ROWS, put, short_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = put(spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "id", [b.num_rows]) for b in batches), "id long"), "sizes")
    assert max(r.id for r in sizes.collect()) == PIECE_ROWS and spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), short_batches(spark):
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before
