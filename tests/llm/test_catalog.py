"""The registered queries on the smallest tables, and the pipeline's stages on awkward rows."""

import base64
import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kinframe.llm import catalog, pii

from .helpers import AWKWARD, sha
from .test_overlap import ALNUM, LOW, jaccard, removed

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name, *columns):
    return sorted((tuple(r) for r in catalog.queries()[name](spark, SF).select(*columns).collect()), key=repr)


def told(values):
    return sorted(values, key=repr)


def test_op1(spark):
    """The article of each page, by an expression for the tables' own markup."""
    import html as H

    want = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html or "", re.S).group(1)
        text = " ".join(H.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "", re.sub(r"<(?:br|/?p|/?h1)[^>]*>", " ", inside))).split())
        want.append((r.page_id, r.url, text, len(text)))
    assert rows(spark, "op1_site_style", "page_id", "url", "text", "n_chars") == told(want)


def test_op2(spark, documents):
    got = rows(spark, "op2_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    want = {}
    for d, t in documents:
        base = pii.base_spans(t or "")
        want[d] = (*(sum(k == x for k, _, _ in base) for x in pii.BASE), sha(pii.told(base)), {pii.told([s]) for s in base})
    assert len(got) == len(documents)
    for d, *counts, digest, spans in got:
        assert (*counts, digest) == want[d][:5] and want[d][5] <= set(spans.split(","))


def test_op3_and_op9(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(catalog.VOCABULARY)
    library.no_truncation()
    library.no_padding()
    at, stored, coded = 0, [], []
    for d, t in sorted(documents):
        ids = library.encode(t or "", add_special_tokens=False).ids
        coded.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
        stored.append((d, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        at += len(ids) + 1
    assert rows(spark, "op3_token_store", "doc_id", "start", "n_tokens", "ids_crc32") == told(stored)
    assert rows(spark, "op9_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == told(coded)


def test_op4(spark, documents):
    assert rows(spark, "op4_ngram_join", "doc_id", "n_shingles", "component_id") == jaccard(documents, 3, 90, 100)


def test_op5(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    first = {}
    for i, p in pages:
        first[p] = min(i, first.get(p, i))
    want = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in pages]
    assert rows(spark, "op5_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == told(want)


def test_op6(spark, documents):
    assert rows(spark, "op6_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == removed(documents, 50)


def test_op7(spark):
    vectors = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, y in vectors if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in vectors}
    links = {i: [j for j in unit if j != i and label[j] == label[i] and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.98] for i in unit}
    least = {i: i for i, _, _ in vectors}
    for _ in vectors:
        least = {i: min([least[i], *(least[j] for j in links.get(i, ()))]) for i in least}
    assert rows(spark, "op7_embedding_dedup", "vec_id", "n_links", "component_id", "kept") == told((i, len(links.get(i, ())), least[i], least[i] == i) for i, _, _ in vectors)


def test_op8(spark, documents):
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM.findall((r.text or "").translate(LOW))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(r.item_id))
    want = []
    for d, t in documents:
        w, hit, items = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                found = windows.get(tuple(w[j : j + n]))
                if found:
                    hit.update(range(j, j + n))
                    items |= found
        want.append((d, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    assert rows(spark, "op8_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == told(want)


def test_op10(spark, documents):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = rows(spark, "op10_quality", "doc_id", "held_out", "score", "predicted")
    assert [d for d, *_ in got] == [d for d, _ in told(documents)]
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.3) for d, h, s, p in got)
    held = [(s, quality[d]) for d, h, s, _ in got if h and quality.get(d) is not None]
    assert held and sum((s >= 0.3) == (q == 1) for s, q in held) / len(held) > 0.9


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty, very long and repeated texts, clashing columns, and no rows at all."""
    from pyspark.sql import functions as F

    import corpus_pipeline as C

    data = [(i, t, None if i == 6 else "en", None if i == 7 else "s", None if t is None else len(t)) for i, t in AWKWARD]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.withColumns({c: F.lit("x") for c in ("score", "predicted", "held_out", "component_id", "text_md5", "items", "runs", "contaminated", "redacted", "spans", "ids", "n", "cls", "id", "md5")})
    texts = sorted(repr((i, t)) for i, t in AWKWARD)
    for name, stage in C.STAGES:
        got = stage(spark, wide, SF)
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name == "bpe":
            assert got.count() == len(AWKWARD)
            continue
        assert got.columns == C.COLUMNS
        left = sorted(repr((r.doc_id, r.text)) for r in got.collect())
        if name == "pii":
            assert left == sorted(repr((i, t or "")) for i, t in AWKWARD)
        elif name == "near_duplicates":  # 5 equals 1, and is there twice
            assert left == sorted(set(texts) - {repr(AWKWARD[4])})
        elif name == "decontamination":
            assert left == texts
        else:
            assert set(left) <= set(texts)
