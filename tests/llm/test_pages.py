"""Main text (op 1) and WARC archives (op 5)."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from kinframe.llm import site_style, warc

ROWS = [
    (1, "http://a.example/x", "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Title</h1><p>One &amp; two<br>three <b>bo</b>ld<p>Four</article><footer>f</footer>"),
    (2, "http://a.example/y", None),
    (3, None, "plain text, no markup < 5"),
    (4, "http://b.example/", ""),
    (1, "http://a.example/x", "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Title</h1><p>One &amp; two<br>three <b>bo</b>ld<p>Four</article><footer>f</footer>"),
    (None, "http://c.example/", "<p>lonely"),
    (5, "http://b.example/z", "<main><header>head</header><p>Main <i>text</i></p><div class='cookie-notice'>no</div><form>f</form></main><aside>side</aside>"),
    (6, "http://b.example/é ü", "<div>" * 3000 + "deep" + "<p>"),
    (7, "http://b.example/c", "<article>body<section class='comments'><article>reader</article></section><!-- c --><script>if (a<b) {'</p>'}</script> end</article>"),
    (8, "http://b.example/d", "<p>cut <a href='x"),
]
TEXTS = {1: "Title One & two three bold Four", 2: "", 3: "plain text, no markup < 5", 4: "", None: "lonely", 5: "Main text", 6: "deep", 7: "body end", 8: "cut"}


def pages(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("x") for c in ("host", "digest", "low", "text", "n_chars", "refers_to", "again", "n")})


def test_main_text(spark):
    got = site_style.main_text(pages(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.text == TEXTS[r.page_id] and r.n_chars == len(r.text)
    assert site_style.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_low_branches_are_cut_and_articles_kept(spark):
    """A box that a host repeats on all its pages goes, without a telling name; prose stays."""
    rows = [(i, f"http://same.example/{i}", f"<body><div class='zone7'><p>Call us now</p><p>Open daily</p></div><div class='core'><h2>Story {i}</h2><p>Unique words {i} here.</p></div></body>") for i in range(12)]
    rows += [(20 + i, "http://other.example/", "<article><p>The very same article on every page.</p></article>") for i in range(12)]
    got = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} Unique words {i} here." for i in range(12))
    assert all(got[20 + i] == "The very same article on every page." for i in range(12))


def test_composites():
    # a parent of two leaves, one found on every page (0), one always new (1)
    got = site_style._composites([(1, 0, 9, 0.0, None), (2, 1, 9, 0.0, 0.0), (3, 1, 9, 0.0, 1.0)])
    assert got[2] == (0, 0) and got[3] == (1, 1) and got[1] == (pytest.approx(0.81 * 0.5), 1)


def test_a_wrapper_of_boxes_keeps_its_one_story(spark):
    """A branch is cut only if nothing in it matters, however many boxes surround the story."""
    boxes = "".join(f"<div class='box{k}x'><p>Fixed text {w}</p></div>" for k, w in enumerate("abcdefghij"))
    rows = [(i, f"http://boxed.example/{i}", f"<body><div class='page'>{boxes}<div class='core'><p>Story number {i} only.</p></div></div></body>") for i in range(12)]
    got = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i} only." for i in range(12))


@pytest.mark.parametrize(("least", "size"), [(0, 1 << 20), (20, 300)])
def test_warc(spark, least, size):
    base = warc.write_warc(pages(spark), min_payload_bytes=least, archive_bytes=size)
    got = warc.read_warc(spark, base, keep_html=True).collect()
    raw = {i: (h or "").encode() for i, _, h in ROWS}
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            p = (h or "").encode()
            first[p] = min(first.get(p, i), i)
    want = []
    for i, u, _ in ROWS:
        p = raw[i]
        refers = first[p] if i is not None and len(p) >= least and first[p] != i else None
        want.append((i, u, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.html == raw[r.page_id].decode() for r in got if r.record_type == "response")
    some = warc.read_warc(spark, base, warc.read_index(spark, base).where("page_id IN (3, 5)")).collect()
    assert {r.page_id for r in some} == {3, 5}
    none = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_warc(spark, none).count() == 0


def test_records_can_be_followed(spark):
    """Record ids are distinct, and a revisit names its response's id."""
    import gzip

    from pyarrow import fs

    rows = [(1, "http://a.example/", "same"), (2, "http://b.example/", "same"), (3, "http://c.example/", "x" * 3_000_000), (4, None, "twice"), (4, None, "twice"), (5, "u", "twice"), (None, None, "same")]
    base = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    store, folder = fs.FileSystem.from_uri(base)
    ids, refers, infos = [], {}, 0
    for found in store.get_file_info(fs.FileSelector(folder)):
        if found.path.endswith(".warc.gz"):
            raw = gzip.decompress(store.open_input_file(found.path).read())
            while raw:
                head, _, rest = raw.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
                size = int(fields["Content-Length"])
                assert fields["WARC-Block-Digest"] == "sha1:" + warc.digest32(rest[:size])
                assert rest[size : size + 4] == b"\r\n\r\n"
                infos += fields["WARC-Type"] == "warcinfo"
                ids.append(fields["WARC-Record-ID"])
                refers[fields.get("X-Page-ID")] = fields.get("WARC-Refers-To"), fields["WARC-Record-ID"]
                raw = rest[size + 4 :]
    assert len(ids) == len(set(ids)) == len(rows) + infos
    assert refers["2"][0] == refers["1"][1]
    assert refers["5"][0] is None  # two equal rows are responses
    got = {r.page_id: r for r in warc.read_warc(spark, base).collect()}
    assert got[2].refers_to == 1 and got[5].refers_to == 4 and got[3].payload_bytes == 3_000_000 and got[None].record_type == "response"


def test_one_page_id_with_many_payloads(spark):
    """40,000 rows of one id, each payload twice: linear, and every second is a revisit of that id's equals."""
    import time

    df = spark.range(40_000).selectExpr("if(id % 4 = 0, 6, 7) AS page_id", "'http://x.example/' AS url", "concat('<p>', cast(id % 20000 AS string)) AS html")
    began = time.perf_counter()
    got = warc.read_warc(spark, warc.write_warc(df)).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert time.perf_counter() - began < 60
    # payloads of ids 0, 4, 8, ... belong to page 6 on both rows, the others to page 7, so nothing refers to a smaller id
    assert {(r.page_id, r.record_type, r.refers_to): r["count"] for r in got} == {(6, "response", None): 10_000, (7, "response", None): 30_000}
    mixed = spark.range(3000).selectExpr("if(id < 1500, 1, 2) AS page_id", "'http://x.example/' AS url", "concat('<p>', cast(id % 1500 AS string)) AS html")
    got = warc.read_warc(spark, warc.write_warc(mixed)).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert {(r.page_id, r.record_type, r.refers_to): r["count"] for r in got} == {(1, "response", None): 1500, (2, "revisit", 1): 1500}


def test_ranges_are_coalesced():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (100, 5), (1000, 5)], gap=90, most=120) == [(0, 105, 3), (1000, 5, 1)]


def told(spark, rows):
    return {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_nothing_of_the_article_goes_by_a_name(spark):
    rows = [
        (1, "http://one.example/", "<article><p>Long enough a story.</p><div class='social-history'><p>The social history.</p></div><p class='ad'>An ad, discussed.</p><p class='tags'>Tags too.</p></article>"),
        (2, "http://two.example/", "<body><div class='widget-page'><p>All the words.</p></div></body>"),
        (3, "http://three.example/", "<title>Title | site</title><body><h1>Title</h1><article><p>Words of it, and some more of them.</p></article><div class='x'><p>See also</p></div></body>"),
        (4, "http://four.example/", "<body><main><p>Words of main.</p></main><article><p>Words of the article.</p></article></body>"),
        (5, "http://five.example/", "<article><header><h1>Own title</h1></header><p>Words.</p><aside>side</aside><footer>foot</footer></article><header>site</header>"),
        (6, "http://six.example/", "<body><div class='sidebar'><p>few words</p></div><div><p>The story has many more words than that, and it stays whole.</p></div><section id='comments'>"
            + "<p>readers say much</p>" * 30 + "</section></body>"),
    ]
    assert told(spark, rows) == {
        1: "Long enough a story. The social history. An ad, discussed. Tags too.", 2: "All the words.", 3: "Title Words of it, and some more of them.", 4: "Words of main. Words of the article.",
        5: "Own title Words.", 6: "The story has many more words than that, and it stays whole.",
    }


def opaque_site(n, host="plain.example"):
    """Pages without a telling element or name; every text differs, and some stories are shorter than the advert."""
    rows = []
    for i in range(n):
        story = " ".join(f"<p>Sentence {i} {k} of the story goes on.</p>" for k in range(1 if i % 4 == 0 else 12))
        rows.append((i, f"http://{host}/{i}", f"<body><div class='a1'><ul><li><a href='/'>go{i}</a></li><li><a href='/'>see{i}</a></li></ul></div><div class='a2'>Buy thing {i} now, thing {i + 1} is cheap as well.</div>"
                     f"<div class='a3'><h1>Story {i}</h1>{story}</div><div class='a4'>&copy; {i} people of the site {i}</div></body>"))
    return rows


def test_the_tree_finds_the_content_of_opaque_pages(spark):
    rows = opaque_site(24)
    want = {i: " ".join([f"Story {i}"] + [f"Sentence {i} {k} of the story goes on." for k in range(1 if i % 4 == 0 else 12)]) for i in range(24)}
    assert told(spark, rows) == want
    alone = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), use_trees=False).collect()}
    assert alone != want  # short pages need what the tree knows
    assert all(alone[i] == want[i] for i in range(24) if i % 4)


def test_short_parts_of_the_story_stay(spark):
    """Leads, second sections, standfirsts and closing paragraphs are kept whatever their share, by the tree and without."""
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(120))
    host = [(i, f"http://lead.example/{i}", f"<div class=a><h1>Head {i}</h1><p>LEAD {i} of the story.</p><div class=b>{body(i)}</div><div class=c><h2>More {i}</h2><p>SECOND {i} section.</p></div></div>") for i in range(20)]
    alone = [
        (100, "http://one.example/", f"<body><p>Standfirst in short.</p><div class=x>{body(1)}</div></body>"),
        (101, "http://two.example/", f"<body><div class=x>{body(2)}</div><p>Closing words.</p></body>"),
        (102, "http://three.example/", f"<body><div class=x><p>{body(3)}</p></div><div class=y><p>The shorter section.</p></div></body>"),
        (103, "http://four.example/", f"<body><div class=s>A standfirst in a box.</div><div class=x>{body(4)}</div><div class=l><a href=/>one</a> <a href=/>two</a></div></body>"),
    ]
    want = {i: f"Head {i} LEAD {i} of the story. {body(i)} More {i} SECOND {i} section." for i in range(20)}
    want |= {100: f"Standfirst in short. {body(1)}", 101: f"{body(2)} Closing words.", 102: f"{body(3)} The shorter section.", 103: f"A standfirst in a box. {body(4)}"}
    assert told(spark, host + alone) == want
    df = spark.createDataFrame(host + alone, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_style.main_text(df, use_trees=False).collect()} == want


def test_generated_sites(spark):
    """Sites of many parts: boxes that a host repeats go, every text of a page's own stays, in order."""
    import random

    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice("amber birch cedar dune ember frost grove heath iris juniper kelp lark moss".split()) + str(rng.randrange(10**6)) for _ in range(n))
    rows, want, without = [], {}, 0
    for site in range(6):
        boxes = [f"<div class='q{rng.randrange(9)}'><p>{words(rng.randint(2, 25))}</p></div>" for _ in range(rng.randint(1, 3))]
        wrap = rng.choice(["<div class='k1'>{}</div>", "<div class='k1'><div class='k2'>{}</div></div>", "{}"])
        before = rng.randint(0, len(boxes))
        for i in range(14):
            parts, told_parts = [], []
            head = words(4)
            for part in range(rng.randint(1, 5)):
                text = words(rng.choice([3, 12, 90]))
                told_parts.append(text)
                parts.append(rng.choice(["<p>{}</p>", "<div class='s{n}'><p>{}</p></div>", "<section><p>{}</p></section>", "<blockquote>{}</blockquote>"]).replace("{n}", str(part)).format(text))
            page = 100 * site + i
            want[page] = " ".join([head, *told_parts])
            story = wrap.format(f"<h1>{head}</h1>" + "".join(parts))
            rows.append((page, f"http://site{site}.example/{i}", f"<title>{head}</title><body>{''.join(boxes[:before])}{story}{''.join(boxes[before:])}</body>"))
    assert told(spark, rows) == want
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    without = sum(r.text != want[r.page_id] for r in site_style.main_text(df, use_trees=False).collect())
    assert without > len(rows) / 2  # the boxes are known by the trees alone


def test_importances_by_brute_force(spark):
    """Entropies, shares and the content node, worked out page by page."""
    import math
    from collections import Counter

    rows = opaque_site(9) + [(90, "http://plain.example/x", "<body><div class='a2'>Buy thing 1 now, thing 2 is cheap as well.</div><div class='a9'>once</div></body>")]
    df = spark.createDataFrame(rows, "page_id long, host string, html string").selectExpr("'h' AS host", "page_id AS digest", "html")
    (got,) = site_style.style_trees(df).collect()
    tree = site_style.Tree(bytes(got.tree))
    pages = [site_style.Page(h) for _, _, h in rows]
    path = {t: next(p.path[k] for p in pages for k in range(len(p.path)) if p.sign[k] == site_style._signature("div", f" class='{t}'")[0]) for t in ("a1", "a2", "a3", "a4", "a9")}
    assert tree.root == path["a3"]
    have = [p for p in pages if path["a2"] in p.path]
    m = len(have)
    assert m == 10
    share = sum(p.words[p.path.index(path["a2"])] / p.words[0] for p in have) / m
    texts = Counter(t for p in have for k, t in p.blocks if p.path[k] == path["a2"])
    content = 1 - sum(math.log(c) / math.log(m) for c in texts.values()) / len(texts)
    content = 1 - (1 - content) * m / (m + 1)
    assert tree.about[path["a2"]] == (pytest.approx(share, abs=1e-5), pytest.approx(content))
    assert path["a9"] not in tree.about  # on one page alone
    body = next(p.path[k] for p in pages for k in range(len(p.path)) if p.tag[k] == "body")
    assert tree.about[body][0] == pytest.approx(1)


def test_very_long_pages_and_many_hosts(spark):
    rows = [(1, "http://long.example/", "<body>" + "<p>word word</p>" * 40_000 + "</body>"), (2, "http://long.example/2", "<nav>x</nav>" * 3 + "<p>one</p>")]
    got = told(spark, rows)
    assert got[1] == " ".join(["word word"] * 40_000) and got[2] == "one"
