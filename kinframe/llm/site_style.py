"""Main text of web pages by site style trees.

*Site style tree.* The DOMs of a host's distinct pages are merged: elements with the
same chain of tags and classes are one node. A node's presentation importance is the
entropy of the child sequences it has across pages (base: pages that have it); its
content importance is one less the mean entropy of its text blocks over pages, so a
block found on every page counts 0 and one found once counts 1. Both move away from 1
only as far as the number of pages backs them (m / (m + 1) of the way, so one page
tells nothing and no least number of pages is needed). The composite importance of a
node mixes its presentation with its children's composites, as in the method's
published form, bottom up; its *share* is the mean part of a page's words that lies
in the branch, and the content node is the deepest unrepeated container that holds
more than half of the words of the one above it.

*What is cut* from a page, branch by branch from the top:

* elements that HTML or ARIA names as menus, footers, sidebars, forms, scripts and
  the like, and headers outside an article;
* containers whose branch has no composite importance of ``LOW`` (boxes that a host
  repeats), unless the content node itself has none, and not inside ``article`` or ``main``;
* branches beside the content whose share is below ``BESIDE`` of the content's. The
  content is the page's ``article`` and ``main`` elements, else the tree's content
  node, else one found on the page alone in the same way. Headings that repeat the
  page's title, and what holds one, are kept;
* class names are weak features. One whose head is telling ("cookie-notice", not
  "social-history") counts for a container with a small share outside ``article``, or
  with any share beside ``article`` and ``main`` elements; inside ``article``, only a whole
  telling name of a container with a small share does. Reader comments go by whole name.

Everything else is kept in page order. Shares and importances are those of the host's
tree, where it has the node, else of the page.

Blocks and child sequences are counted as hashes by grouped sums over (host, node), so
one host may hold any share of the pages; only the nodes that at least two pages of a
host share meet in one task (nodes of one page alone are counted per parent, so
generated class names don't add up). The trees are joined back by host; the join is a
broadcast while that table is below Spark's threshold.

Defined results: null or empty html, and pages without main text, give an empty
text; a null url is a host of its own; repeated rows are kept and count once as pages
of the style tree; unclosed elements, comments and cut-off markup are closed at the
end; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm._work import put, tidy, tidy_group

#: Weight of the children against the presentation in composites, per child.
GAMMA = 0.9
#: Branches with all composite importances below this are cut.
LOW = 0.2
#: Branches beside the content with less than this part of its share are cut unless they are the page's own text.
BESIDE = 0.4
#: Share of a page's words below which a telling name cuts a branch beside the content, or inside it.
NAMED, NAMED_INSIDE = 0.4, 0.2

# fixed values: element names by role
_BLOCKS = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video".split())
_CONTAINERS = frozenset("aside center details dir div dl fieldset figure form menu nav ol section table ul".split())
_WRAPPERS = frozenset("# html body article center div main section table tbody tr td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | frozenset("blockquote dd p pre".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noframes xmp".split())
_CUT = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noscript object script select style svg template textarea title video xmp noframes".split())
_CUT_ROLES = frozenset("alert alertdialog complementary contentinfo dialog form menu menubar navigation note search searchbox status tablist toolbar tooltip".split())
_CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer dropdown "
    "footer gdpr header lightbox login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related share sharing "
    "sidebar signin signup skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget widgets".split()
)
_SHELL_NAMES = frozenset("area bar block bottom box button buttons col column container content group inner item items left link links list outer panel right row section slot text top unit wrap wrapper".split())
_COMMENT_NAMES = frozenset("comment comments comment-list commentlist comments-area comment-section disqus disqus_thread respond responses".split())
_CLOSED_BY = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_MARK = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_UNQUOTED = re.compile(r"=[^\s\"']*/\s*$")  # a value that ends in a slash, not the slash of an empty element
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_FULL = (1 << 62) - 1
_MILLION = 1_000_000

# how an element is known
_GOES, _HEADER, _COMMENT, _NAMED, _TELLING = 1, 2, 4, 8, 16


def _head(name: str) -> str:
    """What a compound name says the element is: its last part that isn't about shape or place."""
    parts = [p.lower() for p in _NAMES.findall(name)]
    return next((p for p in reversed(parts) if p not in _SHELL_NAMES), "")


def _signature(tag: str, attributes: str) -> tuple[int, int]:
    """Hash of tag and classes, and how the element is known."""
    names: set[str] = set()
    known = _GOES if tag in _CUT else _HEADER if tag == "header" else 0
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                known |= _HEADER if value.lower() == "banner" else _GOES if value.lower() in _CUT_ROLES else 0
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                known |= _TELLING
            else:
                whole = value.lower().split()
                if name == "class":
                    names.update(whole)
                if tag not in ("html", "body", "main"):
                    known |= 0 if _COMMENT_NAMES.isdisjoint(whole) else _COMMENT
                    known |= 0 if _CUT_NAMES.isdisjoint(whole) else _NAMED
                    known |= _TELLING if any(_head(w) in _CUT_NAMES for w in value.split()) else 0
    return zlib.crc32(f"{tag} {' '.join(sorted(names))}".encode()), known


class Tree:
    """What a host's style tree tells of its containers: share and highest importance, and the content node."""

    _HEAD = struct.Struct("<qf")
    _ROW = struct.Struct("<qff")

    def __init__(self, packed: bytes | None = None) -> None:
        self.root, self.root_top, self.about = None, 1.0, {}
        if packed:
            self.root, self.root_top = self._HEAD.unpack_from(packed)
            self.about = {node: (share, top) for node, share, top in self._ROW.iter_unpack(packed[self._HEAD.size :])}

    @classmethod
    def pack(cls, root: int, root_top: float, rows: list[tuple[int, float, float]]) -> bytes:
        return cls._HEAD.pack(root, root_top) + b"".join(cls._ROW.pack(*r) for r in rows)


def content_node(top: int, children, share, unrepeated) -> int:
    """The deepest unrepeated wrapper that holds more than half of the one above it."""
    while True:
        best = max(children(top), key=share, default=None)
        if best is None or 2 * share(best) <= share(top) or not unrepeated(best):
            return top
        top = best


class Page:
    """A page as nodes and text blocks. Nodes: parent, tag, path, signature, how they are known."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.path, self.sign, self.known = [-1], ["#"], [17], [0], [0]
        self.gone = [False]  # by element or role, whatever the tree says
        self.article = [False]
        self.link = [False]  # within a link
        self.blocks: list[tuple[int, str]] = []  # node, text
        self.linked: list[int] = []  # words of each block that are in links
        self.title = ""
        stack, parts = [0], []
        seen: dict[tuple[str, str], tuple] = {}
        tags, gone, at, end = self.tag, self.gone, 0, len(html)

        in_links = 0

        def add(text: str) -> None:
            nonlocal in_links
            k = stack[-1]
            if not gone[k]:
                parts.append(text)
                if self.link[k]:
                    in_links += len(text.split())

        def flush() -> None:
            nonlocal in_links
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            linked, in_links = in_links, 0
            if text:
                self.linked.append(linked)
                self.blocks.append((next(k for k in reversed(stack) if k == 0 or tags[k] in _BLOCKS), text))

        def close(down_to: int) -> None:
            if any(tags[k] in _BLOCKS for k in stack[down_to:]):
                flush()
            del stack[down_to:]

        while at < end:
            mark = html.find("<", at)
            if mark < 0:
                add(html[at:])
                break
            if mark > at:
                add(html[at:mark])
            m = _MARK.match(html, mark)
            if not m:
                add("<")
                at = mark + 1
                continue
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                continue
            name = name.lower()
            if m.group(1) or m.group(4):
                block = name in _BLOCKS
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == name:
                        close(i)
                        break
                    if not block and tags[stack[i]] in _BLOCKS:
                        break
                continue
            if name == "br":
                if not gone[stack[-1]]:
                    parts.append(" ")
                continue
            if name in _BLOCKS:
                flush()
                for i in range(len(stack) - 1, 0, -1):  # ends that may be left out
                    open_tag = tags[stack[i]]
                    if open_tag == "p" or open_tag == name and name in _CLOSED_BY or {open_tag, name} == {"dt", "dd"} or {open_tag, name} == {"td", "th"}:
                        close(i)
                        if open_tag != "p":
                            break
                    elif open_tag in _BLOCKS and open_tag in _CLOSED_BY.get(name, ("div", "section", "article", "main", "body", "table", "td", "blockquote")):
                        break
            if name in _VOID:
                continue
            attributes = m.group(3) or m.group(6) or ""
            look = (name, attributes)
            if look not in seen:
                seen[look] = _signature(name, attributes)
            sign, known = seen[look]
            up = stack[-1]
            k = len(self.parent)
            self.parent.append(up)
            tags.append(name)
            self.sign.append(sign)
            self.known.append(known)
            self.path.append(((self.path[up] * 1000003) ^ sign) & _FULL)
            # an article's own header holds its title; the page's header doesn't
            gone.append(gone[up] or bool(known & _GOES or known & _HEADER and not self.article[up]))
            self.article.append(self.article[up] or name == "article")
            self.link.append(self.link[up] or name == "a")
            if name in _RAW:
                stop = re.compile(f"</{name}", re.I).search(html, at)
                if name == "title" and not self.title:
                    self.title = " ".join(unescape(html[at : stop.start() if stop else end]).split())
                at = stop.start() if stop else end
                if stop:
                    at = (html.find(">", at) + 1) or end
                continue
            if name in _BLOCKS or not attributes.rstrip().endswith("/") or _UNQUOTED.search(attributes):
                stack.append(k)
        close(1) if len(stack) > 1 else flush()
        if parts:
            flush()
        reader = [False] * len(self.parent)  # in a branch of reader comments, whose words don't count
        for k in range(1, len(reader)):
            reader[k] = reader[self.parent[k]] or bool(self.known[k] & _COMMENT)
        self.words = self._sums(0 if reader[k] else text.count(" ") + 1 for k, text in self.blocks)

    def _sums(self, counts) -> list[int]:
        """Sums over branches of a count per block."""
        out = [0] * len(self.parent)
        for (k, _), n in zip(self.blocks, counts, strict=True):
            out[k] += n
        for k in range(len(out) - 1, 0, -1):  # parents come before their children
            out[self.parent[k]] += out[k]
        return out

    def _content(self, tree: Tree) -> list[int]:
        """The nodes that hold the content."""
        named = [k for k, tag in enumerate(self.tag) if tag in ("article", "main") and self.words[k] and not self.gone[k]]
        if named:
            return named
        told = [k for k, path in enumerate(self.path) if path == tree.root and self.words[k] and not self.gone[k]]
        if told:
            return told
        below: dict[int, list[int]] = {}
        times: dict[int, int] = {}
        for k in range(1, len(self.parent)):
            times[self.path[k]] = times.get(self.path[k], 0) + 1
            if self.tag[k] in _WRAPPERS and self.words[k]:
                below.setdefault(self.parent[k], []).append(k)
        return [content_node(0, lambda k: below.get(k, ()), self.words.__getitem__, lambda k: times[self.path[k]] == 1)]

    def _own(self, content: list[int], above: list[bool], tree: Tree) -> list[bool]:
        """Branches that are the page's own text by what they hold or where they are, however short.

        They have prose outside links, or are in the branch that the headline shares with the
        content. On a page that has neither headline nor tree, all but lists of links are.
        """
        prose = self._sums(max(0, text.count(" ") + 1 - n) if self.tag[k] in _PROSE else 0 for (k, text), n in zip(self.blocks, self.linked, strict=True))
        plain = self._sums(max(0, text.count(" ") + 1 - n) for (_, text), n in zip(self.blocks, self.linked, strict=True))
        title = self.title.casefold()
        heads = [(text.casefold() not in title if title else self.tag[k] != "h1", i, k) for i, (k, text) in enumerate(self.blocks) if self.tag[k] in _HEADINGS]
        headline = min(heads)[2] if heads else None
        near = [False] * len(self.parent)
        k = headline
        while k is not None and k > 0 and not above[k] and k not in content:
            k = self.parent[k]
        if k and self.tag[k] not in ("html", "body"):
            near[k] = True
        alone = tree.root is None and headline is None
        for k in range(1, len(near)):
            near[k] |= near[self.parent[k]]
        return [near[k] or prose[k] > 0 or alone and plain[k] > 0 for k in range(len(near))]

    def text(self, tree: Tree) -> str:
        """The blocks that aren't cut, joined by one space."""
        if not self.blocks:
            return ""
        total = max(1, self.words[0])
        content = self._content(tree)
        inside, above = [False] * len(self.parent), [False] * len(self.parent)
        for k in content:
            inside[k] = True
            while k >= 0 and not above[k]:
                above[k] = True
                k = self.parent[k]
        share = lambda k: tree.about[self.path[k]][0] if self.path[k] in tree.about else self.words[k] / total
        whole = max(share(k) for k in content)
        by_element = self.tag[content[0]] in ("article", "main")
        title = self.title.casefold()
        titles = [0] * len(self.parent)  # headings in the branch that repeat the title
        for k, text in self.blocks:
            if self.tag[k] in _HEADINGS and text.casefold() in title:
                titles[k] += 1
        for k in range(len(titles) - 1, 0, -1):
            titles[self.parent[k]] += titles[k]
        own = self._own(content, above, tree)
        cut = [False] * len(self.parent)
        prose = [False] * len(self.parent)
        for k in range(1, len(self.parent)):
            up, tag, known = self.parent[k], self.tag[k], self.known[k]
            inside[k] |= inside[up]
            prose[k] = prose[up] or tag in ("article", "main")
            if cut[up] or not self.words[k] and tag not in _BLOCKS:
                cut[k] = cut[up]
                continue
            container = tag in _CONTAINERS
            if known & _COMMENT and not above[k]:
                cut[k] = True
            elif above[k]:
                continue
            elif inside[k]:
                low = container and not prose[k] and tree.root_top >= LOW and tree.about.get(self.path[k], (0, 1))[1] < LOW
                named = known & _NAMED and share(k) < NAMED_INSIDE if self.article[k] else known & _TELLING and share(k) < NAMED
                cut[k] = low or container and bool(named)
            elif above[up] and tag not in _HEADINGS and not titles[k] or container:
                low = container and tree.about.get(self.path[k], (0, 1))[1] < LOW
                aside = not titles[k] and share(k) < BESIDE * whole and (above[up] and tag in _BLOCKS) and (by_element or not own[k])
                cut[k] = low or aside or container and bool(known & _TELLING) and (by_element or share(k) < NAMED)
        return " ".join(text for k, text in self.blocks if not cut[k])

    def facts(self) -> list[tuple[int, int, int, int, int, int, bool]]:
        """(node, parent node, role, hash of child sequences or text, share, instances, whether it is text).

        One row for each node of the page, and one for each of its distinct texts.
        """
        total = max(1, self.words[0])
        children: dict[int, list[int]] = {}
        up_of: dict[int, int] = {0: 0}
        for k in range(1, len(self.parent)):
            if self.gone[k]:
                continue
            up = self.parent[k]
            up_of[k] = k if self.tag[k] in _BLOCKS else up_of[up]
            if up_of[k] == k:
                seq = children.setdefault(up_of[up], [])
                if not seq or seq[-1] != self.sign[k]:
                    seq.append(self.sign[k])
        nodes: dict[int, list[int]] = {}
        for k, at in up_of.items():
            if k == at and k:
                role = 1 if self.tag[k] in _WRAPPERS else 2 if self.tag[k] in _CONTAINERS else 0
                row = nodes.setdefault(self.path[k], [self.path[up_of[self.parent[k]]], role, 0, 0, 0])
                for s in (*children.get(k, ()), 1):
                    row[2] = ((row[2] * 1000003) ^ s) & _FULL
                row[3] += self.words[k]
                row[4] += 1
        out = [(node, up, role, style, words * _MILLION // total, times, False) for node, (up, role, style, words, times) in nodes.items()]
        texts = {(self.path[k], self.path[up_of[self.parent[k]]], int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "little")) for k, text in self.blocks if k}
        return out + [(node, up, nodes[node][1], value, 0, 0, True) for node, up, value in texts]


def _composites(rows: list[tuple[int, int, int, float, float | None]], single: dict[int, int] | None = None) -> dict[int, tuple[float, float]]:
    """Composite importance of each node, and the highest one in its branch.

    Rows: node, parent, pages, presentation, content. ``single``: children of a node
    that are on one page alone, of importance 1.
    """
    below: dict[int, list[int]] = {}
    about = {r[0]: r for r in rows}
    for node, parent, *_ in rows:
        if parent in about:
            below.setdefault(parent, []).append(node)
    out: dict[int, tuple[float, float]] = {}
    todo = [r[0] for r in rows if r[1] not in about]
    order = []
    while todo:
        node = todo.pop()
        order.append(node)
        todo += below.get(node, ())
    for node in reversed(order):
        _, _, _, presentation, content = about[node]
        own = [] if content is None else [content]
        children = [out[c] for c in below.get(node, ())] + [(1.0, 1.0)] * (single or {}).get(node, 0)
        value = own[0] if own else 0.0
        if children:
            parts = [c for c, _ in children] + own
            g = GAMMA ** len(parts)
            value = (1 - g) * presentation + g * sum(parts) / len(parts)
        out[node] = value, max([value, *own, *(top for _, top in children)])
    return out


def backed(entropy: float, pages: int) -> float:
    """One less an entropy, as far as so many pages back it."""
    return 1 - (1 - entropy) * pages / (pages + 1)


def _judged(rows: list[tuple], single: dict[int, int]) -> bytes | None:
    """A host's tree, packed. Rows: node, parent, role, pages, presentation, content, share, instances."""
    if not rows:
        return None
    value = _composites([(n, up, m, backed(p, m), None if c is None else backed(c, m)) for n, up, _, m, p, c, _, _ in rows], single)
    about = {r[0]: r for r in rows}
    below: dict[int, list[int]] = {}
    for r in rows:
        if r[2] == 1:
            below.setdefault(r[1] if r[1] in about else 17, []).append(r[0])
    held = lambda n: about[n][6] if n in about else max((about[c][6] for c in below.get(17, ())), default=0)
    root = content_node(17, lambda n: below.get(n, ()), held, lambda n: about[n][7] <= about[n][3] * 1.05)
    rows = [(n, share / m / _MILLION, value[n][1]) for n, _, role, m, _, _, share, _ in rows if role]
    return Tree.pack(root, value[root][1] if root in value else 1.0, rows)


def style_trees(pages: DataFrame) -> DataFrame:
    """host, tree (packed): the style tree of each host that has two alike pages at least. Pages: host, digest, html."""
    import pyarrow as pa

    names = ["host", "digest", "node", "parent", "role", "value", "share", "instances", "is_text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, digest, *fact) for host, digest, html in zip(*(c.to_pylist() for c in batch.columns), strict=True) for fact in Page(html or "").facts()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def judge(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("node", "parent", "role", "pages", "presentation", "content", "share", "instances")), strict=True))
        single = {r[1]: r[3] for r in rows if r[0] is None}
        tree = _judged(sorted(r for r in rows if r[0] is not None), single)
        return pa.table({"host": [group.column("host")[0].as_py()], "tree": pa.array([tree], pa.binary())})

    found = pages.select("host", "digest", "html").mapInArrow(tidy(facts), "host string, digest long, node long, parent long, role int, value long, share long, instances long, is_text boolean")
    # one count per distinct page, so that copies of a page don't make it look like a template
    found = found.distinct().groupBy("host", "node", "parent", "role", "is_text", "value").agg(F.count("*").alias("count"), F.sum("share").alias("share"), F.sum("instances").alias("instances"))
    c = F.col("count").cast("double")
    nodes = found.groupBy("host", "node", "parent", "role").agg(
        F.sum(F.when(~F.col("is_text"), F.col("count"))).alias("pages"),
        F.sum(F.when(~F.col("is_text"), c * F.ln(c))).alias("clnc"),
        F.sum(F.when(F.col("is_text"), F.ln(c))).alias("text_ln"),
        F.count_if("is_text").alias("texts"),
        F.sum("share").alias("share"),
        F.sum("instances").alias("instances"),
    )
    nodes = put(nodes, "nodes")
    several = nodes.where("pages > 1").select(
        "host", "node", "parent", "role", "pages",
        ((F.ln("pages") - F.col("clnc") / F.col("pages")) / F.ln("pages")).alias("presentation"),
        F.when(F.col("texts") > 0, 1 - F.col("text_ln") / (F.col("texts") * F.ln("pages"))).alias("content"),
        "share", "instances",
    )
    alone = nodes.where("pages = 1").groupBy("host", "parent").agg(F.count("*").alias("pages"))
    alone = alone.join(several.select("host", F.col("node").alias("parent")), ["host", "parent"], "left_semi")
    return several.unionByName(alone, allowMissingColumns=True).groupBy("host").applyInArrow(tidy_group(judge), "host string, tree binary")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", use_trees: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page. Without ``use_trees`` each page is judged alone."""
    import pyarrow as pa
    from pyspark.sql import types as T

    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), F.coalesce(host, F.lit("")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Tree] = {}  # hosts met in a task; a tree holds the host's templates alone
        for batch in batches:
            texts = []
            for html, host, packed in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if host not in trees:
                    if len(trees) > 1000:
                        trees.clear()
                    trees[host] = Tree(packed)
                texts.append(Page(html or "").text(trees[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if use_trees:
        trees = put(style_trees(own.withColumn("digest", F.xxhash64("html"))), "trees")
        joined = own.join(trees, "host", "left").select("page_id", "url", "html", "host", "tree")
    else:
        joined = own.withColumn("tree", F.lit(None).cast("binary"))
    return joined.mapInArrow(tidy(run), T.StructType([*joined.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
