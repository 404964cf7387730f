"""Graph payloads: JSON files, payloads embedded in HTML, legends, known keys; and sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.operators.outline import node_key
from kinframe.sources.lines import read_text

NODE = "struct<id:bigint,name:string,gen:int,birth:int,death:int,cat:string,titles:string,country:string,region:string,house:string,mult:bigint>"
GRAPH = f"struct<nodes:array<{NODE}>,edges:array<struct<s:bigint,t:bigint>>>"
LEGEND = "array<struct<key:string,label:string,color:string>>"
META = "struct<title:string,subtitle:string>"
PAYLOAD = r'(?s)const GRAPH\s*=\s*(\{"nodes".*?\});'


def payload(html: Column) -> Column:
    """The JSON text of the graph embedded in a page; empty if there is none."""
    return F.regexp_extract(html, PAYLOAD, 1)


def graph_of(source: Column) -> Column:
    """The graph struct of JSON text; absent fields are null."""
    return F.from_json(source, GRAPH)


def read_graphs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(src, graph) of JSON files or pages, by what they hold."""
    return graphs_in(read_text(spark, paths))


def graphs_in(files: DataFrame) -> DataFrame:
    """(src, graph) of files (src, value) of either kind."""
    found = F.when(F.ltrim("value").startswith("{"), F.col("value")).otherwise(payload(F.col("value")))
    return files.select("src", graph_of(found).alias("graph")).where("graph IS NOT NULL")


def nodes_of(graphs: DataFrame) -> DataFrame:
    """Nodes with defaults for what older files lack."""
    rows = graphs.select("src", F.inline("graph.nodes"))
    empty = {c: F.coalesce(c, F.lit("")) for c in ("titles", "country", "region", "house")}
    return rows.withColumns(empty | {"cat": F.coalesce("cat", F.lit("untitled")), "mult": F.coalesce("mult", F.lit(1)), "gen": F.coalesce("gen", F.lit(0))})


def edges_of(graphs: DataFrame) -> DataFrame:
    return graphs.select("src", F.inline("graph.edges"))


def legend_of(html: Column) -> Column:
    return F.from_json(F.regexp_extract(html, r"(?s)const LEGEND\s*=\s*(\[.*?\]);", 1), LEGEND)


def meta_of(html: Column) -> Column:
    return F.from_json(F.regexp_extract(html, r"(?s)const META\s*=\s*(\{.*?\});", 1), META)


def known_keys(graphs: DataFrame) -> DataFrame:
    """Keys of all people of the given graphs; placeholders skipped."""
    key = node_key(F.col("name"), F.col("birth"), F.col("id"))
    return nodes_of(graphs).select(key.alias("key")).where(~F.col("key").startswith("_u")).distinct()


# ---- sinks ------------------------------------------------------------------


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two Parquet tables: the scalable form."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def graph_json(nodes: DataFrame, edges: DataFrame) -> str:
    """One JSON text of a graph, for viewers; the graph must fit the driver."""
    kept = [c for c in ("id", "name", "gen", "birth", "death", "cat", "titles", "country", "region", "house", "mult") if c in nodes.columns]
    rows = [r.asDict() for r in nodes.select(kept).orderBy("id").collect()]
    links = [r.asDict() for r in edges.select("s", "t").orderBy("s", "t").collect()]
    return json.dumps({"nodes": rows, "edges": links}, ensure_ascii=False)


def splice(page: str, graph: str, legend: list | None = None, title: str | None = None, subtitle: str | None = None) -> str:
    """A page with its embedded graph (and legend and meta) replaced; a new text, never in place."""
    import re

    def put(text: str, pattern: str, value: str) -> str:
        found = re.search(pattern, text, re.S)
        return text if not found else text[: found.start(1)] + value + text[found.end(1) :]

    out = put(page, r'const GRAPH\s*=\s*(\{"nodes".*?\});', graph)
    if legend is not None:
        out = put(out, r"const LEGEND\s*=\s*(\[.*?\]);", json.dumps(legend, ensure_ascii=False))
    if title is not None:
        out = put(out, r"const META\s*=\s*(\{.*?\});", json.dumps({"title": title, "subtitle": subtitle or ""}, ensure_ascii=False))
    return out


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def render(template: str, graph: str, legend: list, title: str, subtitle: str, library: str = "") -> str:
    """A template with its marks filled: data, legend, title, subtitle, drawing library."""
    filled = {"/*__DATA__*/": graph, "/*__LEGEND__*/": json.dumps(legend, ensure_ascii=False), "/*__D3__*/": library, "__TITLE__": escape(title), "__SUBTITLE__": escape(subtitle)}
    for mark, value in filled.items():
        template = template.replace(mark, value)
    return template


def write_pages(pages: DataFrame, path: str, slug: str = "slug", html: str = "html") -> None:
    """One text file per group, written by the executors: folders slug=..."""
    pages.select(slug, html).write.mode("overwrite").partitionBy(slug).text(path)


def house_pages(stats: DataFrame, members: DataFrame, intro: DataFrame | None = None) -> DataFrame:
    """(slug, html) of each house, made by expressions alone.

    ``intro`` (house, intro) is what stands before the members (``pages.house_page_parts``).
    """
    from kinframe.functions import text as T

    cell = lambda c: F.concat(F.lit("<td>"), T.escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *(cell(c) for c in ("name", "birth", "death", "gen", "cat")), F.lit("</tr>"))
    table = members.withColumn("row", row).groupBy("house").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda r: r.row), "").alias("rows"))
    told = stats.join(table, "house").withColumn("intro", F.lit(""))
    if intro is not None:
        told = told.drop("intro").join(intro.select("house", "intro"), "house", "left")
    page = F.concat(F.lit("<!DOCTYPE html><html><body><h1>"), T.escape_html(F.col("house")), F.lit("</h1><p>"), F.col("era"), F.lit("</p>"), F.coalesce("intro", F.lit("")), F.lit("<table>"), F.col("rows"), F.lit("</table></body></html>"))
    return told.select("slug", page.alias("html"))


def index_page(ranked: DataFrame) -> str:
    """A page of all houses in rank order: totals, and a card per house with its types."""
    from kinframe.functions import display

    kind = display.house_type(F.col("n_royal"), F.col("n_noble"), F.col("n_military"))
    rows = ranked.orderBy("rank").select("slug", "house", "members", "era", kind.alias("kind")).collect()
    cards = "".join(f'<li class="card {escape(r.kind.split(",")[0].lower())}"><a href="{r.slug}.html">{escape(r.house)}</a> {r.members} {escape(r.era)} <i>{escape(r.kind)}</i></li>' for r in rows)
    return f"<!DOCTYPE html><html><body><p>{len(rows)} houses, {sum(r.members for r in rows)} members</p><ul>{cards}</ul></body></html>"


def metrics_json(root: int, by_generation: DataFrame, summary: DataFrame, f: float | None) -> str:
    rows = [{k: (float(v) if k == "filled" else v) for k, v in r.asDict().items()} for r in by_generation.orderBy("gen").collect()]
    return json.dumps({"root": root, "by_generation": rows, "summary": {k: float(v) if v is not None else None for k, v in summary.first().asDict().items()}, "F": f}, ensure_ascii=False)
