"""Report pages: the data sets of the reports, embedded as JSON in pages that show them as tables.

What a page shows must fit a browser, and so the driver; the reports themselves are
DataFrames and are written as tables (``write_graph`` and the like) at any size. Rows are
turned to JSON by the executors, in an explicit order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions import display
from kinframe.functions import text as T
from kinframe.sources.graphs import escape

_SHOW = """<script>
for (const [name, columns] of Object.entries(TABLES)) {
  const body = document.getElementById(name), find = document.getElementById("find");
  const draw = () => { body.replaceChildren(...DATA[name].filter(r => !find.value || JSON.stringify(r).toLowerCase().includes(find.value.toLowerCase())).map(r => {
    const tr = document.createElement("tr");
    for (const c of columns) { const td = document.createElement("td"); td.textContent = Array.isArray(r[c]) ? r[c].join(", ") : r[c] ?? ""; tr.append(td); }
    return tr; })); };
  find.addEventListener("input", draw); draw();
}
</script>"""


def embedded(rows: DataFrame, *order: str | Column) -> str:
    """A JSON array of the rows; safe inside a script element."""
    lines = rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).collect()
    return "[" + ",".join(r.j.replace("</", "<\\/") for r in lines) + "]"


def data_page(title: str, figures: Mapping[str, object], tables: Mapping[str, tuple[str, Sequence[str], str]]) -> str:
    """A page with figures on top and a searchable table per data set: name -> (heading, columns, JSON)."""
    import json

    head = "".join(f"<li><b>{escape(str(v))}</b> {escape(k)}</li>" for k, v in figures.items())
    body = "".join(
        f"<h2>{escape(heading)}</h2><table><thead><tr>{''.join(f'<th>{escape(c)}</th>' for c in columns)}</tr></thead><tbody id=\"{escape(name)}\"></tbody></table>"
        for name, (heading, columns, _) in tables.items()
    )
    data = "{" + ",".join(f"{json.dumps(name)}:{found}" for name, (_, _, found) in tables.items()) + "}"
    shown = json.dumps({name: list(columns) for name, (_, columns, _) in tables.items()})
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><ul>{head}</ul><input id=\"find\">{body}<script>const DATA = {data}; const TABLES = {shown};</script>{_SHOW}</body></html>"


def conflict_page(conflicts: DataFrame, decisions: DataFrame | None = None) -> str:
    """People with too many parents, their two candidate sets, and what was decided."""
    rows = conflicts if decisions is None else conflicts.join(decisions.select("id", "decision"), "id", "left")
    columns = [c for c in ("id", "name", "gen", "n_parents", "group_a", "group_b", "decision") if c in rows.columns]
    rows = rows.select(columns)
    return data_page("Parent conflicts", {"conflicts": rows.count()}, {"conflicts": ("To decide", columns, embedded(rows, F.desc("n_parents"), "id"))})


def review_page(clusters: DataFrame) -> str:
    """Probable duplicates, those with relations first."""
    rows = clusters.select("norm", "gen", "ids", "is_orphan")
    figures = rows.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("people"), F.count_if("is_orphan").alias("orphans")).first()
    told = {"clusters": figures.n, "people": figures.people or 0, "without relations": figures.orphans}
    return data_page("Probable duplicates", told, {"clusters": ("To merge", ["norm", "gen", "ids", "is_orphan"], embedded(rows, "is_orphan", "gen", "norm", "ids"))})


def map_page(points: DataFrame, flows: DataFrame) -> str:
    """Placed people and the moves between generations."""
    people = points.where("lat IS NOT NULL").select("id", "name", "birth", "lat", "lng", "cat")
    tables = {"people": ("People", ["name", "birth", "lat", "lng", "cat"], embedded(people, F.asc_nulls_last("birth"), "id")), "flows": ("Moves", flows.columns, embedded(flows, *flows.columns))}
    return data_page("Migrations", {"people placed": people.count(), "moves": flows.count()}, tables)


def voyage_page(entries: DataFrame, matches: DataFrame, top: DataFrame) -> str:
    """Catalogue entries that hold one of the family's surnames, and where most went."""
    columns = [c for c in ("num", "year", "name", "origin", "destination", "parents", "vol", "display", "priority") if c in matches.columns]
    rows = matches.select(columns)
    tables = {"matches": ("Passengers", columns, embedded(rows, *(c for c in ("priority", "year", "num", "name") if c in columns))), "top": ("Destinations", top.columns, embedded(top, F.desc(top.columns[-1]), top.columns[0]))}
    return data_page("Passengers", {"entries": entries.count(), "matches": rows.count()}, tables)


def house_page_parts(stats: DataFrame, paths: DataFrame, shields: DataFrame | None = None) -> DataFrame:
    """What a house's page says before its members: types, history, arms, and the way to the subject.

    ``paths`` has (house, step, name, birth, gen), the subject first; ``shields`` (slug, url).
    Long ways show their first and last seven steps.
    """
    label = F.concat(T.escape_html(F.col("name")), F.coalesce(F.concat(F.lit(", b. "), F.col("birth").cast("string")), F.lit("")), F.lit(", gen "), F.col("gen").cast("string"))
    steps = paths.groupBy("house").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", label.alias("t")))), lambda s: s.t).alias("way"))
    shown = F.when(F.size("way") > 14, F.concat(F.slice("way", 1, 7), F.array(F.concat(F.lit("… "), (F.size("way") - 14).cast("string"), F.lit(" more …"))), F.slice("way", -7, 7))).otherwise(F.col("way"))
    out = stats.join(steps, "house", "left").withColumn("way_html", F.coalesce(F.concat(F.lit("<ol><li>"), F.array_join(shown, "</li><li>"), F.lit("</li></ol>")), F.lit("")))
    kind = display.house_type(F.col("n_royal"), F.col("n_noble"), F.col("n_military"))
    badges = F.array_join(F.transform(F.split(kind, ","), lambda k: display.badge(k, F.lower(k))), "")
    arms = F.lit("")
    if shields is not None:
        out = out.join(shields.select("slug", "url"), "slug", "left")
        arms = F.coalesce(F.concat(F.lit('<img loading="lazy" src="'), F.replace(T.escape_html(F.col("url")), F.lit('"'), F.lit("&quot;")), F.lit('">')), F.lit(""))
    history = F.coalesce(F.col("history"), F.lit("")) if "history" in stats.columns else F.lit("")
    return out.select("house", "slug", F.concat(badges, arms, F.lit("<p>"), T.escape_html(history), F.lit("</p>"), F.col("way_html")).alias("intro"))
