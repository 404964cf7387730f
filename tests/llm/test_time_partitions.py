"""Adaptive time partitions (op 11) against a plain model of the layout."""

import calendar
import datetime as dt
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinframe.llm import catalog
from kinframe.llm.time_partitions import TimePartitions, clicks_in_time

SF = "/root/testdata/sf0.001"
CUT = dt.datetime(2024, 3, 1)


def moment(ts, click_id):
    if ts is None:
        return None
    k = zlib.crc32(str(click_id).encode()) % 128 if click_id is not None else None
    if k is not None and k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k is not None and k > 111:
        return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time())
    return ts


def leaves(moments, most):
    """{hour: leaf} and counts, by recursion over the calendar."""
    known = [(m.year, m.month, m.day, m.hour) for m in moments if m is not None]
    out = {}

    def count(prefix):
        return sizes[prefix]

    def runs(parent, members):
        open_run = None
        for x in members:
            n = count((*parent, x))
            if n > most and len(parent) < 3:
                open_run = None
                y = (*parent, x)
                runs(y, range(1, 13) if len(y) == 1 else range(1, calendar.monthrange(*y)[1] + 1) if len(y) == 2 else range(24))
            elif n <= most and open_run is not None and open_run[2] + n <= most:
                open_run[1], open_run[2] = x, open_run[2] + n
            else:
                open_run = [x, x, n, parent]
                made.append(open_run)
                if n > most:
                    open_run = None

    sizes = Counter(m[:i] for m in known for i in range(1, 5))
    made = []
    if known:
        runs((), range(min(known)[0], max(known)[0] + 1))
    for first, last, n, parent in made:
        if n:
            path = "/".join(f"{x:0{4 if i == 0 else 2}d}" for i, x in enumerate(parent))
            width = 4 if not parent else 2
            name = f"{path}/{first:0{width}d}-{last:0{width}d}".lstrip("/")
            for x in range(first, last + 1):
                out[(*parent, x)] = name
    return out


def layout(rows, most):
    """{(leaf, part): rows in order} of rows (click_id, ts, arrived_at, *rest)."""
    low = lambda v: (v is not None, v if v is not None else 0)
    timed = [(moment(r[1], r[0]), r) for r in rows]
    named = leaves([m for m, _ in timed], most)
    by = {}
    for m, r in timed:
        if m is None:
            leaf = "null"
        else:
            at = (m.year, m.month, m.day, m.hour)
            leaf = next(named[at[:i]] for i in range(1, 5) if at[:i] in named)
        by.setdefault(leaf, []).append((m, r))
    out = {}
    for leaf, found in by.items():
        found.sort(key=lambda x: (low(x[0]), low(x[1][2]), low(x[1][0]), *map(low, x[1])))
        for i in range(0, len(found), most):
            out[leaf, i // most + 1] = [r for _, r in found[i : i + most]]
    return out


def expected(rows, most, columns):
    early = [r for r in rows if r[2] is not None and r[2] < CUT]
    start, end = layout(early, most), layout(rows, most)
    out = {}
    for (leaf, part), found in end.items():
        ids = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in found).encode()).hexdigest()
        out[leaf, part] = (columns, ids, len(found), sum(not (r[2] is not None and r[2] < CUT) for r in found), start.get((leaf, part)) != found)
    return out


def local(path):
    return re.sub("^file:/*", "/", path)


def check(df, rows, most, columns):
    got = df.collect()
    assert {(r.leaf, r.part): (r.columns, r.ids_sha256, r.n_rows, r.n_new, r.rewritten) for r in got} == expected(rows, most, columns)
    assert len(got) == len({r.path for r in got}) == len({(r.leaf, r.part) for r in got})
    end = layout(rows, most)
    for r in got:
        table = pq.ParquetFile(local(r.path)).read()
        assert ",".join(table.column_names) == columns and table.column(0).to_pylist() == [x[0] for x in end[r.leaf, r.part]]
    if got:
        base = local(got[0].path).split("/data/")[0]
        there = {os.path.join(d, f) for d, _, names in os.walk(base + "/data") for f in names if not f.endswith(".crc")}
        assert there == {local(r.path) for r in got}
    return got


def made(spark, rows):
    return spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, part long")


def invented(seed, n):
    rng = random.Random(seed)
    begin = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ts = begin + dt.timedelta(seconds=rng.choice([rng.randrange(100 * 86400), 40 * 86400 + rng.randrange(3000), 61 * 86400]))
        late = rng.choice([1, 5, 86400 * 30]) if rng.random() < 0.3 else 1
        ts = None if rng.random() < 0.02 else ts
        rows.append((i if rng.random() < 0.98 else None, ts, None if rng.random() < 0.01 else (ts or begin) + dt.timedelta(seconds=late), rng.choice(["a", None]), rng.choice([1, None])))
    return rows + rng.sample(rows, n // 20) + [rows[0]] * 40


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_model(spark, seed):
    rows = invented(seed, 900)
    most = 1 + len(rows) // 40
    got = check(clicks_in_time(made(spark, rows), share=40), rows, most, "click_id,ts,arrived_at,leaf,part")
    assert {r.rewritten for r in got} == {True, False} and max(r.part for r in got) > 1


def test_awkward_tables(spark):
    assert clicks_in_time(made(spark, [])).collect() == []
    same = (5, dt.datetime(2024, 2, 5, 3), dt.datetime(2024, 2, 5, 4), None, None)
    nothing = (None, None, None, None, None)
    for rows in ([same] * 30, [nothing] * 30, [same] * 30 + [nothing] * 9 + [(6, dt.datetime(2024, 2, 5, 3), CUT, None, None)], [(1, None, dt.datetime(2024, 1, 1), "", 2)]):
        check(clicks_in_time(made(spark, rows), share=4), rows, 1 + len(rows) // 4, "click_id,ts,arrived_at,leaf,part")


def test_only_changed_files_are_written(spark):
    """A late row in one hour of a split day changes that day's runs alone; the files' times tell."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), dt.datetime(2024, 1, 2), None, None) for i in range(5000)]
    df = made(spark, rows)
    store = TimePartitions(spark, df.schema, F.col("ts"), ("arrived_at", "click_id"), 150)
    store.add(df)
    first = {f[2]: os.stat(local(f[2])).st_mtime_ns for f in store.files}
    late = made(spark, [(9999, dt.datetime(2024, 1, 10, 5), CUT, None, None)])
    store.add(late, is_new=F.col("arrived_at") >= F.lit("2024-03-01").cast("timestamp_ntz"))
    got = store.report().collect()
    again = {r.path for r in got if not r.rewritten}
    assert all(os.stat(local(p)).st_mtime_ns == first[p] for p in again) and len(again) >= len(first) - 2
    assert sum(r.n_new for r in got) == 1 and sum(r.n_rows for r in got) == 5001
    store.add(late)  # a third call goes on from the second
    assert sum(r.n_rows for r in store.report().collect()) == 5002


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/clicks.parquet").collect()]
    check(catalog.queries()["op11_time_partitions"](spark, SF), rows, 1 + len(rows) // 650, "click_id,ts,arrived_at,client_id,kind,value,props")
