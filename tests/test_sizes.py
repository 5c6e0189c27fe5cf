"""What shows only on larger tables, on small ones made for it."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from tidewater.operators import dataset
from tidewater.plans import landed, mining, registry

T = dt.datetime


def folder_of(tmp_path, orders, lines):
    """orders: key, customer, date, status; lines: key, part, supplier, date. Written as the tables that queries read."""
    c = duckdb.connect()
    c.execute("create table orders (o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderstatus varchar, o_orderpriority varchar)")
    c.execute("create table lineitem (l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp, l_quantity double, l_discount double, l_returnflag varchar)")
    for k, who, at, status in orders:
        c.execute("insert into orders values (?, ?, ?, ?, ?)", [k, who, at, status, ("1-URGENT", "5-LOW")[k % 2]])
    for k, part, supplier, at in lines:
        c.execute("insert into lineitem values (?, 1, ?, ?, ?, ?, ?, ?)", [k, part, supplier, at, float(part % 50 + 1), part % 11 / 100, "ANR"[part % 3]])
    for name in ("orders", "lineitem"):
        c.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    return c


def same(spark, c, name, tmp_path):
    """A query's rows, as its SQL gives them too."""
    got = registry.QUERIES[name](spark, str(tmp_path))
    c.execute(f"create or replace temp table want as {registry.ORACLES[name]}")
    columns = [r[0] for r in c.execute("describe want").fetchall()]
    want = c.execute(f"select {', '.join(columns)} from want").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(w)) for w in want)
    return rows


def test_commits_whose_hashes_begin_alike_have_one_file(spark, tmp_path):
    """md5('1605420-1') and md5('1605420-2') both begin with de8be795: one file, with the later date, found by both revisions."""
    orders = [(1605420, 1, T(1998, 1, 1), "F"), (3, 1, T(1998, 1, 1), "F"), (4, 1, T(1998, 1, 1), "F")]
    lines = [(k, p, 1, d) for k in (1605420, 3, 4) for p, d in ((1, T(1998, 1, 5)), (2, T(1998, 1, 6)))]
    c = folder_of(tmp_path, orders, lines)
    assert {r[0]: r[2] for r in same(spark, c, "revision_count_from_files", tmp_path)} == {1605420: 2, 3: 2, 4: 2}
    (tmp_path / "late").mkdir()
    c = folder_of(tmp_path / "late", orders[:1], [(1605420, 1, 1, T(1998, 1, 5)), (1605420, 2, 1, T(1998, 3, 6))])
    assert [r[2] for r in same(spark, c, "revision_count_from_files", tmp_path / "late")] == [0]


def test_nested_records_are_made_of_narrow_lists(spark, tmp_path):
    """Commits, addresses and files are made after lines have come together; equal lines count each, in the order that SQL gives them."""
    lines = [(k, p, s, T(1998, 1, d)) for k in (1, 2, 5) for p, s, d in ((3, 4, 9), (3, 4, 9), (1, 3, 9), (2, 9, 2))]
    c = folder_of(tmp_path, [(k, k, T(1998, 1, 1), "F") for k in (1, 2, 4, 5)], lines)
    for name in ("change_texts", "change_lines", "commit_summary", "first_revisions", "ingest_totals"):
        same(spark, c, name, tmp_path)
    plan = landed.change_texts(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression") :]
    assert "Window" not in plan and "src/f" not in dealt and "part " not in dealt and "md5" not in dealt


def test_layers_group_changes_and_not_cells(spark):
    """Bins of any number are words of bits; the plan groups by change alone, before cells multiply rows."""
    r = random.Random(3)
    held = {(k, r.randint(-80, 80)) for k in range(60) for _ in range(8)}
    records = spark.createDataFrame(sorted(held) * 2 + [(99, None)], "change_id long, bin int")
    cells = [(d, p, p - d, p) for d in (1, 70) for p in range(-5, 75)]
    got = dataset.layers(records, spark.createDataFrame(cells, "d int, p int, i int, j int"))
    want = {(d, p, k, 2 if {(k, i), (k, j)} <= held else 1 if (k, i) in held else 3) for d, p, i, j in cells for k in range(60) if {(k, i), (k, j)} & held}
    rows = list(map(tuple, got.collect()))
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join") == plan.count("Join Cross") == 1
    assert dataset.layers(records, spark.createDataFrame([], "d int, p int, i int, j int")).collect() == []


def test_records_of_days_are_not_broadcast(spark, tmp_path):
    """Days multiply records, which their estimated size doesn't show."""
    c = folder_of(tmp_path, [(k, k % 7, T(1997, 9, 1) + dt.timedelta(days=k), "FOP"[k % 3]) for k in range(200)], [(k, k, k % 30, T(1998, 4, 1) + dt.timedelta(days=k)) for k in range(200)])
    rows = mining._records(spark, str(tmp_path))
    chosen = dataset.split(dataset.layers(rows, mining._pairs(spark)), 8, 2, 1)
    plan = dataset.samples(rows, chosen, mining._pairs(spark))._jdf.queryExecution().sparkPlan().toString()
    top = plan[: plan.index("Generate explode(sequence")]
    assert "SortMergeJoin [change_id" in top
    for name in ("layers", "split_quota", "split_sample", "sample_weights"):
        same(spark, c, name, tmp_path)


def test_history_of_days_is_not_broadcast(spark, tmp_path):
    """Records of days meet what their owners had done by sorting; only what is known by day is broadcast."""
    c = folder_of(tmp_path, [(k, k % 7, T(1997, 9, 1) + dt.timedelta(days=k), "FOP"[k % 3]) for k in range(200)], [(k, k, k % 30, T(1998, 4, 1) + dt.timedelta(days=k)) for k in range(200)])
    plan = mining.drift_features(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [owner_id" in plan and "BroadcastHashJoin [owner_id" not in plan
    same(spark, c, "drift_features", tmp_path)
