"""The analyses end to end on a small made-up history."""

import datetime as dt
import random
import shutil

from pyspark.sql import functions as F

from tidewater.functions import time
from tidewater.operators import dataset, releases
from tidewater.plans import analyses
from tidewater.sources import readers
from tidewater.streaming import ingest

T = dt.datetime


def history(spark):
    r = random.Random(9)
    rows = []
    for k in range(300):
        created = T(2020, 1, 1) + dt.timedelta(hours=r.randint(0, 24 * 300))
        status = r.choice(["MERGED", "MERGED", "ABANDONED", "NEW"])
        updated = created + dt.timedelta(hours=r.randint(-5, 24 * 40))
        review = created + dt.timedelta(hours=r.randint(1, 400))
        rows.append((k, "p", k % 7, created, updated, status, updated if status != "NEW" else None, review))
    changes = spark.createDataFrame(rows, "change_number long, project string, owner_id long, created timestamp_ntz, updated timestamp_ntz, status string, decision_time timestamp_ntz, first_review timestamp_ntz")
    calendar = spark.createDataFrame([("p", f"{k}.0.0", T(2020, 1 + 3 * k, 1)) for k in range(4)], "project string, version string, release_date timestamp_ntz")
    return changes.withColumn("next_review", F.col("first_review")), releases.cycles(calendar), rows


def test_lifetimes(spark):
    changes, cycles, rows = history(spark)
    out = analyses.lifetimes(changes, cycles, 0, 10)
    decided = [x for x in rows if x[5] != "NEW" and x[4] > x[3] and T(2020, 1, 1) <= x[3] <= T(2020, 10, 1)]
    assert {r.grp: r.n for r in out["mixed_summary"].collect()}["all"] == len(decided)
    for name, key in (("histogram", "summary"), ("mixed_histogram", "mixed_summary")):
        keys = ["version", "grp"] if name == "histogram" else ["grp"]
        counted = {tuple(r)[:-1]: tuple(r)[-1] for r in out[name].groupBy(*keys).agg(F.sum("count")).collect()}
        assert counted == {tuple(r)[:-1]: tuple(r)[-1] for r in out[key].select(*keys, "n").collect()}


def test_waiting(spark):
    changes, cycles, _ = history(spark)
    out = analyses.waiting(changes, cycles, "time_to_decision", 60, n_bins=3)
    points = out["points"].collect()
    assert points and all(p.n_active >= 5 and p.p10 <= p.p50 <= p.p90 and 0 <= p.x <= 1 for p in points)
    assert sum(r.n_active for r in out["mixed"].collect()) == sum(p.n_active for p in points)
    assert all(r.n_dropped_unfinished > 0 for r in out["exclusions"].collect())


def test_records_and_recompute(spark):
    changes, cycles, _ = history(spark)
    made = analyses.records(changes, cycles, lambda rows: rows.withColumn("f", F.lit(1.0)), "time_to_decision")
    assert made.filter("label <= 0 or bin < -6 or bin > 6").isEmpty()
    rows = [(d, p, k, str(t), c, float(c + t), float(c * (p > 3) + t)) for d in (1, 2) for p in range(1, 7) for k in (0, 1) for t in (0, 1) for c in range(1, 6)]
    predictions = spark.createDataFrame(rows, "d int, p int, repeat int, t string, change_id long, y_true double, y_pred double").withColumn("version", F.lit("1.0.0"))
    out = analyses.recompute(predictions, ["version"], 200)
    assert {r.n for r in out["count"].collect()} == {1}
    assert out["matrix"].filter("size(per_repeat) != 2 and metric = 'rank_mae'").isEmpty()
    assert len(dataset.cells()) == 36


def test_analyze_from_changes_to_counts(spark, tmp_path):
    """All models, releases and metrics in one run; no change is on both sides of a cell, and seeds repeat."""
    changes, cycles, _ = history(spark)
    known = lambda rows: rows.withColumns({"a": F.dayofyear("t").cast("double"), "b": F.col("owner_id").cast("double")})
    go = lambda path: analyses.analyze(changes, cycles.filter("version != '3.0.0'"), known, ["a", "b"], f"file://{path}", label="time_to_decision", n_train=4, n_eval=2, repeats=1, bins=2, trees=2, permutations=20)
    out = go(tmp_path / "one")
    rows = out["predictions"].collect()
    assert {r.model for r in rows} == {"gradient_boosting", "random_forest"} and {r.version for r in rows} >= {"1.0.0"}
    sides = spark.read.parquet(f"{tmp_path}/one/samples").groupBy("version", "d", "p", "repeat", "change_id").agg(F.countDistinct("side").alias("n"))
    assert sides.filter("n > 1").isEmpty() and sides.count() > 0
    assert out["matrix"].select("model", "version", "metric").distinct().count() >= 2 * 9
    assert {r.n for r in out["count"].collect()} <= {1, 2} and spark.read.json(f"{tmp_path}/one/count/json").count() == out["count"].count()
    # Features that come late, for sampled rows alone, give the same predictions.
    late = lambda rows: known(rows).select("change_number", "owner_id", "created", "t", "a", "b")
    same = analyses.analyze(changes, cycles.filter("version != '3.0.0'"), lambda rows: rows, ["a", "b"], f"file://{tmp_path}/three", label="time_to_decision", n_train=4, n_eval=2, repeats=1, bins=2, trees=2, permutations=20, late=late)
    assert sorted(map(tuple, same["predictions"].collect()), key=str) == sorted(map(tuple, rows), key=str)
    again = go(tmp_path / "two")["predictions"]
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_resumed_ingest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n int")
    rows.write.mode("append").json(f"{tmp_path}/in")
    go = lambda: ingest.ingest(spark, f"{tmp_path}/in", "k long, v string, n int", f"{tmp_path}/out", f"{tmp_path}/done")
    go()
    go()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    spark.createDataFrame([(2, "c", 2)], "k long, v string, n int").write.mode("append").json(f"{tmp_path}/in")
    go()
    assert {(r.k, r.v) for r in ingest.latest(spark, f"{tmp_path}/out", "k", [F.desc("n")]).collect()} == {(1, "a"), (2, "c")}


def test_upsert_stopped_repeated_and_resumed(spark, tmp_path):
    schema, target = "k long, v string, n int", f"file://{tmp_path}/target"
    made = lambda *rows: spark.createDataFrame(list(rows), schema).repartition(2)
    held = lambda: sorted(map(tuple, ingest.current(spark, target, schema).collect()))
    assert held() == []
    ingest.merge(made((1, "a", 1), (2, "b", 1), (2, "b2", 2), (None, "x", 1)), 0, target, "k", ["n"], 4)
    assert held() == [(1, "a", 1), (2, "b2", 2)]
    hot = [(7, f"h{n}", n) for n in range(300)]
    batch = made((2, "stale", 1), (1, "same", 1), (3, "c", None), *hot)
    ingest.merge(batch, 1, target, "k", ["n"], 4)
    want = [(1, "same", 1), (2, "b2", 2), (3, "c", None), (7, "h299", 299)]
    assert held() == want
    ingest.merge(batch, 1, target, "k", ["n"], 4)  # comes again after its manifest was written
    shutil.rmtree(tmp_path / "target" / "manifest" / "batch=1")
    assert held() == [(1, "a", 1), (2, "b2", 2)]  # stopped before: nothing of it is seen
    ingest.merge(batch, 1, target, "k", ["n"], 4)
    ingest.merge(made(), 2, target, "k", ["n"], 4)
    assert held() == want
    plan = ingest.current(spark, target, schema)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_date_chunks(spark):
    rows = [("2015-03-01", "2017-06-01"), ("2015-03-01", "2016-01-01"), ("2015-01-01", "2015-01-01"), ("2015-05-05", "2015-05-05"), ("2014-12-31", "2018-01-02")]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in "ab"})
    for years in (1, 2, None):
        got = [[(f"{x.start:%Y-%m-%d}", f"{x.end:%Y-%m-%d}") for x in r.c] for r in df.select(time.date_chunks(F.col("a"), F.col("b"), years).alias("c")).collect()]
        for (a, b), chunks in zip(rows, got):
            starts = [a] + [f"{y}-01-01" for y in range(int(a[:4]) + years, int(b[:4]) + 1, years)] if years else [a]
            assert chunks == list(zip(starts, [*starts[1:], b]))


def test_checklist_up_to_a_number_and_whole(spark, tmp_path):
    rows = [("382", "a", "x", "1", " "), ("383", "b", 'say "so",\nplease', "", "1"), ("384", "c", "y", "0", None)]
    spark.createDataFrame(rows, "PRNumber string, author string, comment string, request string, confirmation string").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{tmp_path}/c")
    got = {most: sorted((r.PRNumber, r.comment, r.request, r.confirmation) for r in readers.checklist(spark, f"{tmp_path}/c", most).collect()) for most in (383, None, 0)}
    assert got[383] == [(382, "x", "1", None), (383, 'say "so",\nplease', None, "1")] and got[None] == [*got[383], (384, "y", "0", None)] and got[0] == []
