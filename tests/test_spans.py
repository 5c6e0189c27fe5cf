"""Spans of days, cut where what is known changes, against the days themselves."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewater.operators import asof, changes, dataset, features
from tidewater.operators.history import developer_history
from tidewater.plans import analyses, mining
from tidewater.plans import standins as S

START, END = datetime(1998, 1, 1), datetime(1998, 3, 1)


def history(spark):
    """Changes at odd instants and at midnights, one owner with a third of them, null owners, and events by owners without changes."""
    r = random.Random(5)
    at = lambda low, high: START + timedelta(days=r.randint(low, high), microseconds=r.choice([0, 1, 86_399_999_999, r.randint(0, 86_399_999_999)]))
    rows, sets = [], []
    for k in range(90):
        created = at(-100, 55)
        decided = r.choice([None, created + timedelta(days=r.randint(0, 60)), at(-90, 70)])
        rows.append((k, r.choice([1, None, k % 7 + 2]) if k % 3 else 1, created, decided, r.choice([None, decided]), created, r.randint(0, 9)))
        times = [r.choice([None, created, at(-100, 70)]) for _ in range(k % 5)]
        sets += [(k, r.choice([t, times[0]]), n + 1, r.randint(0, 9), n, 1) for n, t in enumerate(times)]
    c = spark.createDataFrame(rows, "change_number long, owner_id long, created timestamp_ntz, decision_time timestamp_ntz, merged timestamp_ntz, updated timestamp_ntz, lines long")
    return c, spark.createDataFrame(sets, "change_number long, created timestamp_ntz, number int, lines_added long, lines_deleted int, files_changed int")


def test_features_of_spans_are_those_of_their_days(spark):
    c, sets = history(spark)
    texts = c.filter("change_number % 4 > 0").select("change_number", F.when(F.col("change_number") % 2 == 0, "a defect").alias("subject"), F.lit(None).cast("string").alias("message"))
    calendar = spark.createDataFrame([("core", "2.0.0", datetime(1998, 2, 1))], "component string, version string, release_date timestamp_ntz")
    grid, known = [F.lit(x).cast("timestamp_ntz") for x in (START, END)], (texts, sets, c, calendar, "core")
    own = c.select("change_number", "owner_id", "created", "decision_time")
    want = features.build(changes.active_days(own, *grid, 30).drop("decision_time"), *known, 20, 14)
    got = features.build_daily(changes.open_spans(own, *grid, 30), *grid, *known, 20, 14)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 500


def test_days_multiply_feature_vectors_last(spark):
    """Days are made above all joins that move rows; they used to be shuffled several times."""
    plan = mining.feature_vectors_daily(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString().split("\n")
    made = next(k for k, line in enumerate(plan) if "explode(sequence(_lo" in line)
    assert not any("SortMergeJoin" in line or "Window" in line for line in plan[:made])


def test_history_of_spans_is_that_of_their_days(spark):
    c, _ = history(spark)
    grid, own = [F.lit(x).cast("timestamp_ntz") for x in (START, END)], c.filter("owner_id is not null").select("change_number", "owner_id", "created", "decision_time")
    days = changes.active_days(own, *grid, 30)
    want = days.join(developer_history(days.select("owner_id", "t"), c, "owner_id", 20), ["owner_id", "t"])
    got = features.history_daily(changes.open_spans(own, *grid, 30), *grid, c, 20).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 300
    assert [r.t for r in features.midnights(spark, *grid).orderBy("t").collect()] == [START + timedelta(days=k) for k in range(60)]


def test_days_multiply_history_last(spark):
    """Records of days are made of spans above all joins that move rows; they and their owners' days used to be shuffled."""
    plan = mining.drift_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString().split("\n")
    made = [k for k, line in enumerate(plan) if "explode(sequence(" in line and ("_lo" in line or "_first" in line)]
    assert made and not any("SortMergeJoin" in line or "Window" in line for line in plan[: made[0]])


def test_records_as_spans_are_those_by_day(spark):
    """Reviews at midnights and at odd instants, bins narrower than a day: cut spans hold the days of next_after() and with_bins()."""
    c, sets = history(spark)
    own, events = c.select("change_number", "owner_id", "created", "decision_time"), sets.select("change_number", F.col("created").alias("date"))
    for n in (7, 40):
        events = events.union(c.select("change_number", F.col("created") + F.expr(f"interval {n} days")))
    grid = [F.lit(x).cast("timestamp_ntz") for x in (START, END)]
    for a, b, n in ((datetime(1998, 1, 20, 5, 0, 0, 1), datetime(1998, 2, 20), 6), (datetime(1998, 1, 20), datetime(1998, 1, 26), 13)):
        cycle = [F.lit(x).cast("timestamp_ntz") for x in (a, b)]
        days = asof.next_after(changes.active_days(own, *grid, 60), events, "change_number", "t", "date", "next_review").filter("next_review is not null")
        want = dataset.with_bins(days, *cycle, n).select("change_number", "t", "next_review", "bin")
        spans = dataset.span_bins(asof.next_of_days(changes.open_spans(own, *grid, 60), events, "change_number", "date", "next_review"), *cycle, n)
        got = dataset.span_days(spans).select("change_number", "t", "next_review", "bin")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 200


def test_samples_read_spans_not_days(spark):
    """Records of the drift analysis are written as spans: fewer rows than days, which they were before."""
    folder = "/root/testdata/sf0.001"
    made = mining._samples(spark, folder, 4, 1, 1)
    files = {f.rpartition("/")[0] for f in made.inputFiles() if "/records-" in f}
    rows = spark.read.parquet(*files)
    assert {"_first", "_last", "bin"} <= set(rows.columns) and dataset.span_days(rows).count() > 5 * rows.count() > 0


def test_records_that_agree_are_one_row(spark):
    c = S.changes(spark, "/root/testdata/sf0.001").select("change_number", "project", "created", "decision_time")
    alike = ["version", "cycle_start", "cycle_end", "decision_time"]
    rows = analyses.records(c, S.cycles(spark), lambda rows: rows, "time_to_decision", alike=alike)
    want = analyses.records(c, S.cycles(spark), lambda rows: rows, "time_to_decision").groupBy("version", "t", "bin", "label").count()
    got = rows.groupBy("version", "t", "bin", "label").agg(F.sum("n_alike"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bins_of_spans_take_differences_of_times_once(spark):
    """A cycle's ends and length are measured once a span; it used to be done for every bin and day looked at. Changes outside a release's span are left out before releases multiply them."""
    c = S.changes(spark, "/root/testdata/sf0.001").select("change_number", "project", "owner_id", "created", "decision_time")
    plan = analyses.record_spans(c, S.cycles(spark), lambda rows: rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "timestampdiff" not in plan[: plan.index("explode(sequence(_a")].lower() and "explode(filter(" in plan


def test_cells_are_drawn_from_once(spark):
    """What the bound on the md5 keeps is written, with the layers that it left too few of taken whole."""
    layered = spark.createDataFrame([(d, 1, k, 1 + k % 3) for d in (1, 2) for k in range(900)], "d int, p int, change_id long, layer int")
    some = [dataset.split(layered, 40, 10, 3, slack=slack) for slack in (6.0, 0.0, -3.0)]
    first, *others = [sorted(map(tuple, x.collect())) for x in some]
    assert all(x == first for x in others) and len(first) == 2 * 3 * 50
    assert "md5" not in some[0]._jdf.queryExecution().optimizedPlan().toString() and any("/drawn-" in f for f in some[0].inputFiles())
    assert "md5" in some[2]._jdf.queryExecution().optimizedPlan().toString()
