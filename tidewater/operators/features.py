"""The feature vector of a change at a time: fifteen columns, in the order of dataset.FEATURES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text, time
from tidewater.operators import history, releases, revisions
from tidewater.operators.dataset import FEATURES

RENAMED = {"past_reports": "past_report_count", "recent_reports": "recent_report_count"}


def build(records: DataFrame, texts: DataFrame, patch_sets: DataFrame, events: DataFrame, calendar: DataFrame, component: str, lookback_days: int = 90, period_days: int = 14) -> DataFrame:
    """records (change_number, owner_id, created, t) with the fifteen features.

    texts: change_number, subject, message. patch_sets: change_number, created, number, lines_added, lines_deleted,
    files_changed. events: the history of all changes (owner_id, created, merged, decision_time, updated, lines).
    calendar: component, version, release_date. Counts are 0 where nothing is known.
    """
    said = _said(texts)
    asked = records.select("change_number", "t").distinct()
    state = revisions.state_at(asked, patch_sets, ["lines_added", "lines_deleted", "files_changed"])
    counted = revisions.count_at(asked, patch_sets)
    known = history.developer_history(records.select("owner_id", "t"), events, "owner_id", lookback_days)
    known = known.withColumnsRenamed(RENAMED)
    project = _project(records.select("t").distinct(), events, calendar, component, period_days)
    rows = records.withColumn("elapsed_time", time.elapsed_minutes(F.col("created"), F.col("t"))).join(said, "change_number", "left")
    rows = rows.join(state, ["change_number", "t"], "left").join(counted, ["change_number", "t"], "left").join(known, ["owner_id", "t"], "left").join(project, "t", "left")
    return _filled(rows).select(*records.columns, *FEATURES)


def build_daily(spans: DataFrame, start: Column, end: Column, texts: DataFrame, patch_sets: DataFrame, events: DataFrame, calendar: DataFrame, component: str, lookback_days: int = 90, period_days: int = 14) -> DataFrame:
    """build() for all midnights of spans (change_number, owner_id, created, _first, _last; within start and end): change_number, owner_id, created, t and the fifteen features.

    Spans meet what is known and are cut where that changes; days multiply rows last of all, where these lie.
    """
    cut = _cut(spans.select("change_number", "owner_id", "created", "_first", "_last"), start, end, events, lookback_days).withColumnsRenamed(RENAMED)
    cut = revisions.state_days(cut, patch_sets, ["lines_added", "lines_deleted", "files_changed"]).join(_said(texts).hint("merge"), "change_number", "left")
    rows = _days(cut).withColumn("elapsed_time", time.elapsed_minutes(F.col("created"), F.col("t")))
    rows = rows.join(F.broadcast(_project(midnights(spans.sparkSession, start, end), events, calendar, component, period_days)), "t", "left")  # a row per midnight
    return _filled(rows).select("change_number", "owner_id", "created", "t", *FEATURES)


def history_daily(spans: DataFrame, start: Column, end: Column, events: DataFrame, lookback_days: int = 90) -> DataFrame:
    """history.developer_history() for all midnights of spans (owner_id, _first, _last and more; within start and end), with t; days multiply rows last of all."""
    return _days(_cut(spans, start, end, events, lookback_days)).drop("_lo", "_hi", "_day")


def midnights(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """t: the midnights from start to end."""
    return spark.range(1).select(F.explode(F.sequence(*_ends(start, end))).alias("_day")).select(time.midnight(F.col("_day")).alias("t"))


def _ends(start: Column, end: Column) -> tuple[Column, Column]:
    return F.unix_date(time.first_midnight(start).cast("date")), F.unix_date(end.cast("date"))


def _cut(spans: DataFrame, start: Column, end: Column, events: DataFrame, lookback_days: int) -> DataFrame:
    rows = spans.withColumns({"_lo": F.unix_date(F.col("_first").cast("date")), "_hi": F.unix_date(F.col("_last").cast("date"))}).drop("_first", "_last")
    return history.developer_days(rows, events, *_ends(start, end), "owner_id", lookback_days)


def _days(spans: DataFrame) -> DataFrame:
    return spans.withColumn("_day", F.explode(F.sequence("_lo", "_hi"))).withColumn("t", time.midnight(F.col("_day")))


def _said(texts: DataFrame) -> DataFrame:
    return texts.select("change_number", text.bug_fix_confidence("subject", "message").alias("bug_fix_confidence"), text.mentions_test("subject", "message").alias("test_code_presence"), text.refactoring_confidence("subject", "message").alias("refactoring_confidence"))


def _project(days: DataFrame, events: DataFrame, calendar: DataFrame, component: str, period_days: int) -> DataFrame:
    """What is known by day alone; days: t."""
    days = days.withColumn("component", F.lit(component))
    project = releases.days_to_major(days, calendar).drop("component").withColumnRenamed("days_to_major", "days_to_major_release")
    project = project.join(history.open_count(events, days).withColumnRenamed("n_open", "open_ticket_count"), "t", "left")
    return project.join(history.lines_in_period(events, days, period_days).withColumnRenamed("reviewed_lines", "reviewed_lines_in_period"), "t", "left")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f: F.coalesce(f, F.lit(0)).cast("double") for f in FEATURES})
