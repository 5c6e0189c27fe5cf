"""Changes: decisions, active sets, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import time

# Statuses of decided changes.
DECIDED = ("MERGED", "ABANDONED")


def decision_time(status: Column, updated: Column) -> Column:
    return F.when(status.isin(*DECIDED), updated)


def merged_time(status: Column, updated: Column) -> Column:
    return F.when(status == "MERGED", updated)


def history(changes: DataFrame) -> DataFrame:
    """owner, created, merged, decision_time, updated, lines_added, lines_deleted of changes that have a creation time."""
    return changes.filter("created is not null").select(
        "owner_id", "created", merged_time(F.col("status"), F.col("updated")).alias("merged"), decision_time(F.col("status"), F.col("updated")).alias("decision_time"), "updated",
        F.coalesce("insertions", F.lit(0)).alias("lines_added"), F.coalesce("deletions", F.lit(0)).alias("lines_deleted"),
    )


def is_open(created: Column, decision: Column, t: Column, lookback_days: int | None, undecided: bool = True) -> Column:
    """T - lookback <= created <= T < decision. An undecided change is open for the drift analysis and left out of distributions."""
    out = (created <= t) & (F.coalesce(t < decision, F.lit(undecided)))
    return out & (created >= t - F.expr(f"interval {int(lookback_days)} days")) if lookback_days is not None else out


def open_spans(changes: DataFrame, start: Column, end: Column, lookback_days: int | None, undecided: bool = True) -> DataFrame:
    """changes with _first, the first midnight in [start, end] at which each is open, and _last, the last instant of that; a span stands for its midnights."""
    low = F.greatest(F.col("created"), time.first_midnight(start))
    # The last instant of openness: before the decision, at the end of the lookback, at the end of the grid.
    last = [end] + ([F.col("created") + F.expr(f"interval {int(lookback_days)} days")] if lookback_days is not None else [])
    before = F.col("decision_time") - F.expr("interval 1 microsecond")
    rows = changes.filter("created is not null") if undecided else changes.filter("created is not null and decision_time is not null")
    return rows.withColumns({"_first": time.first_midnight(low), "_last": F.least(*last, F.coalesce(before, end))}).filter("_first <= _last")


def active_days(changes: DataFrame, start: Column, end: Column, lookback_days: int | None, undecided: bool = True, step_days: int = 1, alike: list[str] | None = None) -> DataFrame:
    """A row per change (created, decision_time) and midnight t in [start, end] at which it is open.

    No join: each change spans an interval of the grid, which is clipped and exploded. The grid starts at start's first midnight.
    alike: only these columns are wanted. Changes that agree in them and in their days are then one row, and n_alike their number.
    """
    rows = open_spans(changes, start, end, lookback_days, undecided)
    if step_days > 1:
        day = F.date_diff(F.col("_first").cast("date"), F.date_trunc("day", start).cast("date"))
        rows = rows.withColumn("_first", F.col("_first") + F.make_interval(days=F.pmod(-day, F.lit(step_days)))).filter("_first <= _last")
    # Days multiply what may have come together in few partitions, because it was small before. Rows that are alike are
    # made one before they are dealt out, so that what they have in common is no large group.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if alike:
        rows = rows.groupBy(*alike, "_first", "_last").agg(F.count("*").alias("n_alike")).repartition(parts, *alike)
    else:
        rows = rows.repartition(parts, *rows.columns)
    return rows.withColumn("t", F.explode(F.sequence("_first", "_last", F.expr(f"interval {int(step_days)} days")))).drop("_first", "_last")


def cohorts(changes: DataFrame, cycles: DataFrame, days: int = 30) -> DataFrame:
    """Changes of a cycle's first (early) and last (late) days, by whether they were reviewed. Needs project, created, review_count."""
    spans = cycles.select("project", "version", F.explode(F.array(*(F.struct(F.lit(n).alias("period"), a.alias("from_"), b.alias("to_")) for n, a, b in (
        ("early", F.col("cycle_start"), F.col("cycle_start") + F.expr(f"interval {days} days")), ("late", F.col("cycle_end") - F.expr(f"interval {days} days"), F.col("cycle_end")))))).alias("s"))
    # Both sides get a bucket of `days` days, so the range join is an equi-join on project and bucket.
    key = lambda c: F.floor(time.epoch(c) / F.lit(86400.0 * days)).cast("long")
    spans = spans.select("project", "version", "s.*").withColumn("k", F.explode(F.sequence(key(F.col("from_")), key(F.col("to_")))))
    met = changes.withColumn("k", key(F.col("created"))).join(spans, ["project", "k"]).filter("created between from_ and to_")
    return met.drop("k", "from_", "to_").withColumn("reviewed", F.col("review_count") > 0)
