"""What a developer or project had done at a time, as step functions: every count is a sum of deltas at exact instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import time
from tidewater.operators.steps import sums_until

BLOCK_DAYS = 14


def _ratio(part, whole):
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _after(ts: Column, days: float) -> Column:
    """The first instant at which ts no longer lies within the last days, both ends included."""
    return ts + F.expr(f"interval {round(days * 86400 * 10**6) + 1} microseconds")


def _deltas(events: DataFrame, key: str, lookback_days: float) -> DataFrame:
    """key, at and what changes then: past, recent, done, both (recent and merged). Instants that are null don't count.

    A change is recent from its creation, and recent and merged from the later of both, to the end of its lookback.
    """
    created, merged = F.col("created"), F.col("merged")
    both, end = F.greatest(created, merged), _after(created, lookback_days)
    kept = F.coalesce((merged.isNotNull() & (both < end)).cast("int"), F.lit(0))

    def delta(at: Column, past=0, recent=0, done=0, recently_done=0) -> Column:
        return F.struct(at.alias("at"), *(F.lit(x).cast("long").alias(c) if isinstance(x, int) else x.cast("long").alias(c) for c, x in (("past", past), ("recent", recent), ("done", done), ("both", recently_done))))

    steps = F.array(delta(created, 1, 1), delta(merged, 0, 0, 1), delta(F.when(kept == 1, both), 0, 0, 0, 1), delta(end, 0, -1, 0, -kept))
    return events.filter("created is not null").select(key, F.explode(steps).alias("_d")).select(key, "_d.*")


def _rates() -> dict[str, Column]:
    return {"merge_rate": _ratio(F.col("done"), F.col("past")), "recent_merge_rate": _ratio(F.col("both"), F.col("recent"))}


def developer_days(spans: DataFrame, events: DataFrame, first: Column, last: Column, key: str = "owner_id", lookback_days: float = 90) -> DataFrame:
    """spans (key, _lo, _hi: numbers of days within first and last), cut where what developer_history() gives at their midnights changes, with its columns; nulls where nothing is known.

    A key's changes of a day are one row, so its steps are no more than the days. Spans and steps meet by key and block of
    days, so that a key with a third of all changes is several tasks.
    """
    block = lambda day: F.floor(day / F.lit(BLOCK_DAYS)).cast("int")
    cut = spans.withColumn("_block", F.explode(F.sequence(block(F.col("_lo")), block(F.col("_hi")))))
    cut = cut.withColumns({"_lo": F.greatest("_lo", F.col("_block") * BLOCK_DAYS), "_hi": F.least("_hi", F.col("_block") * BLOCK_DAYS + (BLOCK_DAYS - 1))})
    names = ["past", "recent", "done", "both"]
    made = _deltas(events, key, lookback_days).filter("at is not null").withColumn("_day", time.first_day(F.col("at"))).filter(F.col("_day") <= last)
    # Every block that is asked for starts with a row of its own.
    asked = spans.select(key, F.explode(F.sequence(block(F.col("_lo")), block(F.col("_hi")))).alias("_block")).select(key, (F.col("_block") * BLOCK_DAYS).alias("_day"), *(F.lit(0).cast("long").alias(c) for c in names))
    both = made.select(key, "_day", *names).union(asked).withColumn("_day", F.greatest("_day", first))
    both = both.groupBy(key, "_day").agg(*(F.sum(c).alias(c) for c in names)).filter(F.col(key).isNotNull())
    order = Window.partitionBy(key).orderBy("_day")
    run = both.withColumns({c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in names} | {"_to": F.lead("_day").over(order) - 1, "_block": block(F.col("_day"))})
    steps = run.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), F.col("_day").alias("_from"), F.least("_to", F.col("_block") * BLOCK_DAYS + (BLOCK_DAYS - 1)).alias("_to"), *names)
    met = cut.join(steps.hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_of")) & (F.col("_lo") <= F.col("_to")) & (F.col("_hi") >= F.col("_from")), "left")
    met = met.withColumns({"_lo": F.greatest("_lo", "_from"), "_hi": F.least("_hi", "_to"), **_rates()})
    return met.select(*spans.columns, F.col("past").alias("past_reports"), F.col("recent").alias("recent_reports"), *_rates())


def developer_history(probes: DataFrame, events: DataFrame, key: str = "owner_id", lookback_days: float = 90) -> DataFrame:
    """probes (key, t) with past_reports, recent_reports, merge_rate, recent_merge_rate. events: key, created, merged.

    Reports count if created at or before t, recent ones within the lookback, both ends included; merges count if merged
    at or before t (whenever created); the recent rate asks both of the same change. Probes are made distinct first.
    """
    out = sums_until(probes, _deltas(events, key, lookback_days), [key], ["past", "recent", "done", "both"])
    return out.withColumns(_rates()).select(key, "t", F.col("past").alias("past_reports"), F.col("recent").alias("recent_reports"), *_rates())


def open_count(changes: DataFrame, times: DataFrame) -> DataFrame:
    """t of times (made distinct), n_open: changes created at or before t less those decided at or before it, whenever t is."""
    steps = F.array(F.struct(F.col("created").alias("at"), F.lit(1).cast("long").alias("n_open")), F.struct(F.col("decision_time").alias("at"), F.lit(-1).cast("long").alias("n_open")))
    return sums_until(times, changes.filter("created is not null").select(F.explode(steps).alias("_d")).select("_d.*"), [], ["n_open"])


def lines_in_period(changes: DataFrame, times: DataFrame, days: float = 14) -> DataFrame:
    """t of times (made distinct), reviewed_lines: lines of changes updated in [t - days, t], whenever t and the updates are."""
    lines = F.coalesce("lines", F.lit(0)).cast("long")
    steps = F.array(F.struct(F.col("updated").alias("at"), lines.alias("reviewed_lines")), F.struct(_after(F.col("updated"), days).alias("at"), (-lines).alias("reviewed_lines")))
    return sums_until(times, changes.filter("updated is not null").select(F.explode(steps).alias("_d")).select("_d.*"), [], ["reviewed_lines"])


def days_between_events(changes: DataFrame) -> DataFrame:
    """t: every midnight from that at or after the first creation or decision to that at or after the last one."""
    ends = changes.filter("created is not null").agg(F.least(F.min("created"), F.min("decision_time")).alias("a"), F.greatest(F.max("created"), F.max("decision_time")).alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence(time.first_midnight(F.col("a")), time.first_midnight(F.col("b")), F.expr("interval 1 day"))).alias("t"))
