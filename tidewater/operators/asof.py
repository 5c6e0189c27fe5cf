"""As-of joins by windows over the union of both sides: one shuffle on the key, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import time


def next_after(probes: DataFrame, events: DataFrame, key: str, t: str, ts: str, out: str) -> DataFrame:
    """probes with the first event strictly after t (null if none)."""
    sides = probes.withColumns({"_ts": F.col(t), "_event": F.lit(0), out: F.lit(None).cast("timestamp_ntz")})
    other = events.select(key, F.col(ts).alias("_ts"), F.lit(1).alias("_event"), F.col(ts).alias(out))
    both = sides.unionByName(other, allowMissingColumns=True)
    # Going back in time, probes come before the events of their own instant.
    order = Window.partitionBy(key).orderBy(F.desc("_ts"), "_event").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(out, F.last(out, ignorenulls=True).over(order)).filter("_event = 0").drop("_ts", "_event")


def next_of_days(spans: DataFrame, events: DataFrame, key: str, ts: str, out: str) -> DataFrame:
    """spans (key, _first, _last: a midnight and the last instant), cut where what next_after() gives at their midnights changes; midnights without a later event are left out."""
    order = Window.partitionBy(key).orderBy(ts)
    steps = events.filter(F.col(ts).isNotNull()).select(F.col(key).alias("_key"), F.col(ts).alias(out), F.lag(ts).over(order).alias("_from"))
    # As many rows as come of a span can't be told from sizes of files.
    met = spans.join(steps.hint("merge"), (F.col(key) == F.col("_key")) & F.coalesce(F.col("_from") <= F.col("_last"), F.lit(True)) & (F.col(out) > F.col("_first")))
    met = met.withColumns({"_first": time.first_midnight(F.greatest("_first", "_from")), "_last": F.least(F.col("_last"), F.col(out) - F.expr("interval 1 microsecond"))})
    return met.filter("_first <= _last").select(*spans.columns, out)


def in_force(probes: DataFrame, events: DataFrame, key: str, t: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """probes with the columns of the latest event at or before t (nulls if none); of equal times the largest tie."""
    state = F.struct(*columns)
    sides = probes.withColumns({"_ts": F.col(t), "_event": F.lit(1), "_tie": F.lit(None).cast(events.schema[tie].dataType)})
    other = events.select(key, F.col(ts).alias("_ts"), F.lit(0).alias("_event"), F.col(tie).alias("_tie"), state.alias("_state"))
    both = sides.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_ts", "_event", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumn("_state", F.last("_state", ignorenulls=True).over(order)).filter("_event = 1")
    return done.select(*probes.columns, *(F.col(f"_state.{c}").alias(c) for c in columns))
