"""Waiting-time distributions over the days of a release cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import time
from tidewater.operators import quantiles

PERCENTS = (10, 30, 50, 70, 90)

#: How long a change waits, seen from t, and what is screened for outliers before. More can be added.
WAITING = {
    "time_to_next_review": {"value": lambda t: (t, F.col("next_review")), "screening": lambda: (F.col("created"), F.col("first_review"))},
    "time_to_decision": {"value": lambda t: (t, F.col("decision_time")), "screening": lambda: (F.col("created"), F.col("decision_time"))},
}


def screened(changes: DataFrame, metric: str) -> DataFrame:
    """changes with screening (seconds): null where the metric is undefined."""
    return changes.withColumn("screening", time.between(*WAITING[metric]["screening"](), "seconds"))


def waiting(metric: str, t: Column, unit: str) -> Column:
    return time.between(*WAITING[metric]["value"](t), unit)


def drop_unfinished(rows: DataFrame) -> DataFrame:
    return rows.na.drop(subset=["decision_time", "screening"])


def outlier_bounds(rows: DataFrame, keys: list[str], method: str = "iqr", k: float = 1.5, percent: float = 99.0) -> DataFrame:
    """keys, low, high of what is kept; groups of fewer than four values keep everything."""
    q = lambda i: F.get("quantiles", F.lit(i))
    if method == "iqr":
        wanted, low, high = [25.0, 75.0], q(0) - k * (q(1) - q(0)), q(1) + k * (q(1) - q(0))
    elif method == "percentile":
        wanted, low, high = [100.0 - percent, percent], q(0), q(1)
    else:
        raise ValueError(f"unknown method: {method}")
    found = quantiles.select(quantiles.counted(rows, keys, "screening"), keys, wanted, "screening")
    few, inf = F.col("n") < 4, F.lit(float("inf"))
    return found.select(*keys, F.when(few, -inf).otherwise(low).alias("low"), F.when(few, inf).otherwise(high).alias("high"))


def drop_outliers(rows: DataFrame, keys: list[str], method: str = "iqr", k: float = 1.5, percent: float = 99.0) -> DataFrame:
    """Rows whose screening lies within the bounds of their group, both included."""
    if method == "none":
        return rows
    return rows.join(outlier_bounds(rows, keys, method, k, percent), keys).filter("screening between low and high").drop("low", "high")


def exclusions(pool: DataFrame, keys: list[str], method: str = "iqr") -> DataFrame:
    """keys, n_total, n_dropped_unfinished, n_dropped_outliers."""
    finished = drop_unfinished(pool)
    total = pool.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if(F.col("decision_time").isNotNull() & F.col("screening").isNotNull()).alias("_n"))
    kept = drop_outliers(finished, keys, method).groupBy(*keys).agg(F.count("*").alias("_k"))
    return total.join(kept, keys, "left").select(*keys, "n_total", (F.col("n_total") - F.col("_n")).alias("n_dropped_unfinished"), (F.col("_n") - F.coalesce("_k", F.lit(0))).alias("n_dropped_outliers"))


def points(active: DataFrame, keys: list[str], value: Column, start: Column, end: Column, mode: str = "normalized", min_active: int = 1, std_factor: float = 1.0, percents: tuple[int, ...] = PERCENTS, times: str | None = None) -> DataFrame:
    """keys, x, timestamp, n_active, mean, std, lower, upper, p..: one row per day t with enough values (as many as percentiles at least).

    times: a column that says for how many changes a row stands.
    """
    # Changes that wait equally long at a time are one row from here on.
    rows = active.select(*keys, "t", start.alias("_start"), end.alias("_end"), value.alias("_v"), *([times] if times else []))
    group = [*keys, "t", "_start", "_end"]
    out = quantiles.described(quantiles.counted(rows, group, "_v", times), group, [float(q) for q in percents], "_v")
    out = out.filter(F.col("n") >= max(min_active, len(percents)))
    half = F.col("std") * std_factor
    return out.select(
        *keys, time.relative_x(F.col("t"), F.col("_start"), F.col("_end"), mode).alias("x"), F.col("t").alias("timestamp"), F.col("n").alias("n_active"), "mean", "std",
        (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"), *(F.get("quantiles", F.lit(k)).alias(f"p{q}") for k, q in enumerate(percents)),
    )


def bin_points(rows: DataFrame, n_bins: int, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """All points in n_bins of equal width over x, the last one closed: means of the points, the middle one's time, empty bins left out. n_bins < 1 changes nothing."""
    if n_bins < 1:
        return rows
    ends = rows.agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    edge = lambda i: F.col("_a") + (F.col("_b") - F.col("_a")) * i / n_bins
    edges = ends.select(F.concat(F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), edge), F.array("_b")).alias("_edges"))
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.size(F.filter("_edges", lambda e: e <= F.col("x"))), F.lit(n_bins)) - 1)  # one row of edges
    middle = F.array_sort(F.collect_list(F.struct("x", "timestamp")))
    out = placed.groupBy("bin", "_edges").agg(middle.alias("_m"), F.sum("n_active").alias("n_active"), F.avg("mean").alias("_mean"), F.stddev_pop("mean").alias("std"), F.avg("lower").alias("lower"), F.avg("upper").alias("upper"), *(F.avg(f"p{q}").alias(f"p{q}") for q in percents))
    return out.select("bin", ((F.get("_edges", "bin") + F.get("_edges", F.col("bin") + 1)) / 2).alias("x"), F.get("_m", F.floor(F.size("_m") / 2).cast("int"))["timestamp"].alias("timestamp"), "n_active", F.col("_mean").alias("mean"), "std", "lower", "upper", *(f"p{q}" for q in percents), F.lit("mixed").alias("release_version"))
