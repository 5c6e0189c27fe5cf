"""Lifetimes of decided changes: histograms, summaries, box plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import time
from tidewater.operators import quantiles
from tidewater.operators.changes import DECIDED

# The groups of statuses that are analysed side by side.
GROUPS = {"merged": ["MERGED"], "abandoned": ["ABANDONED"], "all": ["MERGED", "ABANDONED"]}


def in_cycles(changes: DataFrame, cycles: DataFrame, lookback_days: float) -> DataFrame:
    """Changes created in a cycle or within the lookback before it; one row per change and cycle. Needs project.

    A project's cycles are few: they travel as one array and each change picks its own.
    """
    listed = cycles.groupBy("project").agg(F.collect_list(F.struct("version", "cycle_start", "cycle_end")).alias("_cycles"))
    mine = F.filter("_cycles", lambda c: (F.col("created") >= c["cycle_start"] - F.make_dt_interval(days=F.lit(int(lookback_days)))) & (F.col("created") <= c["cycle_end"]))
    rows = changes.join(listed, "project")  # a row per project; Spark broadcasts it if it is small
    return rows.withColumn("_c", F.explode(mine)).select(*changes.columns, "_c.version", "_c.cycle_start", "_c.cycle_end")


def lifetimes(pool: DataFrame, unit: str = "days") -> DataFrame:
    """version, grp, change_number, value of decided changes with a positive lifetime, once per status group."""
    groups = F.array(*(F.struct(F.lit(g).alias("grp"), F.array(*(F.lit(s) for s in statuses)).alias("statuses")) for g, statuses in GROUPS.items()))
    decided = pool.filter(F.col("status").isin(*DECIDED)).withColumn("value", time.between("created", "updated", unit)).filter("value > 0")
    mine = F.filter(groups, lambda g: F.array_contains(g["statuses"], F.col("status")))
    return decided.withColumn("_g", F.explode(mine)).select("version", F.col("_g.grp").alias("grp"), "change_number", "value")


def undecided(pool: DataFrame) -> DataFrame:
    return pool.groupBy("version").agg(F.count_if(~F.coalesce(F.col("status").isin(*DECIDED), F.lit(False))).alias("n_excluded_unfinished"))


def first_occurrence(values: DataFrame, order: DataFrame) -> DataFrame:
    """Each change once per group, in the first release of an order (version, release_ord)."""
    first = Window.partitionBy("grp", "change_number").orderBy("release_ord")
    return values.join(order, "version").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "release_ord")  # order: a row per release


def histogram(values: DataFrame, keys: list[str], bins: int = 50, log_bins: bool = True, min_value: float | None = None) -> DataFrame:
    """keys, bin, bin_left, bin_right, count: bins equal in width or in the logarithm; the last one is closed; values below min_value don't count.

    A group's edges are one array; a value's bin is how many edges it reaches, so all values are compared with the same doubles.
    """
    rows = values.filter("value is not null" + (" and value > 0" if log_bins else ""))
    ends = rows.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    low = F.lit(float(min_value)) if min_value is not None and (min_value > 0 or not log_bins) else F.col("_lo")
    ends = ends.withColumn("_lo", low).withColumn("_hi", F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") * 10 if log_bins else F.col("_lo") + 1).otherwise(F.col("_hi")))
    a, b = (F.log10("_lo"), F.log10("_hi")) if log_bins else (F.col("_lo"), F.col("_hi"))
    at = lambda i: F.pow(F.lit(10.0), a + (b - a) * i / bins) if log_bins else a + (b - a) * i / bins
    # The ends are the very smallest and largest value, not what comes back from their logarithms.
    inner = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), at) if bins > 1 else F.array().cast("array<double>")
    edges = ends.select(*keys, F.concat(F.array("_lo"), inner, F.array("_hi")).alias("_edges"))
    placed = rows.join(edges, keys).withColumn("bin", F.least(F.size(F.filter("_edges", lambda e: e <= F.col("value"))), F.lit(bins)) - 1).filter((F.col("bin") >= 0) & (F.col("value") <= F.element_at("_edges", -1)))
    counted = placed.groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    frame = edges.select(*keys, "_edges", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counted, [*keys, "bin"], "left").select(*keys, "bin", F.get("_edges", "bin").alias("bin_left"), F.get("_edges", F.col("bin") + 1).alias("bin_right"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def summarize(values: DataFrame, keys: list[str], percents: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """keys, n, mean, median, min, max, p..: nulls where a group is empty."""
    out = quantiles.described(quantiles.counted(values, keys, "value"), keys, [50.0, *map(float, percents)])
    at = lambda i: F.get("quantiles", F.lit(i))
    return out.select(*keys, "n", "mean", at(0).alias("median"), "min", "max", *(at(k + 1).alias(f"p{q}") for k, q in enumerate(percents)))


def box_plot(values: DataFrame, keys: list[str], k: float = 1.5) -> DataFrame:
    """keys, n, q1, median, q3, low and high whisker (the outermost values within k interquartile ranges), n_fliers."""
    counts = quantiles.counted(values, keys, "value")
    at = lambda i: F.get("quantiles", F.lit(i))
    q = quantiles.select(counts, keys, [25.0, 50.0, 75.0]).select(*keys, at(0).alias("q1"), at(1).alias("median"), at(2).alias("q3"))
    inside = (F.col("value") >= F.col("q1") - k * (F.col("q3") - F.col("q1"))) & (F.col("value") <= F.col("q3") + k * (F.col("q3") - F.col("q1")))
    met = quantiles.joined(counts, q, keys).groupBy(*keys, "q1", "median", "q3")
    return met.agg(F.sum("c").alias("n"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.sum(F.when(inside, 0).otherwise(F.col("c"))).alias("n_fliers"))
