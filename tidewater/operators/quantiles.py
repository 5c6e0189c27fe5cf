"""Exact quantiles and ranks in groups of any size, by distributed selection.

Equal values of a group are counted before anything is ordered, and the counts are written once. Cuts taken from a
sketch of all distinct values divide them into ranges; every range of a group is a bounded share of all rows, however
large the group is. The totals of a group's ranges (few rows) tell which of them hold the wanted ranks, and only those
are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.scratch import written

CUTS = 63  # so a range holds a 64th of all distinct values at most
PARTS = 4  # of equal width, into which the ranges between two cuts are divided


def counted(rows: DataFrame, keys: list[str], value: str, times: str | None = None, **sums: Column) -> DataFrame:
    """keys, value, c (how often each value that is not null occurs in each group) and further aggregates: a table, as it is read several times.

    times: a column that says for how many rows each row stands.
    """
    c = F.sum(times) if times else F.count("*")
    return written(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(c.alias("c"), *(f.alias(n) for n, f in sums.items())), "counts")


def _ranges(counts: DataFrame, value: str) -> DataFrame:
    """counts with _range, which rises with the value: by a search among cuts, and by its place between two of them."""
    cuts = counts.agg(F.percentile_approx(value, [k / (CUTS + 1) for k in range(1, CUTS + 1)], F.lit(40 * CUTS))).first()[0]
    cuts = sorted({float(c) for c in cuts or [0.0]})

    def search(low: int, high: int) -> str:
        mid = (low + high) // 2
        return str(low) if low == high else f"case when `{value}` < double('{cuts[mid]!r}') then {search(low, mid)} else {search(mid + 1, high)} end"

    placed = counts.withColumn("_cut", F.expr(search(0, len(cuts))))
    low, high = F.get(F.lit(cuts), F.greatest(F.col("_cut") - 1, F.lit(0))), F.get(F.lit(cuts), F.col("_cut"))
    share = F.floor((F.col(value) - low) / (high - low) * PARTS)
    part = F.when((F.col("_cut") > 0) & (F.col("_cut") < len(cuts)), F.least(F.greatest(share, F.lit(0)), F.lit(PARTS - 1))).otherwise(F.lit(0))
    return placed.withColumn("_range", F.col("_cut") * PARTS + part.cast("int")).drop("_cut")


def _earlier(placed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _range, _c, _before (values in earlier ranges), n (in all): as many rows a group as there are ranges."""
    by_range = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_range").agg(F.sum("c").alias("_c"))
    return totals.withColumns({"_before": F.coalesce(F.sum("_c").over(by_range), F.lit(0).cast("long")), "n": F.sum("_c").over(Window.partitionBy(*keys))})


def select(counts: DataFrame, keys: list[str], percents: list[float], value: str = "value") -> DataFrame:
    """keys, n, quantiles: an array with the quantile of each percent (0 to 100), between two values by their distance in rank.

    counts: what counted() returns, or such a table. Groups without values give no row; null keys are a group.
    """
    placed = _ranges(counts.select(*keys, value, "c"), value)
    place = lambda p: (F.col("n") - 1) * F.lit(p / 100.0)
    ranks = F.array(*(r(place(p)).cast("long") for p in percents for r in (F.floor, F.ceil)))
    wanted = F.array_distinct(F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))))
    holding = _earlier(placed, keys).select(*keys, "_range", "_before", "n", wanted.alias("_ranks")).filter(F.size("_ranks") > 0)
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = joined(placed.select(*keys, "_range", value, "c"), holding, [*keys, "_range"]).withColumn("_upto", F.col("_before") + F.sum("c").over(inside))
    mine = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("c")) & (r < F.col("_upto")))
    found = held.withColumn("_rank", F.explode(mine)).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("_at"))  # two entries a percent at most

    def between(p: float) -> Column:
        low, high = (F.try_element_at("_at", r(place(p)).cast("long")) for r in (F.floor, F.ceil))
        share = place(p) - F.floor(place(p))
        return F.when(share == 0, low).otherwise(low * (1 - share) + high * share)

    return found.select(*keys, "n", F.array(*(between(p) for p in percents)).alias("quantiles"))


def described(counts: DataFrame, keys: list[str], percents: list[float], value: str = "value") -> DataFrame:
    """As select(), with mean, std (of the population, about that mean), min and max."""
    c, v = F.col("c"), F.col(value)
    means = counts.groupBy(*keys).agg((F.sum(c * v) / F.sum(c)).alias("mean"))
    centred = joined(counts, means, keys).withColumn("_d", v - F.col("mean"))
    told = centred.groupBy(*keys, "mean").agg(F.sqrt(F.sum(c * F.col("_d") * F.col("_d")) / F.sum(c)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return joined(select(counts, keys, percents, value), told, keys)


def below(counts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """counts with below: how many values of the group are smaller."""
    placed = _ranges(counts, value)
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = joined(placed, _earlier(placed, keys).drop("_c", "n"), [*keys, "_range"])
    return out.withColumn("below", F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0).cast("long"))).drop("_before", "_range")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; right has one row for each value of the keys."""
    named = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(named, same, how).drop(*(f"_k{i}" for i in range(len(keys))))
