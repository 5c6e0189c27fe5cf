"""Comparisons of two groups of values."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.math import two_sided
from tidewater.operators import quantiles

#: Groups of so many values together get exact p-values, if no two values are equal.
EXACT = 16


@cache
def null_counts(n1: int, n2: int) -> tuple[int, ...]:
    """In how many of the orders of n1 and n2 values U is 0, 1, ..., n1 * n2: the largest value is of the first group (and beats n2 others), or of the second."""
    if not n1 or not n2:
        return (1,)
    first, second = null_counts(n1 - 1, n2), null_counts(n1, n2 - 1)
    at = lambda c, u: c[u] if 0 <= u < len(c) else 0
    return tuple(at(first, u - n2) + at(second, u) for u in range(n1 * n2 + 1))


def exact_p_values(n: int = EXACT) -> list[tuple[int, int, float, float]]:
    """n1, n2, u, two-sided p-value for all groups of n values together at most: twice the smaller tail, 1 at most."""
    out = []
    for n1 in range(1, n):
        for n2 in range(1, n - n1 + 1):
            counts = null_counts(n1, n2)
            low, total = 0, sum(counts)
            for u, c in enumerate(counts):
                low += c
                out.append((n1, n2, float(u), min(1.0, 2 * min(low, total - low + c) / total)))
    return out


def mann_whitney(values: DataFrame, keys: list[str], side: str, first, second, alpha: float = 0.05) -> DataFrame:
    """keys, n1, n2, u1, z, p_value, differ, mean1, mean2, median1, median2: two-sample rank test with ties averaged and the variance corrected for ties.

    p_value is two-sided: exact where both sides have EXACT values together at most and none is equal to another, else by
    the normal approximation; differ: below alpha. Both are null where z is (one side is empty, all values are equal).
    Ranks and medians come from counts per distinct value, ordered in ranges of bounded size. Null values don't count.
    """
    a, b = F.col(side) == F.lit(first), F.col(side) == F.lit(second)
    rows = values.filter("value is not null").filter(a | b)
    counts = quantiles.counted(rows, keys, "value", c1=F.count_if(a))
    ranked = quantiles.below(counts, keys).withColumn("rank", F.col("below") + (F.col("c") + 1) / 2).withColumns({"c": F.col("c").cast("double"), "c1": F.col("c1").cast("double")})
    ties = F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties")
    total = ranked.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c").alias("n"), F.sum(F.col("c1") * F.col("rank")).alias("r1"), ties)
    n1, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    tests = total.select(*keys, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u1"), "ties", F.try_divide(u - n1 * n2 / 2, spread).alias("z"))
    exact = values.sparkSession.createDataFrame(exact_p_values(), "_n1 long, _n2 long, _u double, _p double")
    small = (F.col("n1") == F.col("_n1")) & (F.col("n2") == F.col("_n2")) & (F.col("u1") == F.col("_u")) & (F.col("ties") == 0)
    tests = tests.join(F.broadcast(exact), small, "left")  # some thousand rows, however many values there are
    tests = tests.withColumn("p_value", F.coalesce("_p", two_sided(F.col("z")))).withColumn("differ", F.col("p_value") < alpha).drop("ties", "_n1", "_n2", "_u", "_p")
    of_side = counts.select(*keys, "value", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("c1").alias("c")), F.struct(F.lit(2).alias("side"), (F.col("c") - F.col("c1")).alias("c")))).alias("_s")).select(*keys, "value", "_s.*").filter("c > 0")
    told = quantiles.described(of_side, [*keys, "side"], [50.0])
    parts = [F.max(F.when(F.col("side") == k, x)).alias(f"{name}{k}") for k in (1, 2) for name, x in (("mean", F.col("mean")), ("median", F.get("quantiles", F.lit(0))))]
    return quantiles.joined(tests, told.groupBy(*keys).agg(*parts), keys)


def shares(rows: DataFrame, key: str) -> DataFrame:
    """key, n, percent of all; the window holds a row per key."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))
