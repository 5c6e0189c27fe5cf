"""Whether a metric changes along the positions of a cycle: a change-point statistic with a permutation test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos (from 1), value of the filled positions of each distance; shorter than three are left out."""
    w = Window.partitionBy(*keys)
    rows = matrix.filter("value is not null").withColumns({"pos": F.row_number().over(w.orderBy("p")), "_n": F.count("*").over(w)})
    return rows.filter("_n >= 3").select(*keys, "pos", "value")


def change_point(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, statistic, split: the largest difference of the means before and after a position, and the first one that has it."""
    w = Window.partitionBy(*keys).orderBy("pos")
    before, after = F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.avg("value").over(w.rowsBetween(1, Window.unboundedFollowing))
    stats = rows.withColumn("_s", F.round(F.abs(before - after), 12)).filter("_s is not null")
    best = stats.groupBy(*keys).agg(F.max(F.struct(F.col("_s"), (-F.col("pos")).alias("_p"))).alias("_b"))
    return best.select(*keys, F.col("_b._s").alias("statistic"), (-F.col("_b._p")).alias("split"))


def permutation_test(rows: DataFrame, keys: list[str], permutations: int = 1000, seed: int = 42) -> DataFrame:
    """keys, statistic, p_value: share of shuffles (values in the order of md5(seed, shuffle, position)) whose statistic is as large, the observed one counted in."""
    seen = change_point(rows, keys)
    shuffled = rows.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("perm").cast("string"), F.col("pos").cast("string")))
    shuffled = shuffled.withColumn("pos", F.row_number().over(Window.partitionBy(*keys, "perm").orderBy(draw, "pos")))
    drawn = change_point(shuffled, [*keys, "perm"]).withColumnRenamed("statistic", "_drawn")
    out = drawn.join(seen, keys).groupBy(*keys, "statistic").agg(F.count_if(F.col("_drawn") >= F.col("statistic")).alias("_k"))
    return out.select(*keys, "statistic", ((F.col("_k") + 1) / F.lit(permutations + 1.0)).alias("p_value"))


def drift_exists(tests: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """keys, drift_exists, min_p_value over the distances of a metric."""
    return tests.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("p_value") < alpha), F.lit(False)).alias("drift_exists"), F.min("p_value").alias("min_p_value"))


def drift_count(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, k, ratio: how many of the releases show drift; no ratio without releases."""
    return found.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("drift_exists").alias("k")).withColumn("ratio", F.try_divide(F.col("k").cast("double"), F.col("n").cast("double")))
