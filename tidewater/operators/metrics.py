"""Metrics from saved predictions: d, p, repeat, t, change_id, y_true, y_pred (hours)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.math import log10_hours, wait_class

CELL = ["d", "p", "repeat"]
RANK_METRICS = ("rank_mae", "rank_rmse", "ndcg")
REGRESSION = ("mae_log", "rmse_log", "r2_log")
CLASSES = ("macro_f1", "micro_f1", "qwk")
HIGHER_IS_BETTER = ("ndcg", "r2_log", "macro_f1", "micro_f1", "qwk")
LABELS = 4


def mid_rank(value: str, group: list[str]) -> Column:
    """Ascending rank in the group, ties averaged, from 0 to 1."""
    w = Window.partitionBy(*group)
    ties = F.count("*").over(Window.partitionBy(*group, value))
    return (F.rank().over(w.orderBy(value)) + (ties - 1) / 2 - 1) / F.nullif(F.count("*").over(w) - 1, F.lit(0))


def rank_metrics(predictions: DataFrame, keys: list[str] | None = None, n: int = 10) -> DataFrame:
    """keys, t, rank_mae, rank_rmse, ndcg of every t with two records or more. Ties in order are broken by change_id."""
    group = [*(keys or CELL), "t"]
    w = Window.partitionBy(*group)
    rows = predictions.withColumns({
        "_size": F.count("*").over(w), "_a": mid_rank("y_true", group), "_b": mid_rank("y_pred", group),
        "_true": F.row_number().over(w.orderBy("y_true", "change_id")), "_place": F.row_number().over(w.orderBy("y_pred", "change_id")),
    }).filter("_size >= 2")
    relevance, discount = F.col("_size") - F.col("_true") + 1, lambda c: F.log2(F.col(c) + F.lit(1.0))
    gained = F.sum(F.when(F.col("_place") <= n, relevance / discount("_place")))
    ideal = F.sum(F.when(F.col("_true") <= n, relevance / discount("_true")))
    delta = F.col("_a") - F.col("_b")
    return rows.groupBy(*group).agg(F.avg(F.abs(delta)).alias("rank_mae"), F.sqrt(F.avg(delta * delta)).alias("rank_rmse"), F.coalesce(F.try_divide(gained, ideal), F.lit(0.0)).alias("ndcg"))


def regression_metrics(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, mae_log, rmse_log, r2_log (null for a constant truth) over log10(1 + hours), all records of a repeat together."""
    rows = predictions.withColumns({"_a": log10_hours(F.col("y_true")), "_b": log10_hours(F.col("y_pred"))})
    d = F.col("_a") - F.col("_b")
    out = rows.groupBy(*(keys or CELL)).agg(F.avg(F.abs(d)).alias("mae_log"), F.avg(d * d).alias("_mse"), F.var_pop("_a").alias("_var"), (F.min("_a") == F.max("_a")).alias("_flat"))
    return out.select(*(keys or CELL), "mae_log", F.sqrt("_mse").alias("rmse_log"), F.when(~F.col("_flat"), 1 - F.try_divide(F.col("_mse"), F.col("_var"))).alias("r2_log"))


def class_metrics(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, macro_f1 (over all four classes, 0 for an empty one), micro_f1, qwk (null for one true class) of waiting classes."""
    keys = keys or CELL
    rows = predictions.select(*keys, wait_class(F.col("y_true")).alias("a"), wait_class(F.col("y_pred")).alias("b"))
    n, f1 = F.count("*").cast("double"), []
    for k in range(LABELS):
        hit, either = F.count_if((F.col("a") == k) & (F.col("b") == k)), F.count_if(F.col("a") == k) + F.count_if(F.col("b") == k)
        f1.append(F.coalesce(F.try_divide(2.0 * hit, either), F.lit(0.0)))
    seen = F.avg(F.pow(F.col("a") - F.col("b"), 2))
    # Chance disagreement: the mean of (a - b)^2 over independent margins.
    chance = F.avg(F.pow("a", 2)) + F.avg(F.pow("b", 2)) - 2 * F.avg("a") * F.avg("b")
    return rows.groupBy(*keys).agg((sum(f1) / LABELS).alias("macro_f1"), (F.count_if(F.col("a") == F.col("b")) / n).alias("micro_f1"), F.when(F.min("a") < F.max("a"), 1 - F.try_divide(seen, chance)).alias("qwk"))


#: Metrics by family: the function, its columns, and whether it gives a row per t, of which a repeat takes the median. More can be added.
FAMILIES = {"rank": (rank_metrics, RANK_METRICS, True), "regression": (regression_metrics, REGRESSION, False), "class": (class_metrics, CLASSES, False)}


def long(rows: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    return rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))).alias("x")).select(*keys, "x.*")


def per_repeat(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, metric, value of all families: those with a row per t give their median, the others take a repeat's records together; nulls left out."""
    keys, out = keys or CELL, None
    for measure, names, by_t in FAMILIES.values():
        rows = long(measure(predictions, keys), keys, names)
        if by_t:
            rows = rows.groupBy(*keys, "metric").agg(F.median("value").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter("value is not null")


def matrices(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """metric, d, p, value (median over repeats), iqr, per_repeat: the one way from predictions to results, first run or recomputed."""
    keys = keys or CELL
    cell = [k for k in keys if k != "repeat"]
    quarter = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    out = per_repeat(predictions, keys).groupBy("metric", *cell).agg(F.median("value").alias("value"), quarter.alias("_q"), F.array_sort(F.collect_list(F.struct("repeat", "value"))).alias("_r"))
    return out.select("metric", *cell, "value", (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))).alias("iqr"), F.col("_r.value").alias("per_repeat"))


def relative(matrix: DataFrame) -> DataFrame:
    """matrix with goodness (1 - value where less is better) and its share of the metric's best."""
    good = F.when(F.col("metric").isin(*HIGHER_IS_BETTER), F.col("value")).otherwise(1 - F.col("value"))
    return matrix.withColumn("goodness", good).withColumn("relative", F.try_divide(F.col("goodness"), F.max("goodness").over(Window.partitionBy("metric"))))
