"""The analyses end to end, each one plan over all releases and groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import changes, dataset, distribution, drift, lifetime, metrics, model
from tidewater.sources import sinks


def lifetimes(all_changes: DataFrame, cycles: DataFrame, lookback_days: int = 365, bins: int = 50, unit: str = "days") -> dict[str, DataFrame]:
    """values, histogram, summary, boxplot, excluded by release and group; mixed: each change once, over all releases."""
    pool = lifetime.in_cycles(all_changes, cycles, lookback_days)
    values = lifetime.lifetimes(pool, unit)
    order = cycles.select("version", F.row_number().over(Window.orderBy("cycle_end", "version")).alias("release_ord"))  # a row per release
    mixed = lifetime.first_occurrence(values, order)
    keys = ["version", "grp"]
    return {
        "values": values, "histogram": lifetime.histogram(values, keys, bins), "summary": lifetime.summarize(values, keys), "boxplot": lifetime.box_plot(values, keys), "excluded": lifetime.undecided(pool),
        "mixed_histogram": lifetime.histogram(mixed, ["grp"], bins), "mixed_summary": lifetime.summarize(mixed, ["grp"]),
    }


def waiting(all_changes: DataFrame, cycles: DataFrame, metric: str, lookback_days: int = 365, unit: str = "days", method: str = "iqr", n_bins: int = 0) -> dict[str, DataFrame]:
    """points by release, the same over all releases (binned if n_bins is set), and how many changes were left out. Changes need what the metric reads."""
    pool = distribution.screened(lifetime.in_cycles(all_changes, cycles, lookback_days), metric)
    kept = distribution.drop_outliers(distribution.drop_unfinished(pool), ["version"], method)
    active = changes.active_days(kept, F.col("cycle_start"), F.col("cycle_end"), lookback_days, undecided=False)
    points = distribution.points(active, ["version"], distribution.waiting(metric, F.col("t"), unit), F.col("cycle_start"), F.col("cycle_end"))
    return {"points": points, "mixed": distribution.bin_points(points, n_bins), "exclusions": distribution.exclusions(pool, ["version"], method)}


def records(all_changes: DataFrame, cycles: DataFrame, features, label: str = "time_to_next_review", unit: str = "hours", bins: int = 6, alike: list[str] | None = None) -> DataFrame:
    """Records of all releases: open changes of a cycle and of the span as long before it, by day, with features, label and bin.

    features: a function from (change, t) rows to rows with features. alike: only these columns are wanted; records that
    agree in them are one row then, and n_alike their number.
    """
    open_ = changes.active_days(_pool(all_changes, cycles), _span_start(), F.col("cycle_end"), None, alike=alike)
    return dataset.with_bins(dataset.labelled(features(open_), label, unit), F.col("cycle_start"), F.col("cycle_end"), bins)


def record_spans(all_changes: DataFrame, cycles: DataFrame, labels, bins: int = 6) -> DataFrame:
    """records() as spans of days (_first, _last), which days don't multiply: version, change_number, owner_id, created, bin and what the label is made of.

    labels: a function from spans to spans of labelled days, with the columns of the label (asof.next_of_days).
    """
    open_ = changes.open_spans(_pool(all_changes, cycles), _span_start(), F.col("cycle_end"), None)
    rows = dataset.span_bins(labels(open_), F.col("cycle_start"), F.col("cycle_end"), bins)
    return rows.drop("project", "cycle_start", "cycle_end")


def _span_start():
    return F.col("cycle_start") - (F.col("cycle_end") - F.col("cycle_start"))


def _pool(all_changes: DataFrame, cycles: DataFrame) -> DataFrame:
    """Changes by release: those made in its cycle or in the span as long before it."""
    listed = cycles.withColumn("_from", _span_start()).groupBy("project").agg(F.collect_list(F.struct("version", "cycle_start", "cycle_end", "_from")).alias("_c"))
    own = F.filter("_c", lambda c: (F.col("created") >= c["_from"]) & (F.col("created") <= c["cycle_end"]))  # before releases multiply changes
    pool = all_changes.join(listed, "project").withColumn("_c", F.explode(own))  # a row per project
    return pool.select(*all_changes.columns, *(F.col(f"_c.{c}").alias(c) for c in ("version", "cycle_start", "cycle_end")))


def analyze(all_changes: DataFrame, cycles: DataFrame, features, names: list[str], path: str, models: tuple[str, ...] = ("gradient_boosting", "random_forest"), label: str = "time_to_next_review",
            n_train: int = 400, n_eval: int = 100, repeats: int = 10, bins: int = 6, trees: int = 200, permutations: int = 1000, alpha: float = 0.05, seed: int = 42, late=None, labels=None) -> dict[str, DataFrame]:
    """The drift analysis of all models, releases and metrics: predictions, matrix, relative, tests, found, count (of releases, by model and metric).

    features gives (change, t) rows the columns in names; what only fits need may come from late instead, which is
    asked for the sampled (change_number, owner_id, created, t) alone. Records, samples and predictions are tables under path; what
    comes of them is written there too. A release without enough changes for a cell has no predictions there.
    With labels in place of features, records are spans (see record_spans()), and all features come late.
    """
    spark, keys = all_changes.sparkSession, ["version"]
    rows = record_spans(all_changes, cycles, labels, bins) if labels else records(all_changes, cycles, features, label, "hours", bins)
    rows = rows.withColumnRenamed("change_number", "change_id")
    rows.write.mode("overwrite").parquet(f"{path}/records")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/records")
    pairs = spark.createDataFrame([(d, p, i, j) for p, d, i, j in dataset.cells(bins)], "d int, p int, i int, j int")
    chosen = dataset.split(dataset.layers(rows, pairs, keys), n_train, n_eval, repeats, seed, keys)
    made = dataset.samples(rows, chosen, pairs, keys)
    if labels:
        made = dataset.labelled(made, label)
    if late:
        made.write.mode("overwrite").parquet(f"{path}/drawn")  # what comes late reads them several times
        made = spark.read.schema(made.schema).parquet(f"{path}/drawn")
        asked = made.select(F.col("change_id").alias("change_number"), "owner_id", "created", "t").distinct()
        known = late(asked).drop("owner_id", "created").withColumnRenamed("change_number", "change_id")
        made = made.join(known.hint("merge"), ["change_id", "t"])
    made.write.mode("overwrite").parquet(f"{path}/samples")
    made = spark.read.schema(made.schema).parquet(f"{path}/samples")
    predictions = model.all_cells(made, names, list(models), keys, seed, trees)
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    predictions = spark.read.schema(predictions.schema).parquet(f"{path}/predictions")
    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    out = recompute(predictions, ["model", "version"], permutations, alpha, keep)
    out["count"] = drift.drift_count(out["found"], ["model", "metric"])
    sinks.table(out["matrix"], f"{path}/matrix")
    sinks.drift_test(out["tests"], f"{path}/tests")
    sinks.drift_count(out["found"], out["count"], f"{path}/count")
    return {"predictions": predictions, **out}


def recompute(predictions: DataFrame, keys: list[str] | None = None, permutations: int = 1000, alpha: float = 0.05, keep=lambda df, name: df) -> dict[str, DataFrame]:
    """Matrices, tests, findings and counts from saved predictions, without any model. keys: what tells runs apart (a model, a release).

    keep may write a table under a name and read it again, so that what follows doesn't compute it anew.
    """
    keys = keys or []
    matrix = keep(metrics.matrices(predictions, [*keys, "d", "p", "repeat"]), "matrix-rows")
    tests = keep(drift.permutation_test(drift.series(matrix, [*keys, "metric", "d"]), [*keys, "metric", "d"], permutations), "test-rows")
    found = drift.drift_exists(tests, [*keys, "metric"], alpha)
    return {"matrix": matrix, "relative": metrics.relative(matrix), "tests": tests, "found": found, "count": drift.drift_count(found, ["metric"])}
