"""Writers. All of them write folders of part files, except where one small record is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, form: str = "parquet", partition: list[str] | None = None, mode: str = "overwrite") -> bool:
    """Writes a non-empty table; an empty one leaves no files. Returns whether anything was written."""
    if df.isEmpty():
        return False
    writer = df.write.mode(mode).partitionBy(*(partition or []))
    {"parquet": writer.parquet, "json": writer.json, "csv": writer.option("header", True).csv}[form](path)
    return True


def document(meta: dict, rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One row of JSON: the given facts, and the rows of a small result (a distribution, histogram or test) as an array in order."""
    listed = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_order"), F.struct(*rows.columns).alias("_row")))), lambda x: x["_row"]).alias(name))
    return listed.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in meta.items()), name)).alias("value"))


def distribution(points: DataFrame, path: str, meta: dict) -> None:
    points.orderBy("x").write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    document(meta, points, "points", ["x"]).write.mode("overwrite").text(f"{path}/json")


def histogram(bins: DataFrame, summary: DataFrame, path: str, meta: dict) -> None:
    bins.orderBy("bin_left").write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    facts = document(meta, bins, "bins", ["bin_left"]).withColumnRenamed("value", "histogram").crossJoin(summary.select(F.to_json(F.struct("*")).alias("summary")))
    facts.write.mode("overwrite").json(f"{path}/json")


def wide(matrix: DataFrame, positions: int) -> DataFrame:
    """metric, d, p1 ... of a long matrix; gaps are null."""
    return matrix.groupBy("metric", "d").pivot("p", list(range(1, positions + 1))).agg(F.first("value")).withColumnsRenamed({str(p): f"p{p}" for p in range(1, positions + 1)})


def nested(matrix: DataFrame, positions: int) -> DataFrame:
    """metric, value, iqr (rows by distance, columns by position from 1, gaps null), per_repeat (a list of repeats in each place)."""
    cells = F.sequence(F.lit(1), F.lit(positions))
    rows = matrix.groupBy("metric", "d").agg(F.map_from_entries(F.collect_list(F.struct("p", F.struct("value", "iqr", "per_repeat")))).alias("_at"))
    row = lambda f: F.transform(cells, lambda p: F.try_element_at("_at", p)[f]).alias(f)
    rows = rows.select("metric", "d", row("value"), row("iqr"), row("per_repeat"))
    by_d = rows.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct("value", "iqr", "per_repeat")))).alias("_at"), F.max("d").alias("_n"))
    line = lambda f: F.transform(F.sequence(F.lit(1), F.col("_n").cast("int")), lambda d: F.try_element_at("_at", d)[f]).alias(f)
    return by_d.select("metric", line("value"), line("iqr"), line("per_repeat"))


def drift_matrix(matrix: DataFrame, path: str, positions: int) -> None:
    matrix.select("metric", F.col("d").alias("distance"), F.col("p").alias("position"), "value").write.mode("overwrite").partitionBy("metric").option("header", True).csv(f"{path}/long")
    wide(matrix, positions).write.mode("overwrite").partitionBy("metric").option("header", True).csv(f"{path}/wide")
    nested(matrix, positions).write.mode("overwrite").partitionBy("metric").json(f"{path}/json")


def drift_test(tests: DataFrame, path: str) -> None:
    tests.write.mode("overwrite").json(path)


def drift_count(found: DataFrame, counts: DataFrame, path: str) -> None:
    """What was found by release, as CSV, and how many releases show drift (a row per metric), as JSON."""
    found.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    counts.write.mode("overwrite").json(f"{path}/json")


def predictions(rows: DataFrame, path: str, meta: dict, form: str = "csv") -> bool:
    """Nothing is written without predictions."""
    if rows.isEmpty():
        return False
    if form == "csv":
        rows.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/rows")
    else:
        rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.range(1).select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in meta.items()))).alias("value")).write.mode("overwrite").text(f"{path}/meta")
    return True


def keywords(phrases: DataFrame, path: str) -> None:
    """One JSON object: a sorted list of phrases for each kind."""
    lists = phrases.groupBy("kind").agg(F.sort_array(F.collect_set("phrase")).alias("phrases"))
    lists.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "phrases"))))).alias("value")).write.mode("overwrite").text(path)


def releases(rows: DataFrame, path: str) -> None:
    rows.orderBy("component", F.desc("release_date")).write.mode("overwrite").option("header", True).csv(path)
