"""The tables of a review history as they are read from the star-schema tables at hand, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.changes import decision_time
from tidewater.operators.releases import cycles as cycles_of

# A calendar of releases: half-yearly ones, a minor one, a release candidate, and one whose version contradicts its date.
RELEASES = [(f"{12 + k}.0.0", f"{1995 + (k + 1) // 2}-{'07' if k % 2 == 0 else '01'}-01") for k in range(13)] + [("13.0.1", "1996-02-15"), ("14.0.0.0rc1", "1996-06-15"), ("2010.1", "1998-02-21")]
PROJECT = "core"
GRID = ("1998-01-01", "1998-06-30")
LOOKBACK = 365
LOOKBACK_EVENTS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(rows: DataFrame) -> int:
    """Partitions to deal the rows of a table out to: more of them for larger tables, so that what one task holds stays about the same."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * rows.rdd.getNumPartitions())


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a change, its last shipment the update, its status the decision."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("updated"))
    rows = table(spark, sf_dir, "orders").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))  # tables of any size
    status = F.when(F.col("o_orderstatus") == "F", "MERGED").when(F.col("o_orderstatus") == "P", "ABANDONED").otherwise("NEW")
    rows = rows.select(F.col("o_orderkey").alias("change_number"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("created"), "updated", status.alias("status"), F.lit(PROJECT).alias("project"))
    return rows.withColumn("decision_time", decision_time(F.col("status"), F.col("updated")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines in an order of their own, as messages and as patch sets."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey")
    return rows.withColumn("number", F.row_number().over(order)).withColumnRenamed("l_orderkey", "change_number")


def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by humans: not automatic, not by a bot (suppliers that 10 divides), not by the owner."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_number"), F.col("l_suppkey").alias("author_id"), F.col("l_shipdate").alias("date"), F.when(F.col("l_returnflag") == "A", "autogenerated:ci").alias("tag"))
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number"), F.col("o_custkey").alias("owner_id"))
    return rows.filter(~F.coalesce(F.col("tag").startswith("autogenerated:"), F.lit(False)) & (F.col("author_id") % 10 != 0)).join(owners.hint("merge"), "change_number").filter("author_id != owner_id")


def releases(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(PROJECT, v, d) for v, d in RELEASES], "project string, version string, release_date string")
    return rows.withColumn("release_date", F.col("release_date").cast("timestamp_ntz"))


def cycles(spark: SparkSession) -> DataFrame:
    return cycles_of(releases(spark))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports by their users; purchases are merged two days later."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("owner_id"), F.col("ts").alias("created"), F.when(F.col("event_type") == "purchase", F.col("ts") + F.expr("interval 2 days")).alias("merged"), F.col("value").cast("int").cast("long").alias("lines"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (1 + i % 3).cast("int").alias("d"), (1 + F.floor(i / 3) % 4).cast("int").alias("p"), (F.floor(i / 12) % 2).cast("int").alias("repeat"), F.date_trunc("week", "ts").cast("date").alias("t"), i.alias("change_id"),
        F.col("value").alias("y_true"), (F.col("value") * (1 + (i * 7919 % 101 - 50) / 100.0)).alias("y_pred"),
    )


_VALUES = ", ".join(f"('{PROJECT}', '{v}', timestamp '{d}')" for v, d in RELEASES)
SQL = {
    "changes": "changes as (select o_orderkey as change_number, o_custkey as owner_id, o_orderdate as created, updated, case o_orderstatus when 'F' then 'MERGED' when 'P' then 'ABANDONED' else 'NEW' end as status, case when o_orderstatus in ('F', 'P') then updated end as decision_time from orders join (select l_orderkey, max(l_shipdate) as updated from lineitem group by 1) on l_orderkey = o_orderkey)",
    "lines": "lines as (select *, l_orderkey as change_number, row_number() over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey) as number from lineitem)",
    "human": "human as (select l_orderkey as change_number, l_suppkey as author_id, l_shipdate as date from lineitem join orders on o_orderkey = l_orderkey where l_returnflag <> 'A' and l_suppkey % 10 <> 0 and l_suppkey <> o_custkey)",
    "releases": f"releases(project, version, release_date) as (values {_VALUES})",
    "cycles": "cycles as (select r.project, r.version, max(e.release_date) as cycle_start, r.release_date as cycle_end from (select project, version, min(release_date) as release_date from releases group by all) r join releases e on e.project = r.project and e.release_date < r.release_date where not regexp_matches(split_part(e.version, '.', 1), '^[0-9]{4}$') or abs(year(e.release_date) - cast(split_part(e.version, '.', 1) as int)) <= 1 group by all)",
    "history": "history as (select user_id as owner_id, ts as created, case when event_type = 'purchase' then ts + interval 2 day end as merged, trunc(value)::BIGINT as lines from events)",
    "predictions": "predictions as (select (1 + event_id % 3)::INT as d, (1 + (event_id // 3) % 4)::INT as p, ((event_id // 12) % 2)::INT as repeat, date_trunc('week', ts)::DATE as t, event_id as change_id, value as y_true, value * (1 + (event_id * 7919 % 101 - 50) / 100.0::DOUBLE) as y_pred from events)",
    "grid": f"grid as (select unnest(generate_series(timestamp '{GRID[0]}', timestamp '{GRID[1]}', interval 1 day)) as t)",
}


def using(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names)
