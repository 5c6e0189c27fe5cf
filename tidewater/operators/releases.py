"""Releases, development cycles, major releases. A project has few releases; windows are partitioned by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import time

MAJOR = r"^[0-9]+\.0\.0$"


def is_major(version: Column) -> Column:
    return F.trim(version).rlike(MAJOR)


def major_number(version: Column) -> Column:
    return F.split_part(F.trim(version), F.lit("."), F.lit(1)).try_cast("int")


def is_consistent(version: Column, date: Column) -> Column:
    """Versions that start with a year of four digits must be dated within a year of it."""
    head = F.split_part(version, F.lit("."), F.lit(1))
    return ~head.rlike("^[0-9]{4}$") | (F.abs(F.year(date) - head.try_cast("int")) <= 1)


def of_component(releases: DataFrame, project: str) -> DataFrame:
    return releases.filter(F.col("project") == project).select(F.col("project").alias("component"), "version", "release_date")


def cycles(releases: DataFrame) -> DataFrame:
    """project, version, cycle_start, cycle_end: from the latest consistent release strictly before, to the release's own date.

    Of rows that repeat a version the first by date counts; releases without an earlier one have no cycle.
    """
    first = releases.groupBy("project", "version").agg(F.min("release_date").alias("cycle_end"))
    dated = first.select("project", "version", "cycle_end", time.micros("cycle_end").alias("_t"), F.lit(None).cast("timestamp_ntz").alias("_d"))
    known = releases.filter(is_consistent(F.col("version"), F.col("release_date"))).select("project", F.lit(None).cast("string").alias("version"), F.lit(None).cast("timestamp_ntz").alias("cycle_end"), time.micros("release_date").alias("_t"), F.col("release_date").alias("_d"))
    before = Window.partitionBy("project").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    out = dated.union(known).withColumn("cycle_start", F.max("_d").over(before))
    return out.filter("cycle_end is not null and cycle_start is not null").select("project", "version", "cycle_start", "cycle_end")


def increments(releases: DataFrame) -> DataFrame:
    """component, release_date of major releases whose number exceeds that of the major release before (by date, then number)."""
    majors = releases.filter(is_major(F.col("version"))).withColumn("_m", major_number(F.col("version"))).filter("_m is not null")
    order = Window.partitionBy("component").orderBy("release_date", "_m")
    return majors.withColumn("_base", F.coalesce(F.lag("_m").over(order), F.lit(-1))).filter("_m > _base").select("component", "release_date")


def days_to_major(probes: DataFrame, releases: DataFrame, t: str = "t") -> DataFrame:
    """probes (component, t) with the days until the next major increment; -1 if none comes.

    A component's few increment dates travel as one sorted array; a probe takes the first after its time.
    """
    dates = increments(releases).groupBy("component").agg(F.sort_array(F.collect_set("release_date")).alias("_dates"))
    met = probes.join(dates, "component", "left")  # a row per component
    coming = F.try_element_at(F.filter("_dates", lambda d: d > F.col(t)), F.lit(1))
    return met.withColumn("days_to_major", F.when(coming.isNotNull(), F.greatest(F.lit(0.0), time.between(F.col(t), coming, "days"))).otherwise(F.lit(-1.0))).drop("_dates")
