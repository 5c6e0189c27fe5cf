"""Patch sets: what a change held at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import time
from tidewater.operators.asof import in_force


def file_lines(files: Column, field: str) -> Column:
    """Sum of a count over the files of a revision; 0 without a map of files."""
    return F.coalesce(F.aggregate(F.map_values(files), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[field], F.lit(0))), F.lit(0).cast("long"))


def files_changed(files: Column) -> Column:
    return F.coalesce(F.cardinality(files), F.lit(0))


def current(revisions: Column, name: Column) -> Column:
    """The named revision, else the one with the highest number, else null."""
    # Maps can't be ordered, so the numbers are, with their revisions' names.
    ranked = F.array_max(F.transform(F.map_entries(revisions), lambda e: F.struct(e["value"]["_number"].alias("n"), e["key"].alias("k"))))
    return F.coalesce(F.try_element_at(revisions, name), F.try_element_at(revisions, ranked["k"]))


def state_at(probes: DataFrame, revisions: DataFrame, columns: list[str]) -> DataFrame:
    """probes (change_number, t) with columns of the latest revision created at or before t, the highest number among equal times."""
    return in_force(probes, revisions, "change_number", "t", "created", "number", columns)


def count_at(probes: DataFrame, revisions: DataFrame) -> DataFrame:
    """probes (change_number, t) with revision_count: revisions created at or before t."""
    asked = probes.select("change_number", "t").distinct()
    return asked.join(revisions.select("change_number", "created"), "change_number", "left").groupBy("change_number", "t").agg(F.count_if(F.col("created") <= F.col("t")).alias("revision_count"))


def state_days(spans: DataFrame, revisions: DataFrame, columns: list[str]) -> DataFrame:
    """spans (change_number, _lo, _hi: numbers of days), cut where what state_at() and count_at() give at their midnights changes, with columns and revision_count (nulls where no revision is known)."""
    order = Window.partitionBy("change_number").orderBy("created", "number")
    seen = {"revision_count": F.count("created").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_until": F.lead("created").over(order), "_more": F.lead(F.lit(True)).over(order).isNotNull(), "_head": F.row_number().over(order) == 1}
    rows = revisions.withColumns(seen)
    own = F.struct(time.first_day(F.col("created")).alias("_from"), (time.first_day(F.col("_until")) - 1).alias("_to"), F.struct(*columns, "revision_count").alias("_state"))
    # Before its first revision a change has none.
    before = F.struct(F.lit(None).cast("int").alias("_from"), (time.first_day(F.col("created")) - 1).alias("_to"), F.lit(None).alias("_state"))
    held = F.array(F.when(~F.col("_more") | ~F.col("created").eqNullSafe(F.col("_until")), own), F.when(F.col("_head") & F.col("created").isNotNull(), before))
    steps = rows.select(F.col("change_number").alias("_change"), F.explode(F.filter(held, lambda s: s.isNotNull())).alias("_s")).select("_change", "_s.*")
    met = spans.join(steps.hint("merge"), F.expr("change_number = _change and (_from is null or _from <= _hi) and (_to is null or _to >= _lo)"), "left")
    met = met.withColumns({"_lo": F.greatest("_lo", "_from"), "_hi": F.least("_hi", "_to")}).filter("_lo <= _hi")
    return met.select(*spans.columns, *(F.col(f"_state.{c}").alias(c) for c in (*columns, "revision_count")))


def count_with_fallback(probes: DataFrame, revisions: DataFrame, commits: DataFrame) -> DataFrame:
    """probes (change_number, t) with revision_count: of changes with revisions, those created at or before t; of others, commit files dated so.

    revisions: change_number, revision_id, created; a change without any revision may list commits under revision_id
    with listed = true, whose dates are in commits (change_number, revision_id, commit).
    """
    own = revisions.filter("not listed").select("change_number", "created")
    known = own.select("change_number").distinct()
    dated = commit_files(revisions.filter("listed").join(known, "change_number", "left_anti"), commits)
    other = dated.select("change_number", time.parse("committed").alias("created"))
    return count_at(probes, own.union(other))


def with_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows with lines_added, lines_deleted, files_changed of their change; 0 where missing."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("lines_added", "lines_deleted", "files_changed")}
    return rows.join(lines.select("change_number", *zero), "change_number", "left").withColumns(zero)


def commit_files(revisions: DataFrame, commits: DataFrame) -> DataFrame:
    """Revisions with the committer date of their commit file, found by change and the first eight letters of the hash.

    Commits of a change whose hashes begin alike have one file, which holds the latest of them by date; revisions that
    begin so all find that one.
    """
    short = commits.select("change_number", F.substring("revision_id", 1, 8).alias("_sha"), F.col("commit.committer.date").alias("_date"))
    short = short.groupBy("change_number", "_sha").agg(F.max_by("_date", time.parse("_date")).alias("committed"))
    return revisions.withColumn("_sha", F.substring("revision_id", 1, 8)).join(short, ["change_number", "_sha"], "left").drop("_sha")
