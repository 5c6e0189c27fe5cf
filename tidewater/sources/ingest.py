"""What happens to landed changes before they are analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """One row per key: the first in the given order (as a later fetch overwrites an earlier one)."""
    order = Window.partitionBy(key).orderBy(*newest)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def revision_scope(changes: DataFrame, scope: str = "all") -> DataFrame:
    """All revisions, or with `first` only those numbered 1."""
    if scope != "first":
        return changes
    return changes.withColumn("revisions", F.map_filter("revisions", lambda k, v: v["_number"] == 1))


def commits(changes: DataFrame) -> DataFrame:
    """One row per revision: its commit, its file names and line counts (0 where unknown)."""
    rows = changes.select("change_id", "change_number", F.explode("revisions").alias("revision_id", "r"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    counts = F.transform_values("r.files", lambda k, v: F.struct(zero(v["lines_inserted"]).alias("lines_inserted"), zero(v["lines_deleted"]).alias("lines_deleted"), zero(v["size_delta"]).alias("size_delta")))
    return rows.select("change_id", "change_number", "revision_id", F.col("r._number").alias("revision_number"), F.col("r.commit").alias("commit"), F.coalesce(F.map_keys("r.files"), F.array().cast("array<string>")).alias("files"), counts.alias("file_changes"))


def flat_changes(changes: DataFrame) -> DataFrame:
    """A summary row per change."""
    total = lambda c: F.coalesce(F.aggregate(F.map_values(c), F.lit(0), lambda a, x: a + F.coalesce(F.size(x), F.lit(0))), F.lit(0))
    return changes.select(
        "change_number", "change_id", "component", "project", "branch", "subject", "status", "created", "updated", F.col("submitted").alias("merged"), F.col("owner.name").alias("owner_name"), F.col("owner.email").alias("owner_email"),
        F.coalesce("insertions", F.lit(0)).alias("insertions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), total("comments").alias("comments_count"), total("reviewers").alias("reviewers_count"),
    )


def flat_commits(commit_rows: DataFrame) -> DataFrame:
    """A summary row per commit."""
    total = lambda f: F.coalesce(F.aggregate(F.map_values("file_changes"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[f], F.lit(0))), F.lit(0).cast("long"))
    return commit_rows.select(
        "change_number", "revision_id", F.col("commit.message").alias("message"), F.col("commit.author.name").alias("author_name"), F.col("commit.author.email").alias("author_email"), F.size("files").alias("files_changed"),
        total("lines_inserted").alias("lines_inserted"), total("lines_deleted").alias("lines_deleted"), F.greatest(F.size(F.coalesce("commit.parents", F.array().cast("array<struct<commit:string>>"))), F.lit(0)).alias("parent_count"),
    )


def run_manifest(fetched: DataFrame, saved: DataFrame) -> DataFrame:
    """component, fetched, saved, skipped, earliest, latest, status of one run. fetched: component, change_number, updated; saved: component, change_number."""
    seen = fetched.groupBy("component").agg(F.count("*").alias("fetched"), F.min("updated").alias("earliest"), F.max("updated").alias("latest"))
    kept = saved.groupBy("component").agg(F.count("*").alias("saved"))
    out = seen.join(kept, "component", "left").withColumn("saved", F.coalesce("saved", F.lit(0).cast("long")))
    return out.select("component", "fetched", "saved", (F.col("fetched") - F.col("saved")).alias("skipped"), "earliest", "latest", F.when(F.col("fetched") > 0, "success").otherwise("failed").alias("status"))


def release_manifest(components: DataFrame, releases: DataFrame) -> DataFrame:
    """component, n, missing_dates, earliest, latest, status for every wanted component; failed without releases."""
    found = releases.groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("release_date").isNull()).alias("missing_dates"), F.min("release_date").alias("earliest"), F.max("release_date").alias("latest"))
    out = components.select("component").distinct().join(found, "component", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("component", zero("n"), zero("missing_dates"), "earliest", "latest", F.when(F.col("n") > 0, "success").otherwise("failed").alias("status"))


def totals(changes: DataFrame, commit_rows: DataFrame) -> DataFrame:
    return changes.agg(F.count("*").alias("total_changes")).crossJoin(commit_rows.agg(F.count("*").alias("total_commits")))  # one row each
