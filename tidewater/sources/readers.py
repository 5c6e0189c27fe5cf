"""Readers of what has landed as files. Folders may be on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import time
from tidewater.sources import schema


def changes(spark: SparkSession, path: str, glob: str = "change_*.json") -> DataFrame:
    """Changes from JSON files of one record or a list each; records that can't be parsed are left out."""
    rows = spark.read.schema(schema.CHANGE + ", _corrupt STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(path)
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def releases(spark: SparkSession, path: str) -> DataFrame:
    """project, version, release_date; rows whose date can't be parsed are left out."""
    rows = spark.read.schema(schema.RELEASE).option("header", True).csv(path)
    return rows.withColumn("release_date", time.parse("release_date")).na.drop(subset=["release_date"])


def bot_names(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """identity: the comma-separated `bots` of the [organization] section of an ini file."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r", "").alias("v"))
    part = F.regexp_extract("v", r"(?s)(?:^|\n)\[organization\][^\n]*\n(.*?)(?=\n\[|\z)", 1)
    names = F.split(F.regexp_extract(part, r"(?s)(?:^|\n)bots\s*[=:]\s*(.*?)(?=\n\S|\z)", 1), ",")
    out = text.select(F.explode(names).alias("identity")).select(F.regexp_replace("identity", r"(?U)^\s+|\s+$", "").alias("identity"))
    return _identities(out if not lower else out.select(F.lower("identity").alias("identity")))


def bot_accounts(spark: SparkSession, path: str) -> DataFrame:
    """identity: names and addresses of a two-column CSV; a first row that says name,email is a header."""
    rows = spark.read.schema("name STRING, email STRING").csv(path)
    rows = rows.filter(~F.coalesce((F.lower(F.trim("name")) == "name") & (F.lower(F.trim("email")) == "email"), F.lit(False)))
    return _identities(rows.select(F.explode(F.array("name", "email")).alias("identity")).select(F.lower(F.trim("identity")).alias("identity")))


def extra_bots(spark: SparkSession, path: str) -> DataFrame:
    """identity: one per line; # starts a comment line."""
    return _identities(spark.read.text(path).select(F.lower(F.trim("value")).alias("identity")).filter(~F.col("identity").startswith("#")))


def all_bots(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out.distinct()


def _identities(rows: DataFrame) -> DataFrame:
    return rows.filter("identity is not null and identity != ''").distinct()


def review_labels(spark: SparkSession, path: str) -> DataFrame:
    """category, sentiment, label, role: request (Code-Review minus), confirmation (Code-Review plus) or strip (other categories)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, MAP<STRING, ARRAY<STRING>>>").alias("v"))
    rows = text.select(F.explode("v").alias("category", "v")).select("category", F.explode("v").alias("sentiment", "v")).select("category", "sentiment", F.explode("v").alias("label"))
    code = F.col("category") == "Code-Review"
    return rows.withColumn("role", F.when(code & (F.col("sentiment") == "minus"), "request").when(code & (F.col("sentiment") == "plus"), "confirmation").when(~code, "strip"))


def keywords(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """kind, phrase from a JSON object of lists; names maps its keys to kinds."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, ARRAY<STRING>>").alias("v"))
    kinds = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    rows = text.select(F.explode("v").alias("key", "phrases")).select(F.try_element_at(kinds, F.col("key")).alias("kind"), F.explode("phrases").alias("phrase"))
    return rows.filter("kind is not null").distinct()


def checklist(spark: SparkSession, path: str, most: int | None = 383) -> DataFrame:
    """Labelled comments of changes up to a number (None: of all); blank flags are null."""
    rows = spark.read.schema(schema.CHECKLIST).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    blank = lambda c: F.when(F.trim(c) != "", F.col(c)).alias(c)
    return rows.filter(F.col("PRNumber") <= most if most is not None else F.lit(True)).select("PRNumber", "author", "comment", blank("request"), blank("confirmation"))


def predictions(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Saved predictions. A gzip CSV is one task; Parquet is split."""
    return spark.read.parquet(path) if form == "parquet" else spark.read.schema(schema.PREDICTION).option("header", True).csv(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """metric, d, p, value, iqr from JSON matrices; gaps are null; both count from 1."""
    rows = spark.read.schema("metric STRING, value ARRAY<ARRAY<DOUBLE>>, iqr ARRAY<ARRAY<DOUBLE>>").option("multiLine", True).json(path)
    rows = rows.select("metric", F.posexplode("value").alias("d", "row"), "iqr").select("metric", "d", F.posexplode("row").alias("p", "value"), "iqr")
    return rows.select("metric", (F.col("d") + 1).alias("d"), (F.col("p") + 1).alias("p"), "value", F.get(F.get("iqr", F.col("d")), F.col("p")).alias("iqr"))


def deliverables(spark: SparkSession, path: str, repositories: DataFrame) -> DataFrame:
    """component, version, release_date, release_notes_url of deliverables that list the repository (repositories: component, repo), newest first."""
    docs = spark.read.schema(schema.DELIVERABLE).json(path)
    rows = docs.join(repositories, "component").select("component", "repo", F.explode("releases").alias("r"))
    mine = rows.filter(F.exists("r.projects", lambda p: p["repo"] == F.col("repo")))
    return mine.select("component", F.col("r.version").alias("version"), time.parse(F.col("r.date")).alias("release_date"), F.col("r.notes_url").alias("release_notes_url")).orderBy("component", F.desc("release_date"))
