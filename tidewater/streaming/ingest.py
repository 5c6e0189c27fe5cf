"""Resumable ingest of landed files by Structured Streaming: the checkpoint remembers what is done."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.ingest import latest_by_key


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, form: str = "json", per_batch: int = 1000) -> None:
    """Appends the rows of new files to target, a folder for each micro-batch, and stops when all that has landed is done.

    A batch that is repeated after a failure overwrites its own folder. Another revision scope needs another
    checkpoint. latest() gives the newest row per key over all batches.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(source)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"ingest-{uuid.uuid4().hex}").start().awaitTermination()


def latest(spark: SparkSession, target: str, key: str, newest: list[Column]) -> DataFrame:
    return latest_by_key(spark.read.parquet(target), key, [*newest, F.desc("batch")]).drop("batch")


def upsert(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, newest: list[str], buckets: int = 64, form: str = "json", per_batch: int = 1000) -> None:
    """Merges the rows of new files into target, one row per key, and stops when all that has landed is done. current() reads it without a window.

    The target is dealt into buckets by a hash of the key. See merge() for what a micro-batch does. The number of
    buckets must stay what it was when the target began; more of them make a batch that touches few keys cheaper.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(source)
    save = lambda batch, number: merge(batch, number, target, key, newest, buckets)
    rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"upsert-{uuid.uuid4().hex}").start().awaitTermination()


def merge(batch: DataFrame, number: int, target: str, key: str, newest: list[str], buckets: int = 64) -> None:
    """Writes the buckets that a micro-batch touches anew, under its number, and then names them in a manifest of its own, which commits them.

    A key keeps its row with the largest newest columns; of equal ones that of the later batch. A batch that comes again
    after a failure finds the buckets as they were before it, or its manifest, and changes nothing twice. Rows without
    a key are left out. Rows are combined before they are shuffled, so a key that is updated very often is no large group.
    """
    spark, columns = batch.sparkSession, batch.columns
    versions = _versions(spark, target)
    if any(v == number for v in versions.values()):
        return
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")
    rows = batch.filter(F.col(key).isNotNull()).select("*", bucket, F.lit(True).alias("_new"))
    touched = sorted(r["_bucket"] for r in rows.select("_bucket").distinct().collect())  # as many as there are buckets at most
    if not touched:
        return
    held = _read(spark, target, batch.schema, {b: v for b, v in versions.items() if b in set(touched)}).select("*", bucket, F.lit(False).alias("_new"))
    order = F.struct(*newest, "_new", *(c for c in columns if c not in newest))
    one = rows.unionByName(held).groupBy("_bucket", key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select("_bucket", "_row.*")
    one.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/data/version={number}")
    spark.createDataFrame([(b, number) for b in touched], "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{target}/manifest/batch={number}")


def current(spark: SparkSession, target: str, schema) -> DataFrame:
    """The rows of an upsert target: what its manifests name last for every bucket."""
    return _read(spark, target, schema, _versions(spark, target))


def _versions(spark: SparkSession, target: str) -> dict[int, int]:
    """The version of each bucket; the driver holds a number per bucket."""
    try:
        named = spark.read.schema("bucket int, version long").json(f"{target}/manifest")
        return {r["bucket"]: r["v"] for r in named.groupBy("bucket").agg(F.max("version").alias("v")).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def _read(spark: SparkSession, target: str, schema, versions: dict[int, int]) -> DataFrame:
    paths = [f"{target}/data/version={v}/_bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def not_done(chunks: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The batch alternative: what a ledger doesn't name yet."""
    return chunks.join(ledger.select(*keys).distinct(), keys, "left_anti")
