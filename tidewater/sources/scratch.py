"""Folders for what queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HELD: dict[str, list[str]] = {}  # by application: paths given out


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir); on one machine without it, in one temporary folder a session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _HELD.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, without lineage, safe when executors are lost."""
    path = folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, label: str | None = None) -> int:
    """Removes what the queries of this session left (all, or what has the label), and returns how many folders went. Results that are still lazy may read them: call it when results are stored."""
    held = _HELD.setdefault(spark.sparkContext.applicationId, [])
    gone = [p for p in held if label is None or p.rpartition("/")[2].startswith(f"{label}-")]
    for path in gone:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        held.remove(path)
    return len(gone)
