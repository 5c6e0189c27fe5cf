"""What the operators share: reading tables, the shared scratch folder, and writing a result to cut its lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SCRATCH: dict[str, list[str]] = {}  # by application: paths given out


def reachable(spark: SparkSession) -> None:
    """Lets Python workers on this machine find the package where the driver found it, whatever their working folder. A cluster gets it by --py-files."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """The wanted column name, with underscores after it until no column of df has it (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where a session on one machine names none (as in tests) a temporary folder is chosen.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, without lineage, safe when executors are lost."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession, label: str | None = None) -> int:
    """Removes what the operators of this session left in the shared folder (all of it, or what has the label), and returns how many folders went.

    Operators can't do this themselves, as results that are still lazy may read those folders; call it when results are stored.
    """
    held = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    gone = [p for p in held if label is None or p.rpartition("/")[2].startswith(f"{label}-")]
    for path in gone:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        held.remove(path)
    return len(gone)


def crc32_text(column: str):
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
