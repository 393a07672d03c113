"""Folders that driver and executors share, and one-row manifests that say which files of them count."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own where that is unset and everything runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the executors share")
        found = tempfile.mkdtemp(prefix="loomery-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/loomery-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no rerun."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """A digest of the files that a table is read from: their paths, sizes and times."""
    m = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    row = m.agg(F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}:{row['h']}"


def commit_version(row: DataFrame, path: str, version: int) -> None:
    """Writes a one-row manifest as ``version``. Fails if there is one: of two writers at once one must start anew."""
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")


def latest_version(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest under path with its ``version``, None if there is none."""
    try:
        rows = spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    found = rows.orderBy(F.desc("version")).limit(1).collect()
    return found[0].asDict(recursive=True) if found else None
