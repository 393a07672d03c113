"""Sinks: index builds with a manifest, overlays of front matter, snapshots, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomery.functions import redact as R
from loomery.operators import upkeep


def publish(docs: DataFrame, path: str, contract: dict, previous: DataFrame | None = None, failed: int = 0) -> str:
    """Writes a build to a folder of its own, partitioned by corpus, then swaps the one-row manifest.

    A refused build raises and leaves the manifest as it was.
    """
    spark = docs.sparkSession
    why = upkeep.refuse_build(docs, previous if previous is not None else docs.limit(0), failed)
    if why:
        raise ValueError(why)
    build = uuid.uuid4().hex
    safe = R.redact_fields(docs, [c for c in ("description", "body", "headings") if c in docs.columns])
    safe.write.partitionBy("corpus").parquet(f"{path}/build-{build}")
    spark.createDataFrame([contract | {"build_id": build}]).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return build


def overlay(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Metadata changes by name laid over documents; bodies are never touched."""
    c = changes.select("name", *[F.col(x).alias(f"_{x}") for x in changes.columns if x in ("tier", "modified")])
    out = docs.join(c, "name", "left")
    for x in ("tier", "modified"):
        if f"_{x}" in out.columns:
            out = out.withColumn(x, F.coalesce(f"_{x}", x)).drop(f"_{x}")
    return out


def append(df: DataFrame, path: str) -> None:
    """One batch of rows at the end of a log table."""
    df.write.mode("append").parquet(path)


def replace_unless_empty(df: DataFrame, path: str) -> None:
    """Replaces results, but never with none."""
    if df.isEmpty():
        raise ValueError("a sweep without results does not replace one with results")
    df.write.mode("overwrite").parquet(path)


def backup(df: DataFrame, columns: list[str], path: str) -> None:
    """A redacted copy, checked to hold no secret before it counts as written."""
    R.redact_fields(df, columns).write.mode("overwrite").parquet(path)
    kept = df.sparkSession.read.parquet(path)
    for c in columns:
        if kept.schema[c].dataType.typeName() == "string" and not kept.where(R.has_secret(F.col(c))).isEmpty():
            raise ValueError(f"a secret is left in {c}")


def snapshot(store: DataFrame, path: str, day: str) -> None:
    """A dated copy of the store."""
    store.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/day={day}")


def prune_snapshots(spark: SparkSession, path: str, days: list[str], keep: int = 14) -> list[str]:
    """The days that are beyond the newest ``keep``; deletes nothing itself."""
    return sorted(days)[: max(0, len(days) - keep)]
