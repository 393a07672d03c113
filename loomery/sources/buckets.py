"""A keyed table in hash buckets of which an upsert rewrites only those that it touches (ST3-ST6, ST10, K02).

Rows lie in ``data/<folder>/bucket=<b>``, and a one-row manifest a version says which folder holds each bucket. An upsert
writes new files of the touched buckets to a folder of its own and then the next manifest. What is interrupted
between the two leaves a folder that no manifest names; readers of an older version still find their files. A batch
whose number a manifest has is not taken again, so a stream that replays its last batch after a restart changes
nothing. Two writers at once cannot both commit: a version is written once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import shared

SCHEMA = "buckets int, batch long, folders map<int,string>, columns string"


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def manifest(self) -> dict | None:
        return shared.latest_version(self.spark, self.path)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def read(self, only: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The rows of the newest version, of some buckets if asked; None before the first."""
        m = manifest or self.manifest()
        if m is None:
            return None
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(m["folders"].items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], m["columns"])
        return self.spark.read.schema(m["columns"]).parquet(*paths)

    def upsert(self, rows: DataFrame, best: list[Column], batch: int | None = None) -> bool:
        """Replaces rows by key; of several new ones of a key the first by ``best`` stays. False if the batch was taken before."""
        m = self.manifest()
        if m is not None and batch is not None and m["batch"] is not None and batch <= m["batch"]:
            return False
        n = m["buckets"] if m is not None else self.buckets
        new = rows.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(*best))).where("_n = 1").drop("_n").withColumn("bucket", self._bucket(n))
        new = shared.written(new, "batch")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        old = self.read(touched, m) if m is not None else None
        if old is not None:
            kept = old.withColumn("bucket", self._bucket(n)).join(new.select(self.key), self.key, "left_anti")
            new = kept.unionByName(new)
        folder = uuid.uuid4().hex
        if touched:
            new.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        self.commit(m, {b: folder for b in touched}, n, batch, columns)
        return True

    def commit(self, m: dict | None, changed: dict[int, str], n: int, batch: int | None, columns: str) -> None:
        folders = dict(m["folders"]) if m is not None else {}
        row = {"buckets": n, "batch": batch if batch is not None or m is None else m["batch"], "folders": folders | changed, "columns": columns}
        shared.commit_version(self.spark.createDataFrame([row], SCHEMA), self.path, m["version"] + 1 if m is not None else 0)
