"""What the operators of this subpackage share on Spark's side."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the executors share")
        found = tempfile.mkdtemp(prefix="loomery-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str, partition_by: list[str] | None = None, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomery-{what}-{uuid.uuid4().hex}"
    w = df.write.option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of df is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], total: int, salts: int = 32) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row a key and the number of its rows in ``many`` as ``n``.

    Keys with at least 1/4096 of the ``total`` rows of ``many`` (so at most 4096 of them, which is what is
    broadcast) are cut into ``salts`` parts.
    """
    limit = max(1024, total // 4096)
    hot = one.where(F.col("n") >= limit).select(*keys, F.lit(True).alias("hot"))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*many.columns), F.lit(salts))).otherwise(F.lit(0))).drop("hot")
    right = one.withColumn("salt", F.explode(F.when(F.col("n") >= limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return left.join(right.withColumn("salt", F.col("salt").cast("long")), [*keys, "salt"]).drop("salt")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows: texts are long, and a batch is held whole by a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def held_out(doc_id, mod: int, part: int = 2):
    """True where crc32 of doc_id as text leaves the remainder ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == part, F.lit(False))


def blocks(df: DataFrame, bytes_of, target: int) -> int:
    """How many groups of about ``target`` bytes df has, one at least. One aggregate over the table."""
    total = df.agg(F.sum(bytes_of)).first()[0] or 0
    return max(1, -(-int(total) // target))


def sampled_ids(ids: DataFrame, n: int) -> DataFrame:
    """At most n ids of a one-column table, those with the smallest hashes.

    A first cut by hash leaves about four times as many as are wanted, so what tasks send does not grow
    with their number times n.
    """
    name = ids.columns[0]
    h = F.xxhash64(name)
    share = min(1.0, 4 * n / max(1, ids.count()))
    near = ids if share >= 1 else ids.where(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40)))
    return near.orderBy(F.pmod(h, F.lit(1 << 40)), name).limit(n)
