"""Vectors as text and back: base64 of little-endian 32-bit floats, with a contract of their length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def encode(df: DataFrame, vector: str, out: str) -> DataFrame:
    """df with ``out``: the vector of each row as base64 text; null where it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = np.asarray(lists.flatten().cast(pa.float32())).astype("<f4").tobytes()
            ends = np.cumsum(sizes) * 4
            blobs = [None if null else flat[e - 4 * n : e] for e, n, null in zip(ends.tolist(), sizes.tolist(), lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(blobs, pa.binary())], names=[*batch.schema.names[:-1], out])

    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    made = df.select(*kept, F.col(f"`{vector}`").cast("array<float>").alias("vector in"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields[:-1]) + f", `{out}` binary"
    return made.mapInArrow(run, schema).withColumn(out, F.base64(F.col(f"`{out}`")))


def decode(df: DataFrame, text: str, out: str, dim: int) -> DataFrame:
    """df with ``out``, the array of floats that the base64 text holds, and ``refusal``.

    A text that is no base64, no whole number of floats or not ``dim`` of them gives a null vector and says why; so do entries that are not finite. No short
    vector gets through, which a cosine would score as if it were whole. A null text gives two nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, bad = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            why: list[str | None] = []
            good: list[bytes | None] = []
            for b, no in zip(blobs, bad):
                reason = "not base64" if no else None if b is None else f"{len(b)} bytes, not a whole number of floats" if len(b) % 4 else f"{len(b) // 4} floats, not {dim}" if len(b) != 4 * dim else None
                why.append(reason)
                good.append(None if reason else b)
            flat = np.frombuffer(b"".join(g for g in good if g is not None), "<f4").reshape(-1, dim)
            finite = iter(np.isfinite(flat).all(axis=1).tolist())
            for k, g in enumerate(good):
                if g is not None and not next(finite):
                    why[k], good[k] = "entries that are not finite", None
            flat = np.frombuffer(b"".join(g for g in good if g is not None), "<f4")
            ends = np.cumsum([0] + [0 if g is None else dim for g in good])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float32()), mask=pa.array([g is None for g in good]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists, pa.array(why, pa.string())], names=[*batch.schema.names[:-2], out, "refusal"])

    col = F.col(f"`{text}`")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (out.lower(), "refusal")]
    blob = F.try_to_binary(col, F.lit("base64"))
    made = df.select(*kept, blob.alias("blob in"), (blob.isNull() & col.isNotNull()).alias("bad in"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields[:-2]) + f", `{out}` array<float>, refusal string"
    return made.mapInArrow(run, schema)


def accept(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """df with ``refusal`` for vectors that came as arrays: the same length check as for texts."""
    n = F.size(F.col(f"`{vector}`"))
    return df.withColumn("refusal", F.when(F.col(f"`{vector}`").isNotNull() & (n != dim), F.concat(n.cast("string"), F.lit(f" floats, not {dim}"))))


def seed_cache(chunks: DataFrame, contract: str, cache: DataFrame | None = None) -> DataFrame:
    """(contract, text_sha, vec): vectors of chunks (text, vec) by the hash of their text, once each; what ``cache`` has is left out."""
    own = chunks.where("vec is not null").select(F.lit(contract).alias("contract"), F.sha2("text", 256).alias("text_sha"), "vec")
    own = own.groupBy("contract", "text_sha").agg(F.min("vec").alias("vec"))
    return own if cache is None else own.join(cache.select("contract", "text_sha"), ["contract", "text_sha"], "left_anti")
