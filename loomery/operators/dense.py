"""Dense leg: cosines of unit vectors, best chunk a document, nearest documents.

The pairs of a set of queries with all vectors are worked through in blocks by matrix products: each task
holds one block of vectors and one of queries and gives back k rows a query, so neither side is broadcast
and no pair is a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 32_768


def _blocks(df: DataFrame, name: str, rows: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // rows))
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def top_k(queries: DataFrame, vectors: DataFrame, k: int | None, exclude_same: bool = False, above: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k largest dot products of each query, or all above ``above`` where k is None; ties to the smaller id.

    queries and vectors: (id, vec). Vectors whose length is not the query's take no part; nulls neither.
    """
    q, nq = _blocks(queries.where("id is not null and vec is not null").select("id", "vec"), "qb", 1024)
    v, nv = _blocks(vectors.where("id is not null and vec is not null").select("id", "vec"), "vb", block)
    q, v = q.toDF(*q.columns), v.toDF(*v.columns)  # the two may be the same table
    dim = F.size("vec").alias("dim")
    q = q.select("id", "vec", dim, "qb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
    v = v.select("id", "vec", dim, "vb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(t.column("id"))
        flat = np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in t.column("vec").chunks])
        order = np.argsort(ids, kind="stable")
        return ids[order], flat.reshape(len(ids), -1)[order]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            ids, x = matrix(right)
            own, asks = matrix(left)
            for i in range(0, len(own), 256):
                scores = asks[i : i + 256] @ x.T
                if exclude_same:
                    scores[own[i : i + 256, None] == ids[None]] = -np.inf
                if above is not None:
                    scores[scores <= above] = -np.inf
                if k is None:
                    a, b = np.nonzero(np.isfinite(scores))
                    out.append(np.rec.fromarrays([own[i : i + 256][a], ids[b], scores[a, b]]))
                    continue
                m = min(k, len(ids))
                top = np.argsort(-scores, axis=1, kind="stable")[:, :m]  # ids ascend, so ties go to the smaller
                best = np.take_along_axis(scores, top, axis=1)
                keep = np.isfinite(best)
                out.append(np.rec.fromarrays([np.repeat(own[i : i + 256], m).reshape(-1, m)[keep], ids[top][keep], best[keep]]))
        cols = [np.concatenate([o[f"f{j}"] for o in out]) if out else np.zeros(0) for j in range(3)]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "id", "score"])

    keys = ["dim", "qb", "vb"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(run, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "rank", "id", "score")


def best_by_document(queries: DataFrame, chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query_id, doc, best, chunk): each document's largest cosine and the first chunk that has it.

    chunks: (doc, chunk_ix, vec). Worked through in blocks like top_k(); a block gives a row a query and document.
    """
    q, nq = _blocks(queries.where("id is not null and vec is not null").select("id", "vec"), "qb", 1024)
    v, nv = _blocks(chunks.where("doc is not null and vec is not null").select(F.xxhash64("doc", "chunk_ix").alias("id"), "doc", "chunk_ix", "vec"), "vb", block)
    kind = chunks.schema["doc"].dataType.simpleString()
    dim = F.size("vec").alias("dim")
    q = q.toDF(*q.columns).select("id", "vec", dim, "qb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
    v = v.toDF(*v.columns).select("doc", "chunk_ix", "vec", dim, "vb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        types = [pa.int64(), right.schema.field("doc").type, pa.float64(), pa.int64()]
        parts: list[list] = [[] for _ in types]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("doc", "ascending"), ("chunk_ix", "ascending")])
            docs = right.column("doc").combine_chunks().dictionary_encode()
            docs = docs.combine_chunks() if isinstance(docs, pa.ChunkedArray) else docs
            code, ix = np.asarray(docs.indices), np.asarray(right.column("chunk_ix")).astype(np.int64)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            x = np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in right.column("vec").chunks]).reshape(len(ix), -1)
            asks = np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in left.column("vec").chunks]).reshape(left.num_rows, -1)
            for own, scores in zip(np.asarray(left.column("id")).tolist(), asks @ x.T):
                best = np.maximum.reduceat(scores, first)
                at = np.flatnonzero(scores == np.repeat(best, np.diff(np.append(first, len(ix)))))
                at = at[np.append(True, code[at][1:] != code[at][:-1])]
                for part, values in zip(parts, (np.full(len(first), own), code[at], scores[at], ix[at])):
                    part.append(values)
            flat = [np.concatenate(p) for p in parts]
            return pa.table([pa.array(flat[0], types[0]), docs.dictionary.take(pa.array(flat[1])), pa.array(flat[2]), pa.array(flat[3], types[3])], names=["query_id", "doc", "cos", "chunk"])
        return pa.table([pa.array([], t) for t in types], names=["query_id", "doc", "cos", "chunk"])

    keys = ["dim", "qb", "vb"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(run, f"query_id long, doc {kind}, cos double, chunk long")
    return found.groupBy("query_id", "doc").agg(F.max("cos").alias("best"), F.min_by("chunk", F.struct(-F.col("cos"), F.col("chunk"))).alias("chunk"))
