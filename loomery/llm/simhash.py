"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has ``tables`` words of 64 bits. Fingerprints that differ in at most ``max_bits`` bits are
linked. Cut into ``segments`` with 2 * segments > max_bits, one segment of two linked fingerprints
differs by at most one bit, so both have that segment's variant in which the bit is a wildcard. Each
distinct fingerprint is indexed once under every one-wildcard variant of every segment (as many as it
has bits), an equality shuffle brings equal variants together, and full fingerprints are compared there.

Nothing emits all pairs of a group: a task compares the members of a variant in vectors and gives back
a star for each set that its links connect. A pair counts only under the first variant that it shares.
Variants with more than ``MAX_RUN`` members are cut into blocks, and every two blocks meet in a group of
their own, so one group never holds more than two blocks. Copies never multiply: the index holds
distinct fingerprints, and documents join their component by fingerprint at the end.

Defined results: a null or empty text has fingerprint 0, linked like any other. Rows with a null id get
a fingerprint and their component; a component whose ids are all null has a null id. Repeated rows are
kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordvec as V
from .links import components
from .sparkutil import small_batches, written

MAX_RUN = 4096


def shingle_hashes(words: V.Words, width: int, seed: int) -> Iterator[np.ndarray]:
    """The XXH64 of each text's shingles, in order, repeats included."""
    import xxhash

    h = xxhash.xxh64_intdigest
    data = words.data.tobytes()
    starts, ends, first = words.starts.tolist(), words.ends.tolist(), words.first.tolist()
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if not n:
            yield np.zeros(0, V.U64)
            continue
        own = [data[s:e] for s, e in zip(starts[a:b], ends[a:b])]
        flat = b" ".join(own)
        cut = np.append(0, np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1))
        m = max(1, n - width + 1)
        s, e = cut[:m].tolist(), (cut[min(width, n) : min(width, n) + m] - 1).tolist()
        yield np.fromiter((h(flat[x:y], seed) for x, y in zip(s, e)), V.U64, m)


_LANES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def vote(hashes: list[np.ndarray]) -> np.ndarray:
    """For each text, the bits that are set in over half of its hashes."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, V.U64)
    lanes = np.ascontiguousarray(flat).view(np.uint8).reshape(-1, 8)
    owner = np.repeat(np.arange(len(hashes)) * 256, sizes)
    out = np.zeros(len(hashes), V.U64)
    for k in range(8):
        seen = np.bincount(owner + lanes[:, k], minlength=256 * len(hashes)).reshape(-1, 256) @ _LANES
        bits = 2 * seen > sizes[:, None]
        out |= (bits.astype(V.U64) << np.arange(8 * k, 8 * k + 8, dtype=V.U64)).sum(axis=1, dtype=V.U64)
    return out


def fingerprints(df: DataFrame, width: int = 4, seed: int = 42, tables: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, f0 ... ): ``tables`` words of fingerprint of each text. Later words mix the same hashes anew."""
    small_batches(df.sparkSession)
    names = [f"f{t}" for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = V.flat(batch.column(1))
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for i, j in V.spans(offsets):
                hashes = list(shingle_hashes(V.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), width, seed))
                for t in range(tables):
                    parts[t].append(vote(hashes if not t else [V.mix64(h + V.U64(t * 0x9E3779B97F4A7C15 % (1 << 64))) for h in hashes]))
            cols = [pa.array((np.concatenate(p) if p else np.zeros(0, V.U64)).view(np.int64)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *names])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of a 64-bit word."""
    edges = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(prints: DataFrame, tables: int, segments: int) -> DataFrame:
    """A row for each one-wildcard variant of each segment of each fingerprint: (key, f0 ..., and node if there is one)."""
    keys = []
    for t in range(tables):
        for at, n in cuts(segments):
            part = F.shiftrightunsigned(F.col(f"f{t}"), at).bitwiseAND(F.lit((1 << n) - 1))
            keys += [part.bitwiseAND(F.lit(((1 << n) - 1) ^ (1 << k))) + F.lit((t * 64 + at + k) << 32) for k in range(n)]
    return prints.select(F.explode(F.array(*keys)).alias("key"), *[f"f{t}" for t in range(tables)], *(["node"] if "node" in prints.columns else []))


def _first_shared(diff: list[np.ndarray], segments: int) -> np.ndarray:
    """The number of the first variant that two fingerprints with these differing bits share."""
    out = np.full(len(diff[0]), -1, np.int64)
    for t, d in enumerate(diff):
        for at, n in cuts(segments):
            part = (d >> V.U64(at)) & V.U64((1 << n) - 1)
            ones = np.bitwise_count(part)
            new = (out < 0) & (ones <= 1)
            bit = np.where(ones == 1, np.log2(np.maximum(part, V.U64(1)).astype(np.float64)).astype(np.int64), 0)
            out[new] = (t * 64 + at + bit)[new]
    return out


def stars(key: np.ndarray, prints: list[np.ndarray], max_bits: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) index pairs of the sets that links within runs of equal keys connect; keys are sorted."""
    root = np.arange(len(key))
    at, step = np.arange(len(key)), 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        diff = [p[at] ^ p[at + step] for p in prints]
        near = np.flatnonzero(sum(np.bitwise_count(d).astype(np.int64) for d in diff) <= max_bits)
        if len(near):
            own = key[at[near]] >> 32
            near = near[_first_shared([d[near] for d in diff], segments) == own]
            a, b = at[near], at[near] + step
            while True:
                ra, rb = root[a], root[b]
                open_ = ra != rb
                if not open_.any():
                    break
                a, b = a[open_], b[open_]
                np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
                while (deeper := root[root]).tobytes() != root.tobytes():
                    root = deeper
        step += 1
    member = np.flatnonzero(root != np.arange(len(key)))
    return member, root[member]


def links(prints: DataFrame, max_bits: int, tables: int = 1, segments: int = 3) -> DataFrame:
    """Stars (a, b) over distinct fingerprints that connect exactly what links of at most max_bits connect.

    prints: distinct fingerprints f0 ... and, unless f0 is to stand for them in a and b, their ``node``.
    """
    if 2 * segments * tables <= max_bits:
        raise ValueError("too few segments: all of them could differ by two bits")
    names = [f"f{t}" for t in range(tables)] + (["node"] if "node" in prints.columns else [])
    every = variants(prints, tables, segments)
    counts = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_RUN)
    hot = written(counts, "hot")
    every = every.withColumn("block", F.lit(0))
    if not hot.isEmpty():
        nb = F.ceil(F.col("n") / MAX_RUN).cast("int")
        joined = every.drop("block").join(hot, "key", "left")
        own = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64(*names), nb).cast("int"))
        pairs = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), nb - 1), lambda o: F.least(o, F.col("own")) * nb + F.greatest(o, F.col("own"))))
        every = joined.withColumn("own", own).withColumn("block", F.explode(pairs)).select("key", *names, F.col("block").cast("int").alias("block"))
    rows = every.repartition("key", "block").sortWithinPartitions("key", "block", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def done(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, block, prints_ = cols[0], cols[1], [c.view(V.U64) for c in cols[2 : 2 + tables]]
            node = cols[-1] if names[-1] == "node" else cols[2]
            if len(key) and block.any():  # blocks of one variant stand side by side: give each a number of its own
                fresh = np.append(False, (key[1:] != key[:-1]) | (block[1:] != block[:-1]))
                run_of = np.cumsum(fresh)
                key = (key >> 32 << 32) | run_of
            member, centre = stars(key, prints_, max_bits, segments)
            return pa.RecordBatch.from_arrays([pa.array(node[member]), pa.array(node[centre])], names=["a", "b"])

        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in range(batch.num_columns)]
            cols = [cols[0], cols[-1], *cols[1:-1]]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            tail = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])) if len(cols[0]) else np.zeros(0, int)
            cut = int(tail[-1]) + 1 if len(tail) else 0
            if cut >= 50_000 or cut and len(cols[0]) - cut > 0 and cut >= 20_000:
                yield done([c[:cut] for c in cols])
                held = [c[cut:] for c in cols]
            else:
                held = cols
        if held is not None and len(held[0]):
            yield done(held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, width: int = 4, seed: int = 42, max_bits: int = 4, segments: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: component_id is the smallest id that links reach."""
    prints = written(fingerprints(df, width, seed, 1, text, doc_id), "prints")
    classes = written(prints.groupBy("f0").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("f0"), max_bits, segments=segments))
    joined = classes.join(found, classes["f0"] == found["node"], "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    label = written(joined.join(best, "root").select("f0", "component_id"), "labels")
    return prints.join(label, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
