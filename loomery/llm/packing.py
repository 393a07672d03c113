"""Packing of token sequences: shortest-pack-first over the length histogram.

1. Every text is encoded once; the ids go to a table in the shared folder.
2. A document gives full sequences of ``size`` ids and one remainder. Remainders are counted by length:
   a histogram of at most ``size`` - 1 numbers, however many documents there are.
3. On the driver, lengths are placed longest first, each into the shortest pack that still has room,
   all documents of a length at once: what changes are counts of packing patterns. A length ends at
   most one pattern before its end, so there are at most two patterns a length.
4. Patterns that are neither nearly full nor a power of two long are then topped up: the shortest give ids
   of their last piece, cut off, to the fullest. At most one sequence a pattern group stays short.
5. Patterns go back to documents by rank: a document's rank among those of its remainder's length is
   its rank within a bucket of ids plus what earlier buckets hold, so no task ranks a whole length.

Defined results: a null or empty text is one id, the end. Documents with equal ids are kept apart by
``doc_id``; rows with the same ``doc_id`` are packed each on its own. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import wordvec as V
from .bpe import byte_chars
from .sparkutil import small_batches, written

SIZE, END = 1024, 0
#: A sequence that lacks at most size / LEAST_GAP ids is padded rather than topped up.
LEAST_GAP = 128
TABLE_ROWS = 250_000
SLICE = 1 << 21
#: Documents a bucket of ids holds, about: a rank is counted within one bucket of one length.
BUCKET_ROWS = 20_000


class ByteLevel:
    """A byte-level BPE file's ids, worked out for distinct pieces of text and remembered by hash."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        self.path = path
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of = {c: i for i, c in enumerate(byte_chars())}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if any(a >= b for a, b in zip(ids, ids[1:])):
            raise ValueError("the vocabulary's ids do not follow the order of its merges")
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items()}
        self.core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.width = np.uint16 if max([*vocab.values(), *self.specials.values()]) < 65536 else np.uint32
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.edges = np.zeros(1 << 14, np.int64)

    def look_up(self, hashes: list[int], text_at) -> np.ndarray:
        if len(self.at) > TABLE_ROWS:
            self.clear()
        found = list(map(self.at.get, hashes))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            encode = self.core.encode_ordinary
            got = [encode(text_at(i)) for i in new]
            n = len(self.at)
            end = int(self.edges[n])
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for g in got for x in g), np.uint32, int(sizes.sum()))
            while n + len(new) + 1 > len(self.edges):
                self.edges = np.concatenate([self.edges, np.zeros_like(self.edges)])
            while end + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[end : end + len(flat)] = flat
            self.edges[n + 1 : n + 1 + len(new)] = end + np.cumsum(sizes)
            for k, i in enumerate(new):
                found[i] = self.at[hashes[i]] = n + k
        return np.asarray(found, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, special tokens by their own ids."""
        parts: list[str] = []
        shape: list[list[int | str]] = []
        for text in texts:
            text = text or ""
            cut = self.cut.split(text) if self.cut and "<" in text else [text]
            row: list[int | str] = []
            for k, piece in enumerate(cut):
                row.append(piece if k % 2 else len(parts))
                if not k % 2:
                    parts.append(piece)
            shape.append(row)
        edges = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))
        done: list[np.ndarray] = []
        for i, j in V.spans(edges, SLICE):
            joined = "".join(parts[i:j])
            cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            own = edges[i : j + 1] - edges[i]
            starts, ends = V.pretokens(cps, own, lead_space=True)
            hashes = V.span_hashes(cps, starts, ends, V.cp_random())
            distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            at = self.look_up(distinct.tolist(), lambda k: joined[starts[first[k]] : ends[first[k]]])[back]
            ids, sizes = V.ragged(self.ids, self.edges[: len(self.at) + 1], at)
            sums = np.append(0, np.cumsum(sizes))
            cuts = sums[np.searchsorted(starts, own)]
            done += [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return [done[r[0]] if len(r) == 1 else np.concatenate([np.array([self.specials[x]], np.uint32) if isinstance(x, str) else done[x] for x in r]) for r in shape]


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def encoded(df: DataFrame, path: str, size: int = SIZE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A written table (doc_id, n, rest, ids): ids and the end as little-endian integers, n of them, rest = n mod size."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_level(path)
        for batch in batches:
            rows = [np.append(x, END).astype(bpe.width) for x in bpe.encode(batch.column(1).to_pylist())]
            n = np.fromiter(map(len, rows), np.int64, len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n % size), pa.array([np.dtype(bpe.width).itemsize] * len(rows), pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["doc_id", "n", "rest", "width", "ids"])

    return written(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, rest long, width int, ids binary"), "ids")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """(count, pieces) of each packing pattern; a piece is (length of the remainder, first rank, start in it, ids).

    The documents of ranks first .. first + count - 1 take that piece of the count sequences, in order.
    """
    open_: dict[int, list[list]] = {}  # total length: patterns [count, pieces]
    totals: list[int] = []
    full: list[list] = []
    for length in sorted((x for x in histogram if 0 < x < size), reverse=True):
        left, rank = histogram[length], 0
        while left:
            while totals and not open_.get(totals[0]):
                open_.pop(heapq.heappop(totals), None)
            if totals and totals[0] + length <= size:
                total = totals[0]
                count, pieces = group = open_[total][-1]
                take = min(left, count)
                if take == count:
                    open_[total].pop()
                else:  # the first ``take`` sequences leave the group
                    group[0] = count - take
                    group[1] = [(a, r + take, s, n) for a, r, s, n in pieces]
            else:
                total, pieces, take = 0, [], left
            grown = [take, [*pieces, (length, rank, 0, length)]]
            if total + length == size:
                full.append(grown)
            else:
                if total + length not in open_:
                    heapq.heappush(totals, total + length)
                open_.setdefault(total + length, []).append(grown)
            left -= take
            rank += take
    short = [[total, *g] for total in sorted(open_) for g in open_[total]]
    done = [(n, p) for n, p in full]
    # top up: the fullest take ids off the last piece of the shortest
    while short:
        total, count, pieces = short.pop()
        if total & (total - 1) == 0:
            done.append((count, pieces))
            continue
        if not short:
            if count == 1:
                done.append((count, pieces))
                continue
            half = count // 2  # one pattern left: its sequences top each other up
            short.append([total, half, pieces])
            total, count, pieces = total, count - half, [(a, r + half, s, n) for a, r, s, n in pieces]
        gap = size - total
        if gap <= size // LEAST_GAP:
            done.append((count, pieces))
            continue
        donor = short[0]
        take = min(count, donor[1])
        if take < count:
            short.append([total, count - take, [(a, r + take, s, n) for a, r, s, n in pieces]])
        if take < donor[1]:
            rest = [donor[0], donor[1] - take, [(a, r + take, s, n) for a, r, s, n in donor[2]]]
            short.insert(1, rest)
        a, r, s, n = donor[2][-1]
        given = min(gap, n)
        donor_pieces = [*donor[2][:-1], (a, r, s, n - given)] if given < n else donor[2][:-1]
        short.pop(0)
        if donor_pieces:
            short.insert(0, [donor[0] - given, take, donor_pieces])
        short.append([total + given, take, [*pieces, (a, r, s + n - given, given)]])
    return done


def placement(found: list[tuple[int, list[tuple[int, int, int, int]]]]) -> tuple[dict[int, np.ndarray], int]:
    """For each remainder length its rows (first rank, end rank, start, ids, first sequence, offset); sequences in all."""
    by: dict[int, list[tuple[int, ...]]] = {}
    at = 0
    for count, pieces in found:
        offset = 0
        for length, rank, start, n in pieces:
            by.setdefault(length, []).append((rank, rank + count, start, n, at, offset))
            offset += n
        at += count
    return {k: np.array(sorted(v), dtype=np.int64) for k, v in by.items()}, at


def pack(tokens: DataFrame, size: int = SIZE, digests: bool = False) -> DataFrame:
    """Packs the table of :func:`encoded`: a row a piece, with its ids, or with their CRC-32 if ``digests``."""
    spark = tokens.sparkSession
    rows = tokens.count()
    buckets = max(16, -(-rows // BUCKET_ROWS))
    keyed = tokens.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).withColumn("whole", F.expr(f"n div {size}"))
    sums = keyed.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("whole").alias("w"))
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.select("rest", "bucket", "c", "w", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0")), "ranks")
    heads = {r["rest"]: (r["c"], r["w"]) for r in sums.groupBy("rest").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).collect()}  # at most ``size`` rows
    where, packed = placement(patterns({k: c for k, (c, _) in heads.items()}, size))
    whole0, at = {}, packed
    for k in sorted(heads):
        whole0[k] = at
        at += heads[k][1]
    # rows that tie in all three have the same ids, so a task run again ranks them alike
    own = Window.partitionBy("rest", "bucket").orderBy("doc_id", "n", F.sha2("ids", 256))
    ranked = keyed.select("doc_id", "n", "rest", "bucket", "whole", "width", "ids", (F.row_number().over(own) - 1).alias("r"), (F.sum("whole").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")).alias("wr"))
    ranked = ranked.join(sums.select("rest", "bucket", "c0", "w0"), ["rest", "bucket"]).select("doc_id", "n", "rest", "whole", "width", "ids", (F.col("r") + F.col("c0")).alias("rank"), (F.col("wr") + F.col("w0")).alias("whole_rank"))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" if digests else "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            doc, n, rest, whole, width, ids, rank, whole_rank = (batch.column(k).to_pylist() for k in range(8))
            for k in range(batch.num_rows):
                every = np.frombuffer(ids[k], np.uint16 if width[k] == 2 else np.uint32).astype("<u4")
                pieces = [(i * size, size, whole0[rest[k]] + whole_rank[k] + i, 0) for i in range(whole[k])]
                if rest[k]:
                    t = where[rest[k]]
                    hit = t[(t[:, 0] <= rank[k]) & (rank[k] < t[:, 1])]
                    pieces += [(whole[k] * size + s, m, q + rank[k] - a, o) for a, _, s, m, q, o in hit.tolist()]
                for start, m, sequence, offset in pieces:
                    part = every[start : start + m]
                    row = (doc[k], start, m, zlib.crc32(part.tobytes()) if digests else part.tolist(), n[k], sequence, offset)
                    for c, x in zip(cols, row):
                        c.append(x)
            types = [pa.int64()] * 3 + [pa.int64() if digests else pa.list_(pa.int32())] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return ranked.mapInArrow(run, out)
