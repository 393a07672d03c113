"""Language-model scores by prediction by partial matching over a pretrained byte-context trie.

The model codes a text byte by byte, then an end symbol. A symbol is coded in the longest context (up
to ``ORDER`` symbols before it) that training texts hold; if it was not seen there, an escape is coded
and the next shorter context tried, without the symbols that the longer one has shown not to come
(symbol exclusion); past the empty context all symbols left are alike. Escapes are estimated by the
number of different symbols seen (method C): with counts c of sum n over d symbols left, a symbol has
c / (n + d) and the escape d / (n + d). Before its first byte a text stands on begin markers.

The trie is a table, never held whole anywhere. A context and symbol are one integer of 9 bits a
symbol, the newest lowest, so shorter contexts are masks of longer ones and their counts are sums. What
exclusion needs is one number a node: how often the parent saw the node's symbols. The code length of
every gram in the corpus then comes from joins of the gram table with the trie's levels.

Documents are dealt by hash into groups of about ``GROUP_BYTES``, packed and compressed. A group is
scanned twice: once for its distinct words and grams with their training counts, and once with just its
own words' counts and its own grams' code lengths beside it. So tables grow with the corpus, tasks do
not, and nothing is broadcast. Words are keyed by 62-bit hashes (a chance of about 1 in 10**18 a pair to mix two up).

The plain score beside it is the add-one unigram score of the words and the end of each text.

Defined results: a null or empty text has the end token and symbol only. A null id belongs to the
training part. Without training texts every word is unknown (N and V are 0) and every symbol alike.
Repeated rows count as often as they occur and are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import wordvec as V
from .sparkutil import blocks, small_batches, written

ORDER = 4
END = 256
SYMBOLS = 257
GROUP_BYTES, LEAST_GROUPS = 12 << 20, 12
SLICE = 1 << 19
_WORD = np.uint64(1 << 62)
_END_WORD = np.int64(1 << 62)


def word_keys(words: V.Words) -> np.ndarray:
    """Keys above every gram's; the end token has the smallest of them."""
    return ((words.hashes() >> V.U64(2)) | _WORD | V.U64(1)).view(np.int64)


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each symbol of each text, the end included; text of each)"""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes + 1)
    base = offsets[:-1] + np.arange(n) * (order + 1) + order  # where each text's symbols begin
    syms = np.full(len(data) + n * (order + 1), END, dtype=np.int64)
    at = np.arange(len(data) + n) - np.repeat(offsets[:-1] + np.arange(n), sizes + 1) + base[owner]
    last = np.cumsum(sizes + 1) - 1
    body = np.ones(len(at), bool)
    body[last] = False
    syms[at[body]] = data
    code = syms.copy()
    for j in range(1, order + 1):
        code[j:] |= syms[:-j] << np.int64(9 * j)
    return code[at], owner


def group_counts(texts: pa.ChunkedArray, train: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, counts in training texts) of the words and grams of some texts."""
    data, offsets = V.flat(texts)
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(keys: np.ndarray, is_train: np.ndarray) -> None:
        k, c = np.unique(keys[is_train], return_counts=True)
        parts.append((k, c))
        k = np.unique(keys[~is_train])
        parts.append((k, np.zeros(len(k), np.int64)))

    def merge() -> None:
        keys = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order_ = np.argsort(keys)
        keys, counts = keys[order_], counts[order_]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        parts[:] = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]

    held = 0
    for i, j in V.spans(offsets, SLICE):
        own, edge = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        t = train[i:j]
        w = V.Words(own, edge, lower=True)
        add(word_keys(w), np.repeat(t, w.counts))
        add(np.full(j - i, _END_WORD), t)
        code, owner = grams(own, edge, order)
        add(code, t[owner])
        held += sum(len(p[0]) for p in parts[-6:])
        if held > 1_000_000:
            merge()
            held = 0
    merge() if parts else None
    return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Lookup:
    """Values of integer keys by an open-addressed table; whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            take = left[free]
            self.keys[slot[take]] = keys[take]  # of several for one slot the last stays
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * V.U64(0x9E3779B97F4A7C15)) >> V.U64(64 - self.bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        out = self.values[slot]
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[left]]
            if (got == -1).any():
                raise KeyError("a key is not in the table")
            hit = got == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit]
        return out


def code_lengths(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 probability of the symbol of every gram, from (key, n) with training counts n.

    Most grams were seen in their longest context, whose sums are a window over it. Only the others go
    down the trie, one join a level, with what the exclusion of the level before took away.
    """
    context = F.shiftrightunsigned("key", 9)
    mask = lambda k: F.col("key").bitwiseAND(F.lit((1 << 9 * (k + 1)) - 1))
    own = Window.partitionBy("x")
    full = counts.withColumn("x", context).select("key", F.col("n").alias("c"), F.sum("n").over(own).alias("n"), F.count(F.when(F.col("n") > 0, 1)).over(own).alias("t"))
    full = written(full, "ppm-top")
    total = (F.col("n") + F.col("t")).cast("double")
    seen = full.where("c > 0").select("key", F.log10(F.col("c") / total).alias("value"))
    left = full.where("c = 0").select("key", F.when(total > 0, F.log10(F.col("t") / total)).otherwise(0.0).alias("value"), "t")
    levels: dict[int, DataFrame] = {order: full.where("c > 0").select("key", "c")}
    for k in range(order - 1, -1, -1):  # sums of the next longer level
        levels[k] = written(levels[k + 1].groupBy(mask(k).alias("key")).agg(F.sum("c").alias("c")), "ppm-level")

    def excluded(k: int) -> DataFrame:
        """(x, p): how often the contexts one shorter than level k's saw the symbols that those saw."""
        below = levels[k - 1].select(F.col("key").alias("short"), F.col("c").alias("p"))
        return levels[k].select(context.alias("x"), mask(k - 1).alias("short")).join(below, "short").groupBy("x").agg(F.sum("p").alias("p"))

    done = []
    for k in range(order - 1, -1, -1):
        nodes = levels[k].groupBy(context.alias("x")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("t"), F.map_from_entries(F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(511)).alias("s"), "c"))).alias("of"))
        rows = left.withColumn("x", F.shiftrightunsigned(mask(k + 1), 9)).join(excluded(k + 1), "x", "left").drop("x").withColumnRenamed("t", "t0")
        rows = rows.withColumn("x", F.shiftrightunsigned(mask(k), 9)).join(nodes, "x", "left")
        rows = rows.withColumn("c", F.coalesce(F.try_element_at("of", F.col("key").bitwiseAND(F.lit(511))), F.lit(0)))
        d = F.coalesce("t", F.lit(0)) - F.coalesce("t0", F.lit(0))
        total = (F.coalesce("n", F.lit(0)) - F.coalesce("p", F.lit(0)) + d).cast("double")
        step = F.when(total <= 0, 0.0).when(F.col("c") > 0, F.log10(F.col("c") / total)).otherwise(F.log10(d / total))
        rows = written(rows.select("key", "c", (F.col("value") + step).alias("value"), F.coalesce("t", F.lit(0)).alias("t")), "ppm-down")
        done.append(rows.where("c > 0").select("key", "value"))
        left = rows.where("c = 0").select("key", "value", "t")
    rest = F.greatest(F.lit(SYMBOLS) - F.col("t"), F.lit(1)).cast("double")
    out = seen.unionByName(left.select("key", (F.col("value") - F.log10(rest)).alias("value")))
    for part in done:
        out = out.unionByName(part)
    return out


def dealt(df: DataFrame, held_out: Column, groups: int, text: str, doc_id: str) -> DataFrame:
    """(g, blob): rows dealt to groups, each batch's share of a group as one compressed Arrow stream.

    A row's number in its partition goes into the hash, so that repeats of a row are spread over the groups. The
    rows are written before anything reads them; a task run again deals its own rows anew, and only one run counts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.pmod(F.xxhash64(F.col(doc_id), body, F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("g"), F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).sort_by("g")
            g = np.asarray(t.column("g"))
            edges = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g)) if len(g) else np.zeros(1, int)
            blobs = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                sink = pa.BufferOutputStream()
                part = t.slice(a, b - a).drop_columns(["g"]).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
                    w.write_table(part)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(g[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["g", "blob"])

    return rows.mapInArrow(run, "g int, blob binary")


def opened(blobs: pa.Table) -> pa.Table:
    """The rows of a group's blobs."""
    parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for c in blobs.column("blob").chunks for b in c]
    return pa.concat_tables(parts).combine_chunks()


def score(df: DataFrame, held_out: Column, order: int = ORDER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Trains on the rows of df where ``held_out`` is false and scores all of them.

    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    spark = df.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    groups = max(LEAST_GROUPS, blocks(df, F.octet_length(F.coalesce(F.col(text), F.lit(""))), GROUP_BYTES))
    docs = written(dealt(df, held_out, groups, text, doc_id), "ppm-docs")

    def count(blobs: pa.Table) -> pa.Table:
        rows = opened(blobs)
        keys, n = group_counts(rows.column("text"), ~np.asarray(rows.column("held_out").combine_chunks().cast(pa.uint8())).astype(bool), order)
        return pa.table({"g": pa.array(np.full(len(keys), blobs.column("g")[0].as_py(), np.int32)), "key": pa.array(keys), "n": pa.array(n.astype(np.int64))})

    stats = written(docs.groupBy("g").applyInArrow(count, "g int, key long, n long"), "ppm-counts")
    first_word = int(_END_WORD)
    words, grams_ = stats.where(F.col("key") >= first_word), stats.where(F.col("key") < first_word)
    # a word has a row a group at most, so a window over it is bounded by the number of groups
    own = Window.partitionBy("key")
    words = words.select("g", "key", F.sum("n").over(own).cast("double").alias("value"), (F.row_number().over(own.orderBy("g")) == 1).alias("one"))
    words = written(words, "ppm-words")
    total, distinct = words.where("one").agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("long"), F.count(F.when(F.col("value") > 0, 1))).first()
    lengths = code_lengths(grams_.groupBy("key").agg(F.sum("n").alias("n")), order)
    beside = words.select("g", "key", "value").unionByName(grams_.select("g", "key").join(lengths, "key").select("g", "key", "value"))
    scale = float(np.log10(total + distinct + 1))

    def evaluate(blobs: pa.Table, own: pa.Table) -> pa.Table:
        rows = opened(blobs)
        look = Lookup(np.asarray(own.column("key").combine_chunks()), np.asarray(own.column("value").combine_chunks()))
        data, offsets = V.flat(rows.column("text"))
        parts = []
        for i, j in V.spans(offsets, SLICE):
            raw, edge = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            w = V.Words(raw, edge, lower=True)
            ends = look(np.full(1, _END_WORD))[0]
            c = look(word_keys(w))
            owner = w.docs()
            base = np.bincount(owner, np.log10(c + 1) - scale, minlength=j - i) + (np.log10(ends + 1) - scale)
            known = np.bincount(owner, c > 0, minlength=j - i) + (ends > 0)
            code, text_of = grams(raw, edge, order)
            parts.append((w.counts + 1, known.astype(np.int64), base, np.bincount(text_of, look(code), minlength=j - i)))
        cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(4)]
        return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()), "train_tokens": pa.array(np.full(len(cols[0]), total, np.int64)), "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64())})

    return docs.groupBy("g").cogroup(beside.groupBy("g")).applyInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
