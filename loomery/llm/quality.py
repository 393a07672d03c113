"""Quality rules by distribution divergence from language references.

A reference is what a language's documents look like: the shares of character classes, and the shares
of its common words. Both are counted over every document that passes the base rules and has a value
in ``lang``; a word is common if it makes up at least ``COMMON`` of a language's words, which bounds a
reference to 1/COMMON words by definition, and a language counts if it has at least ``LEAST_LANG`` of
those documents, which bounds the number of references. A document is then compared with every
reference, whatever its own ``lang`` says, by Jensen-Shannon distance (base 2, so 0 to 1). The nearest
reference decides. Histograms of short documents are noise, so a document with fewer than
``MIN_WORDS`` words is judged by the base rules alone.

Defined results: a null or empty text has no words and fails the base rules. Documents with a null
``lang`` are judged like all others but add to no reference. With no reference at all (no document
has a language) the base rules decide alone. Repeated rows are judged each on its own. An empty table gives
no references and no rows. Texts are read whole, however long, some megabytes of them at a time. Columns of the table whose names are
those of the result in any case of letters give way to it; all others are handed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordvec as V
from .sparkutil import free_name, small_batches

COMMON = 0.002
LEAST_LANG = 0.001
MIN_WORDS = 50
#: Farthest that a document's histograms, and both together, may lie from the nearest reference.
MAX_CLASS, MAX_WORDS, MAX_SUM = 0.30, 0.55, 0.57
MIN_N_WORDS, MAX_REPEAT_PERCENT = 10, 20

#: lower, upper, digit, sentence mark, symbol, other ASCII, lead byte of another letter, not counted
N_CLASSES = 7
CLASS = np.full(256, 7, dtype=np.uint8)
CLASS[33:128] = 5
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
CLASS[0xC0:256] = 6
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_POINT = np.ones(256, dtype=bool)
_POINT[0x80:0xC0] = False


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _keyed(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return V.mix64(hashes ^ (docs.astype(V.U64) * V.U64(0x9E3779B97F4A7C15)))


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether keys[order] occurs at least twice)"""
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return order, twice


class Measured:
    """The base counts of a run of texts, and what the histograms need."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = self.words = V.Words(data, offsets)
        n = len(offsets) - 1
        self.hashes = w.hashes()
        self.n_words = w.counts
        self.word_chars = _per_text(w.solid & _POINT[data], offsets)
        self.n_symbols = _per_text(_SYMBOL[data], offsets)
        self.n_dup_lines = self._lines(data, offsets, w)
        starts, windows = V.window_hashes(self.hashes, w.first, 5)
        covered = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        if len(starts):
            order, twice = _again(_keyed(windows, w.docs()[starts]))
            hit = starts[order[twice]]
            np.add.at(covered, hit, 1)
            np.add.at(covered, np.minimum(hit + 5, len(self.hashes)), -1)
        self.n_repeat_words = _per_text(np.cumsum(covered[:-1]) > 0, w.first)
        self.base_failed = (self.n_words < MIN_N_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)
        kind = CLASS[data]
        self.classes = np.stack([_per_text(kind == k, offsets) for k in range(N_CLASSES)], axis=1) if n else np.zeros((0, N_CLASSES), np.int64)

    @staticmethod
    def _lines(data: np.ndarray, offsets: np.ndarray, w: V.Words) -> np.ndarray:
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
        starts = starts[starts < len(data)]
        if not len(starts):
            return np.zeros(n, np.int64)
        ends = np.append(starts[1:], len(data))
        ends = ends - (data[ends - 1] == 10)
        docs = np.searchsorted(offsets, starts, "right") - 1
        has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        starts, ends, docs = starts[has], ends[has], docs[has]
        keys = _keyed(V.span_hashes(data, starts, ends), docs)
        _, first = np.unique(keys, return_index=True)
        return np.bincount(docs, minlength=n) - np.bincount(docs[first], minlength=n)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p from q; rows sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> list[dict]:
    """References counted over all documents that pass the base rules: one scan, one aggregate by word.

    What reaches the driver is bounded: at most 1/COMMON words for each of at most 1/LEAST_LANG languages.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                keys, at = np.unique(keys, return_inverse=True)
                counts = np.bincount(at, counts).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "key", "n"])
            held.clear()

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            data, offsets = V.flat(batch.column(1))
            for i, j in V.spans(offsets):
                m = Measured(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = names[i:j]
                for name in {x for x in own if x is not None}:
                    pick = (own == name) & ~m.base_failed
                    if not pick.any():
                        continue
                    keys, counts = np.unique(m.hashes[np.repeat(pick, m.n_words)], return_counts=True)
                    extra = np.append(m.classes[pick].sum(axis=0), [pick.sum(), m.n_words[pick].sum()])
                    # the first few keys stand for classes, documents and words
                    held.setdefault(name, []).append((np.concatenate([np.arange(len(extra), dtype=np.uint64), keys]), np.concatenate([extra, counts])))
                    size += len(keys)
            if size > 1_000_000:
                yield from out()
                size = 0
        yield from out()

    counts = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col(lang).isNotNull()).mapInArrow(run, "lang string, key long, n long")
    counts = counts.groupBy("lang", "key").agg(F.sum("n").alias("n")).persist()
    n = N_CLASSES
    heads = counts.where(F.col("key").between(0, n + 1)).groupBy("lang").agg(*[F.sum(F.when(F.col("key") == k, F.col("n"))).alias(f"k{k}") for k in range(n + 2)])
    total = heads.agg(F.sum(f"k{n}")).first()[0] or 0
    heads = heads.where(F.col(f"k{n}") >= LEAST_LANG * total)
    words = counts.where(~F.col("key").between(0, n + 1)).join(F.broadcast(heads.select("lang", F.col(f"k{n + 1}").alias("all"))), "lang").where(F.col("n") >= COMMON * F.col("all"))
    refs = {r["lang"]: {"lang": r["lang"], "classes": np.array([r[f"k{k}"] for k in range(n)], float), "all": r[f"k{n + 1}"], "words": []} for r in heads.collect()}
    for r in words.select("lang", "key", "n").collect():
        refs[r["lang"]]["words"].append((r["key"], r["n"]))
    counts.unpersist()
    out = []
    for name in sorted(refs):
        r = refs[name]
        r["words"].sort()
        if r["classes"].sum() > 0:
            keys = np.array([k for k, _ in r["words"]], dtype=np.int64).view(np.uint64)
            order = np.argsort(keys)
            shares = np.array([c for _, c in r["words"]], float)[order] / max(1, r["all"])
            out.append({"lang": name, "classes": r["classes"] / r["classes"].sum(), "keys": keys[order], "shares": np.append(shares, max(0.0, 1 - shares.sum()))})
    return out


def divergence(m: Measured, refs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest reference, distance by classes, distance by words) of each text."""
    n = len(m.n_words)
    shares = m.classes / np.maximum(1, m.classes.sum(axis=1, keepdims=True))
    docs = m.words.docs()
    by_class, by_word = np.ones((len(refs), n)), np.ones((len(refs), n))
    for k, r in enumerate(refs):
        by_class[k] = distance(shares, r["classes"][None])
        at = np.searchsorted(r["keys"], m.hashes)
        known = at < len(r["keys"])
        known[known] = r["keys"][at[known]] == m.hashes[known]
        at[~known] = len(r["keys"])
        width = len(r["keys"]) + 1
        seen = np.bincount(docs * width + at, minlength=n * width).reshape(n, width)
        by_word[k] = distance(seen / np.maximum(1, m.n_words)[:, None], r["shares"][None])
    best = np.argmin(by_class + by_word, axis=0)
    pick = np.arange(n)
    return best, by_class[best, pick], by_word[best, pick]


def judge(df: DataFrame, refs: list[dict], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``class_distance``, ``word_distance``, ``nearest_lang`` and
    ``kept``. ``keep`` names the columns to pass through (all by default); result columns win a clash."""
    import pyspark.sql.types as T

    small_batches(df.sparkSession)
    long, flag, real = T.LongType(), T.BooleanType(), T.DoubleType()
    new = [("n_words", long), ("word_chars", long), ("n_symbols", long), ("n_dup_lines", long), ("n_repeat_words", long), ("base_failed", flag), ("kept", flag), ("class_distance", real), ("word_distance", real), ("nearest_lang", T.StringType())]
    names = [n for n, _ in new]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new])
    langs = np.array([r["lang"] for r in refs] or [None], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = V.flat(batch.column(batch.num_columns - 1))
            parts = []
            for i, j in V.spans(offsets):
                m = Measured(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if refs:
                    best, by_class, by_word = divergence(m, refs)
                else:
                    best, by_class, by_word = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i)
                judged = m.n_words >= MIN_WORDS
                far = (by_class > MAX_CLASS) | (by_word > MAX_WORDS) | (by_class + by_word > MAX_SUM)
                ok = ~m.base_failed & ~(judged & far)
                parts.append([m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, ok, by_class, by_word, langs[best]])
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(new))]
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *(pa.array(c, t, from_pandas=False) for c, t in zip(cols, types))], names=[*kept, *names])

    base = df.select(*[F.col(f"`{c}`") for c in kept])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(free_name(base, "text_in"))).mapInArrow(run, schema)
