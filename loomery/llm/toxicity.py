"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are ASCII-lowered runs of letters, digits and non-ASCII characters. Examples are at most
``EXAMPLES`` labelled rows of each class, those with the smallest hash of their id, and of near copies
among them one; that bound is the only one: every term of every example is indexed. A term weighs
(1 + ln tf) * idf * (1 + |log2 of its lift|): idf is counted over all documents, the lift (its share in
one class over that in the other, ``PRIOR`` pseudo-examples drawing rare terms to 1) over the examples,
so words that tell the classes apart decide among neighbours of one topic.

The search is exact: the examples stand in an order that puts like ones together, in blocks of ``BLOCK``.
A query adds up the postings of its rare terms; for those that one in ``COMMON`` examples or more has, it
adds the largest weight in each block, which bounds every cosine. It takes the ``FIRST`` blocks with the
largest bounds, and then every other one whose bound reaches the k-th best cosine. Ties go to the smaller
doc_id. Neighbours vote with weight 1 / (1 + EPS - cosine);
leave-one-out votes of the examples, weighted to the classes' true shares, are fitted by a monotone
function, linear between its pools, that turns a vote into a probability.

Defined results: a text without any term of the examples (null and empty ones too) gets the share of
toxic among examples without neighbours, or among all labels where there are none. Without labelled
examples, every score is 0. Rows of labels with a null id or label teach nothing; an id with several
labels counts as toxic if any says so; of rows repeated with one id the one with the least text is the
example. Extra columns are handed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import wordvec as V
from .sparkutil import free_name, sampled_ids, small_batches

EXAMPLES, PRIOR = 2000, 2.0
K, BLOCK, FIRST, COMMON, AXES, EPS = 15, 8, 16, 16, 16, 0.05
BANDS = 12
THRESHOLD = 0.3

BREAK = np.ones(256, dtype=bool)
BREAK[48:58] = BREAK[65:91] = BREAK[97:123] = BREAK[128:256] = False


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term occurrence, first occurrence of each text)"""
    w = V.Words(data, offsets, lower=True, space=BREAK)
    return w.hashes(), w.first


def alike(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, ids: list[int]) -> list[int]:
    """The vectors in an order that puts like ones together: halved again and again along the widest of their
    ``AXES`` main components over common terms. The order decides what a search skips, never what it finds."""
    many = np.bincount(np.concatenate([t for t, _ in vectors]), minlength=terms)
    row = np.cumsum(many * COMMON >= len(vectors)) * (many * COMMON >= len(vectors)) - 1
    table = np.zeros((len(vectors), row.max() + 1))
    for i, (t, w) in enumerate(vectors):
        table[i, row[t][row[t] >= 0]] = w[row[t] >= 0]
    left, size, _ = np.linalg.svd(table, full_matrices=False)
    points = (left * size)[:, :AXES]
    todo, out = [np.lexsort((np.array(ids),))], []
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK or not points.shape[1]:
            out += part.tolist()
            continue
        part = part[np.argsort(points[part, points[part].var(axis=0).argmax()], kind="stable")]
        half = -(-len(part) // (2 * BLOCK)) * BLOCK
        todo += [part[half:], part[:half]]
    return out


class Index:
    """Block-max inverted index over unit vectors of all terms of the examples.

    Postings are kept by term. Terms that at least one in ``COMMON`` examples has also get a row each of
    weights by example and of the largest weight in each block.
    """

    def __init__(self, vocab: np.ndarray, weight: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], ids: list[int], y: np.ndarray, share: float):
        self.vocab, self.weight = vocab, weight
        vectors = [self.vector(t, c) for t, c in rows]
        order = alike(vectors, len(vocab), ids)
        vectors = [vectors[i] for i in order]
        self.ids, self.y = np.array([ids[i] for i in order], dtype=np.int64), y[order]
        terms = np.concatenate([t for t, _ in vectors])
        by = np.argsort(terms, kind="stable")  # postings by term, then by rank
        self.doc = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])[by]
        self.value = np.concatenate([w for _, w in vectors])[by]
        self.start = np.searchsorted(terms[by], np.arange(len(vocab) + 1))
        self._lay_out()
        self.steps = self._calibrate(share, vectors)

    def _lay_out(self) -> None:
        """The rows of common terms, made from the postings wherever the index arrives."""
        self.blocks = -(-len(self.ids) // BLOCK)
        size = np.diff(self.start)
        common = np.flatnonzero(size * COMMON >= len(self.ids))
        self.row = np.full(len(self.vocab), -1)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.blocks, BLOCK))
        for row, t in zip(self.table.reshape(len(common), -1), common.tolist()):
            at = slice(self.start[t], self.start[t + 1])
            row[self.doc[at]] = self.value[at]
        self.most = self.table.max(axis=2)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "table", "most")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lay_out()

    @property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each example by rank, put together from the postings."""
        by = np.argsort(self.doc, kind="stable")
        terms, cuts = np.repeat(np.arange(len(self.vocab)), np.diff(self.start))[by], np.searchsorted(self.doc[by], np.arange(len(self.ids) + 1))
        value = self.value[by]
        return [(terms[a:b], value[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[terms]
        norm = np.sqrt((w * w).sum())
        return terms, w / norm if norm > 0 else w

    def _whole(self, score: np.ndarray, common: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of all examples of ``blocks``: what is in ``score`` and the products of the common terms."""
        rows = self.table[common[:, None], blocks].reshape(len(common), len(blocks) * BLOCK)
        return score.reshape(-1, BLOCK)[blocks].reshape(-1) + w @ rows

    def nearest(self, terms: np.ndarray, w: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, cosines) of the K examples nearest, none with cosine 0. Cosines are rounded to 12 digits."""
        row = self.row[terms]
        rare, common = terms[row < 0], row[row >= 0]
        size = self.start[rare + 1] - self.start[rare]
        at = np.repeat(self.start[rare] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], np.repeat(w[row < 0], size) * self.value[at], self.blocks * BLOCK)
        w = w[row >= 0]
        bound = score + np.repeat(w @ self.most[common], BLOCK)  # of each example: its rare terms, the most that its block has of common ones
        if without >= 0:
            score[without] = bound[without] = 0
        best = bound.reshape(-1, BLOCK).max(axis=1)
        first = np.argpartition(best, len(best) - min(FIRST, len(best)))[-FIRST:]
        scores = self._whole(score, common, w, first)
        worst = np.partition(scores, len(scores) - K)[len(scores) - K] if len(scores) > K else 0.0
        best[first] = 0
        more = np.flatnonzero((best >= worst - 1e-9) & (best > 0))
        ranks = (np.append(first, more)[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
        if len(more):
            scores = np.append(scores, self._whole(score, common, w, more))
        scores[ranks == without] = 0
        scores = np.round(scores, 12)
        ranks, scores = ranks[scores > 0], scores[scores > 0]
        top = np.lexsort((self.ids[ranks], -scores))[:K]
        return ranks[top], scores[top]

    def vote(self, ranks: np.ndarray, scores: np.ndarray) -> float:
        w = 1 / (1 + EPS - np.minimum(scores, 1))
        return float((w * self.y[ranks]).sum() / w.sum())

    def _calibrate(self, share: float, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
        """(votes, probabilities) that a monotone function joins, by pooling adjacent violators; that of no terms."""
        n1 = max(1, int(self.y.sum()))
        n0 = max(1, len(self.y) - n1)
        weight = np.where(self.y == 1, share / n1, (1 - share) / n0) * len(self.y)
        votes = []
        for i, (t, w) in enumerate(vectors):
            r, s = self.nearest(t, w, without=i) if len(t) else (np.zeros(0, np.int64), None)
            votes.append(self.vote(r, s) if len(r) else -1.0)
        votes = np.array(votes)
        bare = votes < 0
        none = float((weight * self.y)[bare].sum() / max(1e-9, weight[bare].sum())) if bare.any() else share
        pools: list[list[float]] = []
        order = np.argsort(votes, kind="stable")
        for v, y, w in zip(votes[order], self.y[order], weight[order]):
            if v < 0:
                continue
            pools.append([w * v, w * y, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools]), none

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        votes, probs, none = self.steps
        if not len(terms) or not len(votes):
            return none, []
        r, s = self.nearest(*self.vector(terms, counts))
        if not len(r):
            return none, []
        return float(min(1.0, max(0.0, np.interp(self.vote(r, s), votes, probs)))), self.ids[r[:3]].tolist()


def known(vocab: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vocabulary terms, counts) of each text."""
    at = np.searchsorted(vocab, hashes)
    at[at == len(vocab)] = 0
    hit = np.flatnonzero(vocab[at] == hashes) if len(vocab) else np.zeros(0, np.int64)
    cuts = np.searchsorted(hit, first)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield np.unique(at[hit[a:b]], return_counts=True) if b > a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def sketch(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """``BANDS`` keys of each text, each of two minimum hashes of its runs of three terms; none for very short texts."""
    starts, runs = V.window_hashes(hashes, first, 3)
    cuts = np.searchsorted(starts, first)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        least = [V.mix64(runs[a:b] + V.U64(k * 0x9E3779B97F4A7C15 % (1 << 64))).min() for k in range(2 * BANDS)] if b > a else []
        out.append(np.array(least, V.U64).tobytes())
    return out


def one_of_each(rows: list) -> list:
    """The examples less all but the first of each family of copies and near copies: those that share a band.

    Else the rare words of one text that was copied often would pass for signs of its label.
    """
    taken: set[tuple[int, int, int]] = set()
    out = []
    for r in rows:
        least = np.frombuffer(r["sketch"], V.U64).tolist()
        own = {(k, least[2 * k], least[2 * k + 1]) for k in range(len(least) // 2)}
        if not own & taken:
            out.append(r)
        taken |= own
    return out


def fit(docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None, examples: int = EXAMPLES, label: str = "toxic") -> Index | None:
    """Builds the index from labelled rows of ``labels`` (doc_id and ``label``) with their texts in ``docs``.

    ``all_docs``: what document frequencies are counted over (docs by default).
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    totals = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if not totals:
        return None
    parts = [sampled_ids(marks.where(F.col("y") == y).select("doc_id"), examples).withColumn("y", F.lit(y)) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * examples ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = V.flat(batch.column(2))
            keys, counts, sketches = [], [], []
            for i, j in V.spans(offsets):
                h, first = terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sketches += sketch(h, first)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    k, c = np.unique(h[a:b], return_counts=True)
                    keys.append(k.tobytes())
                    counts.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "y", "keys", "counts", "sketch"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(count, "doc_id long, y int, keys binary, counts binary, sketch binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["keys"], r["counts"]), reverse=True)
    rows = one_of_each(sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: r["doc_id"]))
    if not rows:
        return None
    y = np.array([r["y"] for r in rows], float)
    bags = [(np.frombuffer(r["keys"], V.U64), np.frombuffer(r["counts"], np.int32)) for r in rows]
    vocab, back = np.unique(np.concatenate([k for k, _ in bags]), return_inverse=True)  # bounded by the examples
    owner = np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags])
    df1, df0 = np.bincount(back, y[owner], len(vocab)), np.bincount(back, 1 - y[owner], len(vocab))
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    lift = np.abs(np.log2((df1 / n1 + PRIOR / (n1 + n0)) / (df0 / n0 + PRIOR / (n1 + n0)))) if 0 < y.sum() < len(y) else np.zeros(len(vocab))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(len(vocab) + 1, np.int64), 0
        for batch in batches:
            data, offsets = V.flat(batch.column(0))
            for i, j in V.spans(offsets):
                for t, _ in known(vocab, *terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    seen[t] += 1
                texts += j - i
        seen[-1] = texts
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["t", "n"])

    found = (docs if all_docs is None else all_docs).select("text").mapInArrow(frequency, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    freq = np.zeros(len(vocab) + 1)
    freq[np.asarray(found.column("t"))] = np.asarray(found.column("n"))
    idf = np.log((1 + freq[-1]) / (1 + freq[:-1])) + 1
    at, cut = 0, []
    for k, cnt in bags:
        cut.append((back[at : at + len(k)], cnt))
        at += len(k)
    return Index(vocab, idf * (1 + lift), cut, [r["doc_id"] for r in rows], y, totals.get(1, 0) / sum(totals.values()))


def score(df: DataFrame, index: Index | None, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """Adds ``score``, ``predicted`` and ``evidence`` (ids of the nearest examples, nearest first)."""
    import pyspark.sql.types as T

    small_batches(df.sparkSession)
    names = ["score", "predicted", "evidence"]
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names] if keep is None else list(keep)
    base = df.select(*columns)
    schema = T.StructType([*base.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType()))])
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = V.flat(batch.column(batch.num_columns - 1))
            got: list[tuple[float, list[int]]] = []
            for i, j in V.spans(offsets):
                if index is None:
                    got += [(0.0, [])] * (j - i)
                    continue
                got += [index.score(t, c) for t, c in known(index.vocab, *terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))]
            cols = [pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= THRESHOLD) for s, _ in got], pa.int32()), pa.array([e for _, e in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *cols], names=[*kept, *names])

    return df.select(*columns, F.col(f"`{text}`").alias(free_name(base, "text_in"))).mapInArrow(run, schema)
