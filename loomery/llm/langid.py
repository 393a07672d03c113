"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, the largest response of
each filter in a window is kept, and a softmax layer turns those into language probabilities. A text is
cut into overlapping windows that cover all of it, and its score is the mean over its windows, so a
text of any length costs memory for one batch of windows only.

Training takes at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of their id, and every
window of their whole texts; that bound on rows is a parameter. All windows are learned from at least once,
and up to ``EPOCHS`` times while that makes no more than ``VISITS`` visits. Rows whose ids fall into the
held-out part are never learned from. The network (about 10 kB) travels with the tasks.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without any labelled
row to learn from, every text is ``und`` with score 0. Equal texts get equal results; ties between
languages go to the first by name. Of rows repeated with one id, the one with the smallest text is learned
from; rows with a null id are predicted, not learned from. Extra columns are handed through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import wordvec as V
from .sparkutil import free_name, sampled_ids, small_batches

SAMPLE_ROWS, EPOCHS, VISITS = 2000, 6, 60_000
WINDOW, WIDTHS, EMBED, FILTERS = 256, (2, 3, 4), 8, 16
STRIDE = WINDOW - max(WIDTHS) + 1
BATCH = 256


def window_starts(sizes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, windows of each text); the last window of a long text ends with it."""
    counts = np.where(sizes <= WINDOW, 1, -(-(sizes - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(sizes)), counts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][doc] + np.minimum(k * STRIDE, np.maximum(0, sizes[doc] - WINDOW)), counts


def windows(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Windows of bytes; what lies past a text's end is 0."""
    at = starts[:, None] + np.arange(WINDOW)
    inside = at < stops[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0) if len(data) else np.zeros((len(starts), WINDOW), np.uint8)


class ByteConv:
    """The network and its training."""

    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        f4 = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.langs = langs
        self.p = {"e": f4(256, EMBED, s=0.5), "o": f4(len(WIDTHS) * FILTERS, len(langs), s=0.1), "b": np.zeros(len(langs), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = f4(w * EMBED, FILTERS, s=(1 / (w * EMBED)) ** 0.5)
            self.p[f"c{w}"] = np.zeros(FILTERS, np.float32)

    def _patches(self, x: np.ndarray, w: int) -> np.ndarray:
        n, m = x.shape[0], WINDOW - w + 1
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, m, w * EMBED), (s[0], s[1], s[2]), writeable=False)

    def forward(self, b: np.ndarray, train: bool = False):
        x = np.ascontiguousarray(self.p["e"][b])
        best, where = [], []
        for w in WIDTHS:
            m = WINDOW - w + 1
            r = (self._patches(x, w).reshape(-1, w * EMBED) @ self.p[f"w{w}"]).reshape(len(b), m, FILTERS)
            best.append(r.max(axis=1) + self.p[f"c{w}"])
            if train:
                where.append(r.argmax(axis=1))
        pooled = np.concatenate(best, axis=1)
        hidden = np.maximum(pooled, 0)
        z = hidden @ self.p["o"] + self.p["b"]
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        probs = e / e.sum(axis=1, keepdims=True)
        return (probs, x, hidden, where) if train else probs

    def train(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, y: np.ndarray, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over the windows of data at ``starts`` (their texts end at ``stops``) with languages ``y``."""
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(max(1, min(EPOCHS, VISITS // len(y)))):
            order = r.permutation(len(y))
            for i in range(0, len(y), 64):
                pick = order[i : i + 64]
                b = windows(data, starts[pick], stops[pick])
                probs, x, hidden, where = self.forward(b, train=True)
                n = len(pick)
                dz = probs.copy()
                dz[np.arange(n), y[pick]] -= 1
                dz /= n
                g = {"o": hidden.T @ dz, "b": dz.sum(axis=0), "e": np.zeros_like(self.p["e"])}
                dh = (dz @ self.p["o"].T) * (hidden > 0)
                rows = np.arange(n)[:, None]
                for k, w in enumerate(WIDTHS):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    hit = self._patches(x, w)[rows, where[k]]  # texts, filters, patch
                    g[f"w{w}"] = np.einsum("nfp,nf->pf", hit, d)
                    g[f"c{w}"] = d.sum(axis=0)
                    dx = d[:, :, None] * self.p[f"w{w}"].T[None]
                    at = where[k][:, :, None] + np.arange(w)
                    np.add.at(g["e"], b[rows[:, :, None], at].reshape(-1), dx.reshape(-1, EMBED))
                step += 1
                for name, v in self.p.items():
                    m1[name] += 0.1 * (g[name] - m1[name])
                    m2[name] += 0.001 * (g[name] ** 2 - m2[name])
                    v -= (rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text."""
        starts, counts = window_starts(np.diff(offsets), offsets)
        stops = np.repeat(offsets[1:], counts)
        sums = np.zeros((len(counts), len(self.langs)))
        doc = np.repeat(np.arange(len(counts)), counts)
        for i in range(0, len(starts), BATCH):
            np.add.at(sums, doc[i : i + BATCH], self.forward(windows(data, starts[i : i + BATCH], stops[i : i + BATCH])))
        return sums / np.maximum(1, counts)[:, None]


_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(_LETTERS[data], dtype=np.int64))
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> ByteConv | None:
    """Trains on at most ``sample_rows`` rows of df with a language and a text, chosen by hash of the id."""
    known = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{doc_id}`").alias("id")).where("id is not null and lang is not null and length(text) > 0")
    chosen = sampled_ids(known.select("id").distinct(), sample_rows)  # at most sample_rows ids
    rows = known.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("r")).select("id", "r.*").collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    net = ByteConv(langs)
    if len(langs) > 1:
        rows.sort(key=lambda r: str(r["id"]))
        raw = [r["text"].encode("utf-8", "surrogatepass") for r in rows]
        edge = np.append(0, np.cumsum([len(t) for t in raw]))
        starts, counts = window_starts(np.diff(edge), edge)
        net.train(np.frombuffer(b"".join(raw), np.uint8), starts, np.repeat(edge[1:], counts), np.repeat([langs.index(r["lang"]) for r in rows], counts))
    return net


def predict(df: DataFrame, net: ByteConv | None, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score``. ``keep``: columns to pass through (all by default)."""
    import pyspark.sql.types as T

    small_batches(df.sparkSession)
    names = ["lang_pred", "score"]
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names] if keep is None else list(keep)
    base = df.select(*columns)
    schema = T.StructType([*base.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = V.flat(batch.column(batch.num_columns - 1))
            ok = has_letter(data, offsets)
            pred = np.full(len(ok), "und", dtype=object)
            score = np.zeros(len(ok))
            if net is not None and len(ok):
                probs = net.predict(data, offsets)
                best = probs.argmax(axis=1)
                pred[ok] = np.array(net.langs, dtype=object)[best[ok]]
                score[ok] = np.clip(probs[np.arange(len(ok)), best][ok], 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(pred, pa.string()), pa.array(score)], names=[*kept, *names])

    return df.select(*columns, F.col(f"`{text}`").alias(free_name(base, "text_in"))).mapInArrow(run, schema)
