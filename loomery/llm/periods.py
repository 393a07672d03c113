"""Runs of repeated words by the tandem repeats of a suffix tree (Stoye and Gusfield).

A run is a stretch of words with smallest period q, at least ``copies`` times q and ``least`` words long, that
no neighbouring word extends. Tasks take texts in blocks of about a megabyte. A block's words get ranks by prefix
doubling, started with (text, word), so no two texts share a prefix and the trees of all texts of a block are
built in the same vector steps. Neighbouring leaves' common prefixes come from the ranks of all powers of two, and the
inner nodes are the maximal intervals of leaves whose common prefix is not shorter than their own.

At each inner node of depth D every leaf i outside the child with most leaves is listed (no leaf is listed
more than log2(n) times), and i + D and i - D are looked up in the node's interval. Where one is there and the
words that follow differ, a branching tandem repeat of period D is found. Each run ends in one for each multiple of
its period that fits twice. Repeats are rotated to the left, again by powers of two, as far as words stay
equal, and those of one stretch are merged into the run with the smallest period.

Words are told apart by 64-bit hashes. A text's memory grows with its words times the logarithm of its longest
repeat.

Defined results: null, empty and blank texts have no words and no runs. Rows with a null id and repeated rows
are kept, each with its own runs. An empty table gives no rows. Columns of the table are passed on only where ``keep`` names
them; results shadow columns of equal names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import wordvec as V
from .sparkutil import small_batches


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal for equal ones."""
    order = np.argsort(keys, kind="stable")
    fresh = np.append(0, keys[order][1:] != keys[order][:-1])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def spaced(rank: np.ndarray) -> np.ndarray:
    """Dense ranks as positions: every rank becomes the number of those below it."""
    count = np.bincount(rank)
    return (np.cumsum(count) - count)[rank]


def levels(tokens: np.ndarray, doc: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """For each power of two, as long as prefixes repeat, the ranks of the prefixes of that many words.

    The last one ranks whole suffixes. tokens: hashes; doc and stop: each word's text and where that ends.
    """
    word = _dense(tokens)
    n = len(word)
    rank = spaced(_dense(doc * (int(word.max(initial=0)) + 1) + word))
    out, step = [rank], 1
    where = np.arange(n)
    while len(where):
        size = np.bincount(rank, minlength=n)
        where = where[size[rank[where]] > 1]  # a prefix that is alone stays alone
        if not len(where):
            break
        after = np.zeros(len(where), np.int64)
        inner = where + step < stop[where]
        after[inner] = rank[where[inner] + step] + 1
        head = rank[where]
        order = np.lexsort((after, head))
        h, a = head[order], after[order]
        first = np.append(True, h[1:] != h[:-1])
        fresh = first | np.append(True, a[1:] != a[:-1])
        # a rank is the number of prefixes below it: a new group's is the old one's and what precedes it there
        at = np.arange(len(h))
        group_at = np.maximum.accumulate(np.where(first, at, 0))
        own_at = np.maximum.accumulate(np.where(fresh, at, 0))
        new = rank.copy()
        new[where[order]] = h + own_at - group_at
        rank, step = new, step * 2
        out.append(rank)
    return out


def ahead(levels_: list[np.ndarray], a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many words from a and b on are equal; a and b differ, in one text."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels_) - 1, -1, -1):
        fits = np.maximum(a, b) + out + (1 << k) <= stop
        x, y = np.where(fits, a + out, 0), np.where(fits, b + out, 0)
        out += np.where(fits & (levels_[k][x] == levels_[k][y]), 1 << k, 0)
    return out


def behind(levels_: list[np.ndarray], a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many words before a and b are equal; a < b."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels_) - 1, -1, -1):
        fits = a - out - (1 << k) >= start
        x, y = np.where(fits, a - out - (1 << k), 0), np.where(fits, b - out - (1 << k), 0)
        out += np.where(fits & (levels_[k][x] == levels_[k][y]), 1 << k, 0)
    return out


def smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The nearest place before (step -1) or after (1) each of ``at`` with a smaller lcp. Both ends of lcp are -1.

    Pointers skip by those that others have come to: what lies between is never smaller.
    """
    to = np.arange(len(lcp)) + step
    open_ = at
    while len(open_):
        open_ = open_[lcp[to[open_]] >= lcp[open_]]
        to[open_] = to[to[open_]]
    return to[at]


def tandem_repeats(levels_: list[np.ndarray], doc: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat of every text."""
    rank = levels_[-1]
    n = len(rank)
    leaf = np.empty(n, np.int64)
    leaf[rank] = np.arange(n)
    a, b = leaf[:-1], leaf[1:]
    same = np.flatnonzero(levels_[0][a] == levels_[0][b])
    lcp = np.zeros(n + 1, np.int64)  # lcp[k]: of leaves k - 1 and k
    lcp[0] = lcp[n] = -1
    lcp[same + 1] = ahead(levels_, a[same], b[same], stop[a[same]])
    edge = same + 1  # where an inner node's children meet
    if not len(edge):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = smaller(lcp, edge, -1), smaller(lcp, edge, 1)
    order = np.lexsort((edge, right, left))
    edge, left, right = edge[order], left[order], right[order]
    first = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    node = np.cumsum(first) - 1
    # children: from the node's left end to its first edge, from edge to edge, and from its last edge to its right end
    begins = np.concatenate([left[first], edge])
    owner = np.concatenate([np.arange(int(node[-1]) + 1), node])
    order = np.lexsort((begins, owner))
    begins, owner = begins[order], owner[order]
    top = right[first]
    ends = np.append(begins[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = top[owner[last]]
    size = ends - begins
    most = np.maximum.reduceat(size, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
    largest = size == most[owner]
    # of equally large children only the first is left out
    seen = np.cumsum(largest)
    before = (seen - largest)[np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))]
    listed = ~(largest & (seen - before[owner] == 1))
    begins, size, owner = begins[listed], size[listed], owner[listed]
    at = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    owner = np.repeat(owner, size)
    i, depth, low, high = leaf[at], lcp[edge[first]][owner], left[first][owner], right[first][owner]
    found = [], []
    for other in (i + depth, i - depth):
        held = (other >= 0) & (other < n)
        held[held] &= doc[other[held]] == doc[i[held]]
        held[held] &= (rank[other[held]] >= low[held]) & (rank[other[held]] < high[held])
        s, d = np.minimum(i, other)[held], depth[held]
        inner = s + 2 * d < stop[s]
        branching = ~inner
        branching[inner] = levels_[0][s[inner] + 2 * d[inner]] != levels_[0][s[inner] + d[inner]]
        found[0].append(s[branching])
        found[1].append(d[branching])
    return np.concatenate(found[0]), np.concatenate(found[1])


def runs(tokens: np.ndarray, first: np.ndarray, least: int = 6, copies: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, in the order of text, start and period; start counts in the text.

    first: where each text's words begin in tokens, and the number of all of them at the end.
    """
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(doc):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    stop, start = np.repeat(first[1:], counts), np.repeat(first[:-1], counts)
    ranks = levels(tokens, doc, stop)
    s, p = tandem_repeats(ranks, doc, stop)
    begin = s - behind(ranks, s, s + p, start[s])
    size = s + 2 * p - begin
    good = size >= np.maximum(least, copies * p)
    begin, size, p = begin[good], size[good], p[good]
    order = np.lexsort((p, size, begin))
    begin, size, p = begin[order], size[order], p[order]
    fresh = np.append(True, (begin[1:] != begin[:-1]) | (size[1:] != size[:-1]))[: len(begin)]
    begin, size, p = begin[fresh], size[fresh], p[fresh]
    order = np.lexsort((p, begin))
    begin, size, p = begin[order], size[order], p[order]
    return doc[begin], begin - start[begin], size, p


FACTS = ["n_runs", "start", "length", "period", "exponent_milli"]
WHOLE = {"runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
DIGESTS = {"runs_sha256": "string", "collapsed_sha256": "string"}


def periodic_runs(df: DataFrame, text: str | Column = "text", keep: list | None = None, digests: bool = False, least: int = 6, copies: int = 4) -> DataFrame:
    """A row for each row of df: the columns ``keep``, n_runs, the longest run, all runs and the collapsed text.

    Of equally long runs the first starts earliest, then has the smallest period. The collapsed text has every
    run's words dropped after its first period, joined by single spaces. ``digests``: sha256 of the runs (lines
    start,length,period) and of the collapsed text in place of both.
    """
    small_batches(df.sparkSession)
    own = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in (["doc_id"] if keep is None else keep)]
    kept = df.select(*own)
    names = [f"k{k}" for k in range(len(kept.columns))]
    column = F.col(f"`{text}`") if isinstance(text, str) else text
    made = df.select(*own, column.alias("text in")).toDF(*names, "text in")
    last = DIGESTS if digests else WHOLE
    schema = ", ".join([f"{n} {t.dataType.simpleString()}" for n, t in zip(names, kept.schema)] + [f"{c} long" for c in FACTS] + [f"{c} {t}" for c, t in last.items()])

    def block(data: np.ndarray, offsets: np.ndarray) -> list[list]:
        w = V.Words(data, offsets)
        doc, start, length, period = runs(w.hashes(), w.first, least, copies)
        n, total = len(w.counts), len(w.starts)
        cut = np.searchsorted(doc, np.arange(n + 1))
        drop = np.zeros(total + 1, np.int64)
        np.add.at(drop, w.first[doc] + start + period, 1)
        np.add.at(drop, w.first[doc] + start + length, -1)
        gone = np.cumsum(drop)[:-1] > 0
        best = np.lexsort((period, start, -length, doc))
        raw = w.data.tobytes()
        a, b = w.starts.tolist(), w.ends.tolist()
        out: list[list] = [[] for _ in range(7)]
        for k in range(n):
            x, y = int(cut[k]), int(cut[k + 1])
            lo, hi = int(w.first[k]), int(w.first[k + 1])
            words = range(lo, hi) if x == y else (np.flatnonzero(~gone[lo:hi]) + lo).tolist()
            left = b" ".join([raw[a[t] : b[t]] for t in words])
            own = list(zip(start[x:y].tolist(), length[x:y].tolist(), period[x:y].tolist()))
            top = own[int(best[x]) - x] if own else None
            row = [len(own), *(top or (None,) * 3), top and 1000 * top[1] // top[2]]
            if digests:
                row += [hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in own).encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
            else:
                row += [[{"start": s, "length": m, "period": p} for s, m, p in own], left.decode()]
            for c, v in zip(out, row):
                c.append(v)
        return out

    struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    types = [pa.int64()] * 5 + ([pa.string()] * 2 if digests else [struct, pa.string()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = V.flat(batch.column(batch.num_columns - 1))
            for i, j in V.spans(offsets):
                found = block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                arrays = [batch.column(k).slice(i, j - i) for k in range(len(names))] + [pa.array(c, t) for c, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *FACTS, *last])

    out = made.mapInArrow(work, schema)
    shadowed = {c.lower() for c in [*FACTS, *last]}
    picked = [F.col(n).alias(c) for n, c in zip(names, kept.columns) if c.lower() not in shadowed]
    return out.select(*picked, *out.columns[len(names) :])
