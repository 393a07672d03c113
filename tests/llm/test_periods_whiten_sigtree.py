"""Runs, whitening and the n-gram join against brute force and numpy, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import periods, sigtree, whiten

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Runs -----------------------------------------------------------------------------------------


def plain_runs(w, least=6, copies=4):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, copies * q):
                found.setdefault((i, j - i + q), q)
            i = j + (j == i)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(r, n, letters):
    w = [r.randint(0, letters) for _ in range(n)]
    if n and r.random() < 0.5:
        a, p = r.randrange(n), r.randint(1, max(1, n // 4))
        w = [x if i < a else w[min(n - 1, a + (i - a) % p)] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("least, copies", [(6, 4), (2, 2), (4, 3)])
def test_runs_equal_brute_force(least, copies):
    r = random.Random(least)
    for _ in range(150):
        texts = [periodic(r, r.choice([0, 1, 2, 5, 8, 30, 60, 120]), r.choice([0, 1, 2, 5])) for _ in range(r.randint(0, 6))]
        flat = np.array([x for t in texts for x in t], np.uint64)
        first = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        got = list(zip(*[c.tolist() for c in periods.runs(flat, first, least, copies)]))
        assert got == [(k, *x) for k, t in enumerate(texts) for x in plain_runs(t, least, copies)]


def test_runs_of_a_table(spark):
    r = random.Random(2)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "A a a a a a a", "é x é x é x é x\ty", "a b a b a b a b c d e c d e c d e c d e"]
    texts += [" ".join(f"w{x}" for x in periodic(r, 80, 2)) for _ in range(30)]
    texts.append(" ".join(f"w{k % 7}" for k in range(300_000)))  # over one megabyte, one run
    texts.append(" ".join(f"w{k}" for k in range(200_000)))
    rows = [*enumerate(texts), (None, texts[8]), (3, texts[8]), (3, texts[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_Runs", F.lit(-1)).withColumn("text in", F.lit("x")).withColumn("k0", F.lit("y"))
    out = periods.periodic_runs(df, keep=["doc_id", "N_Runs", "k0", "text"])
    assert out.columns == ["doc_id", "k0", "text", *periods.FACTS, "runs", "collapsed"]
    got = out.collect()
    digests = {(x["doc_id"], x["collapsed_sha256"], x["runs_sha256"]) for x in periods.periodic_runs(df, digests=True).collect()}
    assert len(got) == len(rows) and {x["k0"] for x in got} == {"y"}
    for x in got:
        w = WORD.findall(x["text"] or "")
        want = plain_runs(w) if len(w) < 1000 else [(0, 300_000, 7)] if len(w) == 300_000 else []
        assert [tuple(y) for y in x["runs"]] == want and x["n_runs"] == len(want)
        top = min(want, key=lambda y: (-y[1], y[0], y[2]), default=None)
        assert (x["start"], x["length"], x["period"], x["exponent_milli"]) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        left = " ".join(y for i, y in enumerate(w) if i not in gone)
        assert x["collapsed"] == left
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        assert (x["doc_id"], hashlib.sha256(left.encode()).hexdigest(), hashlib.sha256(lines.encode()).hexdigest()) in digests
    assert periods.periodic_runs(df.limit(0)).count() == 0


# Whitening ------------------------------------------------------------------------------------


def test_whitening_equals_eigenvectors(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((700, 12)) @ r.standard_normal((12, 12)) + 3
    x[200:420] = x[199]  # many copies
    odd = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0, 2.0], [1e300] * 12]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v) for k, v in enumerate(odd)] + [(None, x[5].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("x")).repartition(37)
    got = whiten.whiten(df).collect()
    whole = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in rows if v is not None and len(v) == 12 and all(c is not None and np.isfinite(c) and abs(c) < 1e200 for c in v)], object)
    n, s = len(whole), whole.sum(axis=0)
    centred = (whole * n - s).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == n * 8 and {g["n"] for g in got} == {n}
    dev = {k: int(sum((int(c) * n - int(t)) ** 2 for c, t in zip([int(np.floor(1024 * c)) + 100000 for c in v], s))) for k, v in enumerate(x)}
    sign = {}
    for g in got:
        c = g["component"] - 1
        assert abs(g["explained"] - values[c] / values.sum()) < 1e-9 and g["identity_error"] < 1e-9
        if g["vec_id"] is None:
            continue
        want = float(centred[g["vec_id"]] @ axes[:, c] / np.sqrt(values[c]))
        if abs(want) > 1e-3:
            assert sign.setdefault(c, np.sign(want * g["whitened"])) == np.sign(want * g["whitened"])
        assert abs(abs(want) - abs(g["whitened"])) < 1e-8 and int(g["deviation"]) == dev[g["vec_id"]]
    assert whiten.whiten(df.limit(0)).count() == 0 and whiten.whiten(df.where("vec_id >= 1000")).where("vec_id <> 1005 and vec_id <> 1001").count() == 0


def test_whitening_without_variance_and_with_large_sums(spark):
    flat = spark.createDataFrame([(k, [float(k), 2.0, 2.0]) for k in range(10)], "vec_id long, embedding array<float>")
    got = whiten.whiten(flat).collect()
    assert len(got) == 30 and all((g["whitened"] is None) == (g["component"] > 1) for g in got) and got[0]["identity_error"] < 1e-9
    one = whiten.whiten(flat.limit(1)).collect()
    assert [g["whitened"] for g in one] == [None] * 3 and {int(g["deviation"]) for g in one} == {0}
    big = whiten.whiten(spark.createDataFrame([(0, [4e12, 0.0]), (1, [-4e12, 1.0]), (2, [1.0, -1.0])], "vec_id long, embedding array<double>")).collect()
    x = [[int(c * 1024) + 100000 for c in v] for v in ([4e12, 0], [-4e12, 1], [1, -1])]
    s = [sum(c) for c in zip(*x)]
    assert {(g["vec_id"], int(g["deviation"])) for g in big} == {(k, sum((3 * c - t) ** 2 for c, t in zip(v, s))) for k, v in enumerate(x)}


# The n-gram join ------------------------------------------------------------------------------


def gram_sets(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def components_of(sets, ids, percent):
    top = list(range(len(sets)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    close = [0, 0]
    for b in range(len(sets)):
        for a in range(b):
            both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if every:
                close[0] += percent <= 100 * both / every < percent + 3
                close[1] += percent - 3 <= 100 * both / every < percent
                if 100 * both >= percent * every:
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(sets))], close


@pytest.mark.parametrize("block, least, percent", [(1 << 18, 256, 90), (600, 1, 90), (2000, 64, 80)])
def test_join_links_at_the_bound_and_not_below(spark, monkeypatch, block, least, percent):
    monkeypatch.setattr(sigtree, "BLOCK", block)
    monkeypatch.setattr(sigtree, "LEAST", least)
    r = random.Random(5)
    texts = [None, "", " \t", "a", "A", "a b", "a  B", "b a", "É", "é", "a b c", "a b c a b c"]
    for size in (10, 11, 12, 20, 45, 100, 250):
        for _ in range(4):
            base = [f"w{r.randint(0, 3000)}" for _ in range(size)]
            for _ in range(6):
                copy = list(base)
                for _ in range(r.randint(0, max(1, size // 45))):
                    copy[r.randrange(size)] = f"e{r.randint(0, 10**9)}"
                if r.random() < 0.4:
                    copy = copy[r.randint(0, size // 12) :]
                texts.append(" ".join(copy))
    base = [f"g{k}" for k in range(120)]
    for k in range(60):  # one large group of near copies
        copy = list(base)
        for _ in range(2):
            copy[r.randrange(120)] = f"h{r.randint(0, 99)}"
        texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    texts += [texts[20], texts[21], texts[21], "only nulls here now"]
    ids += [None, 7, 7, None]
    want, close = components_of([gram_sets(t) for t in texts], ids, percent)
    assert min(close) >= 10
    want = [i if not gram_sets(t) else w for i, t, w in zip(ids, texts, want)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("G", F.lit("x")).withColumn("fk", F.lit("y"))
    got = sigtree.join(df, percent=percent).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(x["doc_id"], x["n_shingles"], x["component_id"]) for x in got], key=key) == sorted([(i, len(gram_sets(t)), w) for i, t, w in zip(ids, texts, want)], key=key)
    assert sigtree.join(df.limit(0)).count() == 0


def test_join_of_very_long_texts(spark):
    base = [f"w{k * k % 99991}" for k in range(250_000)]
    near, far = list(base), list(base)
    for k in range(0, 250_000, 100):
        near[k] = "x"
    for k in range(0, 250_000, 50):
        far[k] = f"y{k}"
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([base, near, far])], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in sigtree.join(df).collect()}
    sets = [gram_sets(" ".join(t)) for t in (base, near, far)]
    want, _ = components_of(sets, [0, 1, 2], 90)
    assert got == {k: (len(s), c) for k, (s, c) in enumerate(zip(sets, want))} and want == [0, 0, 2]


def test_segment_keys_lose_no_link_when_segments_are_empty():
    """Sets so small that segments often stay empty, at the bound of 90 of 100."""
    r = np.random.default_rng(6)
    for n in list(range(10, 30)) * 20:
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.append(a[: len(a) - 1], r.integers(0, 1 << 63, 0).astype(np.uint64)))
        c = np.unique(np.append(a[1:], r.integers(0, 1 << 63, 1).astype(np.uint64))) if n > 19 else b
        who, key = sigtree.segment_keys([a, b, c], 90)
        keys = [set(key[who == k].tolist()) for k in range(3)]
        for x, y, i, j in ((a, b, 0, 1), (a, c, 0, 2)):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 90 * (len(x) + len(y) - both):
                assert keys[i] & keys[j]
