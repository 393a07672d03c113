"""The near-dedup stage against brute force, with pairs on both sides of a similarity of 0.8."""

import random
import re

import pytest

from loomery.llm import alike

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    near = [0, 0]
    for a in range(len(texts)):
        for b in range(a):
            both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            near[0] += all_ and 0.8 <= both / all_ < 0.85
            near[1] += all_ and 0.7 <= both / all_ < 0.8
            if 5 * both >= 4 * all_:
                root[top(a)], root[top(b)] = [min(top(a), top(b))] * 2
    return {k for k in range(len(texts)) if top(k) == k}, near


@pytest.mark.parametrize("most", [4096, 8])
def test_near_dedup_links_at_the_bound_and_not_below(spark, monkeypatch, most):
    monkeypatch.setattr(alike, "MAX_RUN", most)
    r = random.Random(7)
    line = [f"common{k}" for k in range(12)]
    texts = [None, "", " ", "a b", "A  b", "a b c"]
    for k in range(60):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([60, 100, 300]))] + line * (k % 2)
        texts.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for _ in range(max(1, round(len(base) * r.uniform(0.012, 0.04)))):
                copy[r.randrange(len(copy))] = f"e{r.randint(0, 10**9)}"
            texts.append(" ".join(copy))
    base = [f"g{k}" for k in range(100)]
    for k in range(40):  # one large group of near copies
        copy = list(base)
        copy[r.randrange(100)] = copy[r.randrange(100)] = f"h{k}"
        texts.append(" ".join(copy))
    want, near = kept(texts)
    assert min(near) >= 15
    df = spark.createDataFrame([*enumerate(texts), (None, texts[-1])], "doc_id long, text string")
    got = [x["doc_id"] for x in alike.keep_one(df).collect()]
    assert got.count(None) == 1 and sorted(x for x in got if x is not None) == sorted(want)
    assert alike.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [400, 3000])
def test_pairs_below_the_bound_are_ruled_out_where_they_meet(spark, words):
    """40 texts that share 82 % of their shingles (a similarity of 0.70): as pairs they would be 780 rows, at any length."""
    r = random.Random(3)
    base = [f"b{k}" for k in range(words)]
    texts = []
    for k in range(40):
        at = r.randrange(words - words * 18 // 100)
        texts.append(" ".join(base[:at] + [f"o{k}x{i}" for i in range(words * 18 // 100)] + base[at + words * 18 // 100 :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common = alike.common_shingles(docs, 5, 42)
    sets = alike.nodes(docs, common, 5, 42).withColumn("label", alike.F.col("g"))
    assert sets.count() == 40
    near = sum(5 * len(shingles(a) & shingles(b)) >= 4 * len(shingles(a) | shingles(b)) for k, a in enumerate(texts) for b in texts[:k])
    assert near <= alike.candidates(sets, common, every=True).count() <= near + 60


def test_folded_sketches_are_those_of_fewer_cells(spark):
    import numpy as np

    some = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64))
    wide = alike.parity(some)
    assert len(wide) == 512 and len(alike.parity(some[:1024])) == 128
    cells = np.bincount((some & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    assert alike.folded(wide, 128).tobytes() == np.packbits(cells.astype(bool)).tobytes()
    both = alike.Sketches([wide, alike.parity(some[:2000]), alike.parity(some[:1000])])
    assert both.apart(np.array([0, 0, 1]), np.array([0, 1, 2])).tolist()[0] == 0
    # 2,000 members are 256 bytes, 1,000 are 128: a fold lies between them
    assert 0 < both.apart(np.array([1]), np.array([2]))[0] <= 1000


def test_deletion_variants_propose_links_that_are_then_counted(spark, monkeypatch):
    """Without the exact search, what fingerprints propose is linked if its shingles are alike, and only then."""
    none = lambda sets, common, every: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(alike, "candidates", none)
    base = [f"v{k}" for k in range(500)]
    texts = [" ".join(base[:499] + [f"last{k}"]) for k in range(12)] + [" ".join(f"z{k}" for k in range(300)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in alike.keep_one(docs).collect()) == [0, 12, 13]
    every = lambda sets: sets.select(alike.F.col("g").alias("a")).join(sets.select(alike.F.col("g").alias("b"))).where("a < b")
    monkeypatch.setattr(alike, "proposed", every)
    assert sorted(x["doc_id"] for x in alike.keep_one(docs).collect()) == [0, 12, 13]
