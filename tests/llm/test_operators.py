"""Small tests of the ten operators: against brute force, and on nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomery.llm import ann, bpe, langid, packing, ppm, quality, simhash, substring, toxicity, warc, wordvec as V
from loomery.llm.queries import vocabulary
from loomery.llm.sparkutil import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(4)
ODD = [None, "", " ", "\n\n", "a", "x" * 5000, "é" * 40, "a b " * 60, "漢字 テスト", "don't 's 'll x's", "A\tB\x0bC", "#*$%&|<> " * 30]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "river", "stone", "light", "walks", "under", "green", "sky"]) + r.choice(["", "", ",", "."]) for _ in range(n))


def frame(spark, texts, **more):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_word_hashes_do_not_depend_on_where_they_stand():
    long = "z" * (V.BLOCK + 77)
    data, offsets = V.flat(pa.array([f"a {long} b", long, "a b"]))
    w = V.Words(data, offsets)
    h = w.hashes()
    assert h[1] == h[3] and h[0] == h[4] and h[2] == h[5] and len(set(h.tolist())) == 3


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = [*ODD, "a<|endoftext|>B<|startoftext|>", "İstanbul ΣΑΣ ²½", prose(200)] + ["".join(R.choice("ab'stre  ,.9éΣ|<") for _ in range(30)) for _ in range(200)]
    rows = {r["doc_id"]: r for r in bpe.encode(frame(spark, texts), vocabulary("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == tk.decode(ids, skip_special_tokens=False) and rows[i]["score"] == "clash"


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = [*ODD, prose(900), prose(900), prose(3000, 2), *[prose(R.randint(1, 300), k) for k in range(40)]]
    rows = packing.pack(packing.encoded(frame(spark, texts), vocabulary("byte_bpe_50k.json"))).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [x for r in sorted(by[i], key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == tk.encode(t or "", add_special_tokens=False).ids + [0]
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(packing.encoded(frame(spark, texts).limit(0), vocabulary("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("n", [1, 5, 3000, 100_000])
def test_patterns_hold_every_rank(n):
    hist = Counter(R.choice([R.randint(1, 1023), 700, R.randint(1, 60)]) for _ in range(n))
    ids = Counter()
    for count, pieces in packing.patterns(hist):
        assert sum(p[3] for p in pieces) <= 1024
        for length, _, _, m in pieces:
            ids[length] += count * m
    assert ids == Counter({k: k * c for k, c in hist.items()})


def test_quality_counts(spark):
    texts = [*ODD, prose(300), " a b \n a b \na b", *[" ".join(R.choice(["a", "é", "#", "\n", "c d"]) for _ in range(R.randint(0, 60))) for _ in range(60)]]
    df = frame(spark, texts)
    rows = {r["doc_id"]: r for r in quality.judge(df, quality.fit(df)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)), t
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(df.limit(0), quality.fit(df.limit(0))).count() == 0


def test_simhash_components(spark):
    base = [prose(80, k) for k in range(6)]
    texts = [*ODD, *base, *[b.replace("river", "rivers", 1) for b in base], *base[:2]]
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = []
    for i, t in enumerate(texts):
        w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), seed=42) for k in range(max(1, len(w) - 3))] if w else []
        f = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert rows[i]["fingerprint"] == f"{f:016x}"
        prints.append(f)
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert [rows[i]["component_id"] for i in range(len(texts))] == root


def test_simhash_blocks_are_the_same(spark, monkeypatch):
    r = np.random.default_rng(1)
    centre = r.integers(0, 1 << 62)
    prints = sorted({int(centre) ^ sum(1 << int(b) for b in r.choice(63, R.randint(0, 6), replace=False)) for _ in range(150)})
    df = spark.createDataFrame([(p,) for p in prints], "f0 long")
    from loomery.llm.links import components

    whole = {tuple(x) for x in components(simhash.links(df, 4)).collect()}
    monkeypatch.setattr(simhash, "MAX_RUN", 16)
    assert {tuple(x) for x in components(simhash.links(df, 4)).collect()} == whole


def test_substring_removal(spark):
    passage = prose(70, 9)
    texts = [*ODD, prose(40, 1) + " " + passage + " " + prose(30, 2), "pre " + passage, prose(60, 3) + "  " + passage[: len(passage) // 2], passage, passage, " ".join(f"w{k}" for k in range(120)), " ".join(f"w{k}" for k in range(30, 160))]
    rows = {r["doc_id"]: r for r in substring.remove_repeats(frame(spark, texts), digests=True).collect()}
    first = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u v", "A"), (2, "u", "B"), (5, "u", "A"), (3, None, "A"), (4, "u", None), (6, "u", ""), (None, "u", "A"), (7, "u", "é" * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), roll=2000)
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and not [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".tmp")]
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[1]["refers_to"], by[3]["refers_to"], by[None]["refers_to"], by[4]["refers_to"]) == ("revisit", 5, 5, 5, 6)
    assert by[5]["record_type"] == "response" and bytes(by[7]["payload"]).decode() == "é" * 9000 and by[1]["payload_bytes"] == 1
    one = {p.name: p.read_bytes() for p in (tmp_path / "w").glob("*.gz")}
    warc.write(df, str(tmp_path / "again"), roll=2000)
    assert {p.name: p.read_bytes() for p in (tmp_path / "again").glob("*.gz")} == one
    assert warc.round_trip(df.limit(0)).count() == 0


def test_ppm_is_plain_ppm(spark):
    texts = [*ODD[:6], *[prose(R.randint(1, 60), k) for k in range(20)]]
    df = frame(spark, texts)
    rows = {r["doc_id"]: r for r in ppm.score(df, held_out(F.col("doc_id"), 7)).collect()}
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    order, trie, counts = ppm.ORDER, defaultdict(Counter), Counter()
    for t, ok in zip(texts, train):
        if ok:
            counts.update([*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None])
            s = [256] * order + list((t or "").encode()) + [256]
            for i in range(order, len(s)):
                for o in range(order + 1):
                    trie[tuple(s[i - o : i])][s[i]] += 1
    total, distinct = sum(counts.values()), len(counts)

    def length(context, symbol):
        gone, p = set(), 0.0
        for o in range(order, -1, -1):
            seen = trie.get(tuple(context[order - o :]))
            if seen:
                rest = {k: v for k, v in seen.items() if k not in gone}
                if rest:
                    n = sum(rest.values()) + len(rest)
                    if symbol in rest:
                        return p + math.log10(rest[symbol] / n)
                    p += math.log10(len(rest) / n)
                gone = set(seen)
        return p - math.log10(257 - len(gone))

    for i, t in enumerate(texts):
        w = [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
        s = [256] * order + list((t or "").encode()) + [256]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], len(w), sum(counts[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w))
        assert r["score"] == pytest.approx(sum(length(s[k - order : k], s[k]) for k in range(order, len(s))))


def test_neighbours_recall_and_odd_vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 32)) * r.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(3000, None), (3020, [0.0] * 32), (3040, [float("nan")] * 32), (3060, [None] * 32), (3080, []), (None, x[0].tolist()), (20, x[20].tolist())]
    got = defaultdict(list)
    for q in ann.search(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[q["query_id"]].append((q["vec_id"], q["score"]))
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s)[:20].tolist())
        assert len(got[q]) == 20 and all(abs(s[v] - w) < 1e-9 for v, w in got[q])
        hits += len(best & {v for v, _ in got[q]})
    assert set(got) == set(range(0, 3000, 20)) and hits / (150 * 20) >= 0.9


def test_language_and_odd_texts(spark):
    fr = lambda n, k: " ".join(random.Random(k).choice(["le", "été", "près", "où", "ça", "forêt"]) for _ in range(n))
    texts = [prose(80, k) if k % 2 else fr(80, k) for k in range(120)] + ODD
    rows = [(i, t, ("en" if i % 2 else "fr") if i < 120 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.predict(df, langid.fit(df.where("doc_id % 4 <> 2"))).collect()}
    held = [i for i in range(120) if i % 4 == 2]
    assert np.mean([out[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert all(out[120 + k]["lang_pred"] == "und" and out[120 + k]["score"] == 0 for k in (0, 1, 2, 3, 11)) and all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in langid.predict(df, langid.fit(df.limit(0))).collect()} == {"und"}


def test_toxicity_search_is_exact_and_catches(spark):
    bad = ["vile", "rotten", "filthy"]
    texts = [prose(60, k) + (" " + R.choice(bad) + ", you" if k % 5 == 0 else "") for k in range(300)] + ODD
    df = frame(spark, texts).drop("score")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    index = toxicity.fit(df, labels)
    for terms, w in index.vectors[:40]:
        if len(terms):
            every = sorted(((sum(w[list(terms).index(t)] * x for t, x in zip(*v) if t in set(terms.tolist()))), -i) for i, v in enumerate(index.vectors))[::-1]
            ranks, scores = index.nearest(terms, w)
            assert np.allclose(scores, [s for s, _ in every[: len(scores)]])
    out = {r["doc_id"]: r for r in toxicity.score(df, index).collect()}
    assert all(out[k]["predicted"] == int(k % 5 == 0) for k in range(200, 300)) and all(out[300 + k]["predicted"] == 0 for k in range(len(ODD)))
    assert {r["score"] for r in toxicity.score(df, toxicity.fit(df, labels.limit(0))).collect()} == {0.0}


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline as P

    copy = " ".join(f"{R.choice(['the', 'of', 'and'])} q{j}x" for j in range(80))
    texts = [*ODD, *[" ".join(f"{R.choice(['the', 'of', 'and'])} k{k}x{j}" for j in range(80)) for k in range(30)], copy, copy]
    frame(spark, texts).drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == P.COLUMNS, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    kept = {r["doc_id"] for r in docs.collect()}
    first = len(ODD) + 30
    assert set(range(len(ODD), first)) <= kept and first in kept and first + 1 not in kept and not kept & {0, 1, 2, 3}
    assert {r["doc_id"] for r in P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == kept
