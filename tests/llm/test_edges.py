"""Edge cases of the operators: repeats, ties, damage, empty tables, clashing names, and models against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomery.llm import ann, langid, packing, quality, substring, toxicity, warc, wordvec as V
from loomery.llm.queries import vocabulary

R = random.Random(8)


def words(n, pool="river stone light walks under green sky the of and", seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(pool.split()) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_in", F.lit("x")).withColumn("__text", F.lit("y")).withColumn("score", F.lit("z"))


def test_conv_forward_is_the_sum_written_out():
    net = langid.ByteConv(["a", "b", "c"])
    b = np.frombuffer(bytes(range(65, 91)) * 10, np.uint8)[None, : langid.WINDOW].repeat(2, axis=0).copy()
    b[1, 100:] = 0
    got = net.forward(b)
    for row, probs in zip(b, got):
        x = net.p["e"][row]
        pooled = [max(float((x[i : i + w].reshape(-1) * net.p[f"w{w}"][:, f]).sum()) for i in range(langid.WINDOW - w + 1)) + float(net.p[f"c{w}"][f]) for w in langid.WIDTHS for f in range(langid.FILTERS)]
        z = np.maximum(pooled, 0) @ net.p["o"] + net.p["b"]
        e = np.exp(z - z.max())
        assert np.allclose(probs, e / e.sum(), atol=1e-4)


def test_language_learns_from_late_windows_and_passes_columns(spark):
    rows = [(i, words(400, "der und nicht ein haus") if i % 2 else words(400, "the and not one house"), ["en", "de"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows + [(3, None, "de"), (None, "the and", "en"), (5, words(20, "the and one"), None)], "doc_id long, text string, lang string").withColumn("__text", F.lit("y")).withColumn("text_in", F.lit("x"))
    net = langid.fit(df)
    got = langid.predict(df, net).collect()
    assert len(got) == 43 and {r["lang_pred"] for r in got if r["text"] is None} == {"und"}
    assert all(r["lang_pred"] == r["lang"] for r in got if r["text"] and r["lang"]) and all(r["__text"] == "y" and r["text_in"] == "x" for r in got)
    assert langid.predict(df.limit(0), net).count() == 0 and langid.fit(df.limit(0)) is None


def test_neighbours_with_hot_ids_ties_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 8))
    x[50:60] = x[49]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, (x[7] + 0.001 * k).tolist()) for k in range(100)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [None] * 8), (None, x[0].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect()
    best = {}
    for i, v in rows[:400]:
        for q in range(0, 300, 20):
            if i != q:
                s = float((np.array(v) * x[q]).sum())
                best[q, i] = max(best.get((q, i), -9e9), s)
    hits = 0
    for q in range(0, 300, 20):
        own = [g for g in got if g["query_id"] == q]
        assert [g["rank"] for g in sorted(own, key=lambda g: g["rank"])] == list(range(1, 21)) and len({g["vec_id"] for g in own}) == 20
        want = sorted(((-s, i) for (a, i), s in best.items() if a == q))[:20]
        hits += len({i for _, i in want} & {g["vec_id"] for g in own})
        assert all(abs(best[q, g["vec_id"]] - g["score"]) < 1e-9 for g in own)
        order = sorted(own, key=lambda g: g["rank"])
        assert order == sorted(order, key=lambda g: (-g["score"], g["vec_id"]))
    assert hits >= 0.9 * 15 * 20
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0
    assert {g["vec_id"] for g in ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()} == {1, 2}


def test_quality_verdict_by_brute_force(spark):
    good = [words(80, seed=k) for k in range(30)]
    odd = ["xq " * 60 + "zz#" * 20, " ".join(f"{k}{k * 7}%%" for k in range(90))]
    df = frame(spark, [(k, t) for k, t in enumerate(good + odd + [None, "", "a b"])]).withColumn("lang", F.lit("en"))
    refs = quality.fit(df)
    got = {r["doc_id"]: r for r in quality.judge(df, refs).collect()}
    names = [c for c in quality.judge(df, refs).columns if c not in df.columns]
    class_col, word_col = names[-3], names[-2]
    for r in got.values():
        far = r[class_col] > quality.MAX_CLASS or r[word_col] > quality.MAX_WORDS or r[class_col] + r[word_col] > quality.MAX_SUM
        assert r["kept"] == (not r["base_failed"] and not (r["n_words"] >= quality.MIN_WORDS and far))
        assert r["__text"] == "y"
    assert not got[32]["kept"] and not got[33]["kept"] and not got[34]["kept"] and sum(got[k]["kept"] for k in range(30)) == sum(not got[k]["base_failed"] for k in range(30))


def test_packing_digests_nulls_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [(1, words(900, seed=1)), (1, words(900, seed=1)), (1, words(700, seed=2)), (None, words(50, seed=3)), (None, None), (2, ""), (3, words(2500, seed=4))]
    out = packing.pack(packing.encoded(frame(spark, rows), vocabulary("byte_bpe_50k.json")), digests=True).collect()
    seen, want = Counter(), Counter()
    for r in out:
        assert r["length"] > 0 and r["offset"] + r["length"] <= 1024
        seen[r["doc_id"], r["doc_tokens"]] += r["length"]
    for i, t in rows:
        n = len(tk.encode(t or "", add_special_tokens=False).ids) + 1
        want[i, n] += n
    assert seen == want
    ids = [*tk.encode(rows[6][1], add_special_tokens=False).ids, 0]
    for r in out:
        if r["doc_id"] == 3:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n


def test_factors_stop_at_the_first_word_that_differs():
    own = b" ".join(b"w%d" % k for k in range(120))
    passage = " ".join(f"w{k}" if k != 70 else "other" for k in range(100))
    found = [{"start": 0, "words": 100, "passage": passage}]
    n, gone, kept = substring.kept_words(own, found)
    assert (n, gone) == (120, 70) and kept.split()[0] == b"w70"
    found[0]["passage"] = passage.replace("w20", "x20")
    assert substring.kept_words(own, found)[1] == 0


def test_substring_with_null_and_repeated_ids(spark):
    shared = words(60, seed=9)
    rows = [(1, shared + " one"), (1, "start " + shared), (2, "a b " + shared + " c"), (None, shared), (3, None), (4, ""), (5, words(30, seed=3))]
    got = substring.remove_repeats(frame(spark, rows), digests=True).collect()
    removed = Counter((r["doc_id"], r["n_removed"]) for r in got)
    assert removed == Counter({(1, 0): 2, (2, 60): 1, (None, 0): 1, (3, 0): 1, (4, 0): 1, (5, 0): 1})
    assert substring.remove_repeats(frame(spark, []), digests=True).count() == 0


def test_archives_of_repeated_ids_keep_every_payload(spark, tmp_path):
    rows = [(1, "u", "A"), (1, "u", "UNIQUE B"), (5, "u", "A"), (None, "u", "A"), (7, None, None), (8, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha", F.lit(2))
    warc.write(df, str(tmp_path / "w"))
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in warc.read(spark, str(tmp_path / "w")).collect())
    assert got == Counter({(1, "revisit", 5, None): 1, (1, "response", None, b"UNIQUE B"): 1, (5, "response", None, b"A"): 1, (None, "revisit", 5, None): 1, (7, "revisit", 8, None): 1, (8, "response", None, b""): 1})


def test_a_shortened_archive_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", f"page {k}") for k in range(3)], "page_id long, url string, html string")
    file = warc.write(df, str(tmp_path / "w")).first()["file"]
    raw = (tmp_path / "w" / file).read_bytes()
    cut = raw.rindex(b"\x1f\x8b\x08")
    (tmp_path / "w" / file).write_bytes(raw[:cut])
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read(spark, str(tmp_path / "w")).collect()


def test_toxic_votes_are_exact_nearest_neighbours(spark):
    pool = "river stone light walks under green sky owl tree moss fern lake hill".split()
    rows = [(i, " ".join(R.choice(pool + (["vile", "scum"] if i % 4 == 0 else [])) for _ in range(R.randint(4, 40)))) for i in range(160)]
    docs = frame(spark, rows + [(200, None), (201, ""), (202, "unheard zzz")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    for _, text in rows[100:]:
        h, first = toxicity.terms_of(*V.flat(pa.array([text])))
        terms, counts = next(toxicity.known(index.vocab, h, first))
        terms, w = index.vector(terms, counts)
        dots = np.zeros(len(index.ids))
        for t, x in zip(terms, w):
            at = slice(index.start[t], index.start[t + 1])
            dots[index.doc[at]] += x * index.value[at]
        dots = np.round(dots, 12)
        order = [k for k in np.lexsort((index.ids, -dots))[: toxicity.K] if dots[k] > 0]
        ranks, scores = index.nearest(terms, w)
        assert ranks.tolist() == order and np.allclose(scores, dots[order])
    got = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and len(got) == 163
    assert got[200]["evidence"] == [] and got[200]["score"] == got[201]["score"] == got[202]["score"]
    late = [got[i]["score"] for i in range(120, 160)]
    assert np.mean([s for i, s in zip(range(120, 160), late) if i % 4 == 0]) > np.mean([s for i, s in zip(range(120, 160), late) if i % 4])
    assert len({round(s, 6) for s in late}) > 2
    assert toxicity.fit(docs, labels.limit(0)) is None and {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_near_dedup_keeps_texts_of_one_id(spark):
    from loomery.llm import alike

    a, b = words(60, seed=1), words(60, "fox hen cow pig cat dog emu yak ant bee", seed=2)
    rows = [(1, a), (1, b), (1, b), (2, a), (None, a), (3, b + " end")]
    got = Counter((r["doc_id"], r["text"]) for r in alike.keep_one(frame(spark, rows)).collect())
    assert got == Counter({(1, a): 1, (1, b): 1, (None, a): 1})


def test_pipeline_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert math.isclose(corpus_pipeline.LEAST_LANG_SCORE, 0.4)
