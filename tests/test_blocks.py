"""Index and scores by blocks of documents: what a plain count gives, and no pair of a query and a document in a shuffle."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import keyword, postings, ranking

ODD = ["", None, " \n a", "one two  three\t", "İx Kelvin K. ÀÉ x-y/z.w+q --a-b-- c++ 1.2.3 ..", "classes dishes running ted boxes glass flies ties ies-ing `code`*a*_b_~c>#d|e", "foo\x0b bar\nbaz\n"]


def corpus(spark, n=300):
    r = random.Random(3)
    word = lambda: f"w{min(r.randrange(60), r.randrange(60))}"
    rows = [("c", k, f"f{k}", f"a-b_{k}", " ".join(word() for _ in range(3)), ODD[k] if k < len(ODD) else " ".join(word() for _ in range(r.choice([3, 20, 60]))), ["x", None, "y"][k % 3], k % 2 == 0) for k in range(n)]
    docs = spark.createDataFrame(rows, "corpus string, doc_ord long, file string, name string, description string, body string, kind string, even boolean")
    asks = spark.createDataFrame([(q, " ".join(word() for _ in range(6))) for q in range(9)], "query_id long, query string")
    return docs, asks


def plain(queries, p):
    """Scores by a join of all pairs."""
    hits = keyword._parts(p.posts.join(p.weights, ["corpus", "term"]).join(p.stats, "corpus"), keyword.CONFIG)
    return {(x["query_id"], x["doc_ord"]): x["raw"] for x in hits.join(p.terms, "term").groupBy("query_id", "doc_ord").agg(F.sum("part").alias("raw")).collect()}


def test_terms_are_counted_as_the_columns_cut_them(spark, monkeypatch):
    monkeypatch.setattr(keyword, "TEXT_BYTES", 40)
    docs, _ = corpus(spark, 40)
    docs = docs.withColumn("headings", F.array("description", "name"))
    tokens = keyword.field_tokens(docs)
    want = sorted(map(tuple, keyword.postings(tokens).select("doc_ord", "term", "tf_title", "tf_head", "tf_body").collect()))
    hits = keyword.term_counts(docs, []).select("doc_ord", "n_name", "n_body", F.explode("hits").alias("x")).select("doc_ord", "n_name", "n_body", "x.*")
    got = sorted((r["doc_ord"], r["term"], round(3.0 * r["tf_name"] + 2.0 * r["tf_description"], 6), round(1.5 * r["tf_headings"] + 2.5 * r["tf_facts"], 6), round(0.3 * r["tf_body"], 6)) for r in hits.collect())
    assert got == [(a, b, round(c, 6), round(d, 6), round(e, 6)) for a, b, c, d, e in want]
    sizes = {r["doc_ord"]: (r["a"], r["b"]) for r in tokens.select("doc_ord", F.size("in_name").alias("a"), F.size("in_body").alias("b")).collect()}
    assert all(sizes[r["doc_ord"]] == (r["n_name"], r["n_body"]) for r in hits.collect())


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    plans, write = {}, postings._write
    monkeypatch.setattr(postings, "_write", lambda rows, path, table, *a: plans.update({table: rows._jdf.queryExecution().optimizedPlan().toString()}) or write(rows, path, table, *a))
    docs, _ = corpus(spark, 30)
    postings.build(docs, str(tmp_path / "ix"))
    assert "Aggregate" not in plans["postings"] and "distinct" not in plans["terms"].lower()


def test_first_words_and_counts(spark):
    d = spark.createDataFrame([(t,) for t in [*ODD, "a " * 30, "x" * 5000]], "t string")
    for n in (1, 3, 12):
        assert d.where(~T.first_words(F.col("t"), n).eqNullSafe(F.array_join(F.slice(T.words(F.col("t")), 1, n), " "))).count() == 0
    assert d.where(T.word_count(F.col("t")) != F.size(T.words(F.col("t")))).count() == 0
    assert "filter" not in d.select(T.word_count(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pairs_are_added_up_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(keyword, "BLOCK_HITS", 700)
    docs, asks = corpus(spark)
    p = keyword.prepare(asks, docs)
    want, found = plain(asks, p), keyword.bm25f(asks, docs, prepared=p)
    got = {(x["query_id"], x["doc_ord"]): x["raw"] for x in found.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("FlatMapGroupsInArrow") >= 0 and "Aggregate [query_id" not in tree
    some = {k: v for k, v in got.items() if k[1] % 3 == 0}
    assert {(x["query_id"], x["doc_ord"]): x["raw"] for x in keyword.bm25f(asks, docs, prepared=p, only=docs.where("doc_ord % 3 = 0")).collect()}.keys() == some.keys()


def test_best_of_each_label(spark, monkeypatch):
    monkeypatch.setattr(keyword, "BLOCK_HITS", 700)
    docs, asks = corpus(spark)
    p = keyword.prepare(asks, docs)
    for label in ("kind", "even"):
        of = {r["doc_ord"]: r[label] for r in docs.collect()}
        want = {}
        for (q, d), raw in plain(asks, p).items():
            want.setdefault((q, of[d]), []).append((-round(raw, 6), d))
        got = {}
        for x in keyword.best(p, 2, only=docs, label=label).collect():
            assert x[label] == of[x["doc_ord"]]
            got.setdefault((x["query_id"], x[label]), []).append((-round(x["raw"], 6), x["doc_ord"]))
        assert {k: sorted(v)[:2] for k, v in got.items()} == {k: sorted(v)[:2] for k, v in want.items()}
        assert sum(map(len, got.values())) < sum(map(len, want.values())) / 3


def test_lending_sorts_few_rows(spark):
    r = random.Random(1)
    rows = [(q, "curated", d, round(r.random(), 2), 0.5) for q in range(3) for d in range(400)]
    scored = spark.createDataFrame(rows, "query_id long, corpus string, doc_ord long, score double, semantic_score double")
    edges = spark.createDataFrame([("curated", d, (d * 7 + 1) % 400) for d in range(400)], "corpus string, src long, dst long")
    links = {(a, b) for d in range(400) for a, b in ((d, (d * 7 + 1) % 400), ((d * 7 + 1) % 400, d)) if a != b}
    want = {}
    for q in range(3):
        own = {d: s for k, _, d, s, _ in rows if k == q}
        lent = {d: own[d] for d in sorted(own, key=lambda d: (-own[d], d))[:10]}
        want |= {(q, d): round(own[d] + 0.1 * sum(v for x, v in lent.items() if (x, d) in links), 4) for d in own}
    got = {(x["query_id"], x["doc_ord"]): x["score"] for x in ranking.graph_spread(scored, edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)


def test_filtered_rows_are_scaled_by_the_best_of_all(spark):
    docs, asks = corpus(spark)
    docs = docs.selectExpr("*", "'hot' AS tier", "false AS in_memory_index", "timestamp'2024-01-01' AS modified")
    p = keyword.prepare(asks, docs)
    want, top = plain(asks, p), {}
    for (q, _), raw in want.items():
        top[q] = max(top.get(q, 0), raw)
    rows, _ = ranking.candidates(asks, docs, filters=F.col("even"), prepared=p, most=30)
    got = {(x["query_id"], x["doc_ord"]): x["keyword_score"] for x in rows.collect()}
    first = lambda q: [d for d in sorted((d for k, d in want if k == q and d % 2 == 0), key=lambda d: (-round(want[q, d] / top[q], 9), d))][:30]
    assert all((q, d) in got and abs(got[q, d] - want[q, d] / top[q]) < 1e-9 for q in top for d in first(q)) and all(d % 2 == 0 for _, d in got)
    every = ranking.search(asks, docs, datetime(2024, 7, 1), filters=F.col("even"))[0]
    assert every.where("doc_ord % 2 = 1").count() == 0 and every.select("query_id").distinct().count() == len(top)
    some = docs.where("doc_ord < 50").select("corpus", "doc_ord")
    few = {(x["query_id"], x["doc_ord"]): x["base"] for x in ranking.candidates(asks, docs, prepared=p, only=some)[0].collect()}
    assert few.keys() == {k for k in want if k[1] < 50} and all(abs(few[k] - want[k] / top[k[0]]) < 1e-9 for k in few)
