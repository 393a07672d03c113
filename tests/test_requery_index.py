"""Words for a better question out of the index: no text of the corpus is cut again."""

import random

from pyspark.sql import functions as F

from loomery.operators import keyword, postings, ranking


def test_words_of_the_index_are_those_of_the_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    said = lambda n: " ".join(f"word{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdfghjklmnop')}" for _ in range(n))
    rows = [("c" if k % 3 else "d", k, f"note-{said(1)}-{k}", f"f{k // 2}", said(6), [said(2)], said(30)) for k in range(60)]
    docs = spark.createDataFrame(rows, "corpus string, doc_ord long, name string, file string, description string, headings array<string>, body string")
    queries = spark.createDataFrame([(q, said(3)) for q in range(5)], "query_id long, query string")
    weak = spark.createDataFrame([(q, "c" if k % 3 else "d", k, 1 + n) for q in range(5) for n, k in enumerate(rng.sample(range(60), 4))], "query_id long, corpus string, doc_ord long, rank int")
    plain = lambda d: sorted((r["query_id"], r["corpus"], r["term"], round(r["weight"], 9), r["pos"]) for r in d.collect())
    want = plain(ranking.requery_terms(weak, docs, queries))
    index = postings.build(docs, str(tmp_path / "index"))

    def cut(*_):
        raise AssertionError("texts are tokenised again")

    monkeypatch.setattr(keyword, "field_tokens", cut)
    got = ranking.requery_terms(weak, None, queries, index=index)
    assert len(want) > 20 and plain(got) == want
    # an update moves the frequencies, and with them the words
    index = postings.build(docs.where("doc_ord >= 20").withColumn("body", F.concat("body", F.lit(" wordak"))), str(tmp_path / "index"))
    assert plain(ranking.requery_terms(weak.where("doc_ord >= 20"), None, queries, index=index)) != want
