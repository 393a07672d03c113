"""Documents that hold a term, against plain searching; no text is searched once a term."""

import re

from pyspark.sql import functions as F

from loomery.operators import state

TEXTS = ["alpha beta-gamma _alpha_ x.alpha.y", "ALPHA9 alphabet étaalpha alpha_b", None, "v1.2-rc v1.2 beta gamma", "beta_x betabeta -beta-", "alphaé betaİalpha"]
TERMS = ["alpha", "beta", "v1.2", "beta-gamma", "a.y", "never", "gamma", "alpha beta", "é", "9"]


def test_frequencies_are_those_of_plain_searching(spark, monkeypatch):
    monkeypatch.setattr(state, "KNOWN_RUNS", 3)
    docs = spark.createDataFrame([("c", k, f"n{k}", "about beta" if k == 2 else "", t) for k, t in enumerate(TEXTS)], "corpus string, doc_ord long, name string, description string, body string")
    hay = [r["h"] for r in docs.select(state.haystack().alias("h")).collect()]
    want = {t: (sum(t in h for h in hay), sum(bool(re.search(rf"(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])", h)) for h in hay)) for t in TERMS}
    terms = spark.createDataFrame([(t,) for t in [*TERMS, "beta"]], "term string")
    got = {r["term"]: (r["df"], r["df_word"]) for r in state.term_frequencies(terms, docs).collect()}
    assert got == want


def test_a_run_is_looked_through_once(spark):
    docs = spark.createDataFrame([("c", k, "n", "", "same words here") for k in range(500)], "corpus string, doc_ord long, name string, description string, body string").coalesce(1)
    rows = state.term_frequencies(spark.createDataFrame([("same",), ("here",)], "term string"), docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "hits" not in plan  # no row a term and document
    assert {tuple(r) for r in rows.select(F.col("term"), "df", "df_word").collect()} == {("same", 500, 500), ("here", 500, 500)}
