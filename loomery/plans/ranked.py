"""Registered ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomery.config import CONFIG, STOP_WORDS
from loomery.functions import scoring as S, text as T
from loomery.operators import dense, keyword, querylog, ranking
from loomery.operators.phrase import phrase_window
from loomery.sources import shared

from . import adapters as A, sqltext as X

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id AS doc_ord, term, count(*) AS tf FROM (SELECT doc_id, unnest({X.tokens('text')}) AS term FROM documents) GROUP BY 1, 2")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    """T01-T03"""
    return A.table(spark, sf, "documents").select(F.col("doc_id").alias("doc_ord"), F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("doc_ord", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(f"WITH {X.POSTINGS} SELECT term, df, round(idf, 4) AS idf FROM idf")
def idf_table(spark: SparkSession, sf: str) -> DataFrame:
    """A01, A03, A04"""
    tokens = keyword.field_tokens(A.docs(spark, sf))
    stats = keyword.corpus_stats(keyword.lengths(tokens))
    return keyword.document_frequency(keyword.postings(tokens), stats).select("term", "df", F.round("idf", 4).alias("idf"))


@query(f"WITH {X.POSTINGS} SELECT nd AS n_docs, round(mt, 4) AS avg_title, 1.0 AS avg_head, round(mb, 4) AS avg_body FROM stats")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A02, D08"""
    s = keyword.corpus_stats(keyword.lengths(keyword.field_tokens(A.docs(spark, sf))))
    return s.select("n_docs", *[F.round(c, 4).alias(c) for c in ("avg_title", "avg_head", "avg_body")])


@query(f"""WITH {X.RAW}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_ord) AS rank FROM raw)
SELECT query_id, rank, doc_ord, round(raw, 4) AS raw FROM r WHERE rank <= 8""")
def bm25f_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A05, J01, J02, R02 in keyword mode: the eight best documents of every benchmark passage."""
    q = A.questions(spark, sf)
    raw = keyword.best(A.index(spark, sf).prepare(q), CONFIG.limit)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 6)), "doc_ord")
    return raw.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= CONFIG.limit).select("query_id", "rank", "doc_ord", F.round("raw", 4).alias("raw"))


@query(f"""WITH {X.RAW}, r AS (SELECT query_id, doc_ord, raw / max(raw) OVER (PARTITION BY query_id) AS score, raw FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_ord) AS rank FROM r)
SELECT query_id, rank, doc_ord, round(score, 4) AS score FROM k WHERE rank <= 8""")
def normalised_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword scores over each query's best."""
    q = A.questions(spark, sf)
    raw = keyword.best(A.index(spark, sf).prepare(q), CONFIG.limit)
    rows = raw.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_ord")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= CONFIG.limit).select("query_id", "rank", "doc_ord", F.round("score", 4).alias("score"))


_STATS = f"""WITH {X.POSTINGS}, {X.QUERY_TERMS},
t AS (SELECT query_id, q.term, i.df, 2.2 * ln(1 + (nd - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS gain FROM qterms q LEFT JOIN idf i USING (term), stats),
o AS (SELECT a.query_id, a.term, a.gain FROM t a WHERE a.df IS NULL AND NOT EXISTS (SELECT 1 FROM t p WHERE p.query_id = a.query_id AND p.df IS NOT NULL AND (contains(a.term, p.term) OR contains(p.term, a.term)))),
s AS (SELECT query_id, coalesce(sum(gain) FILTER (df IS NOT NULL), 0) AS ideal, sum(gain) AS ideal_full, count(*) AS n_terms, count(df) AS n_present FROM t GROUP BY 1),
l AS (SELECT query_id, sum(gain) AS lost, array_to_string(list_sort(list(term)), ' ') AS orphans FROM o GROUP BY 1),
stats2 AS (SELECT s.*, coalesce(l.orphans, '') AS orphans, coalesce(l.lost, 0) / ideal_full AS orphan_share FROM s LEFT JOIN l USING (query_id))"""


@query(f"{_STATS} SELECT query_id, round(ideal, 4) AS ideal, round(ideal_full, 4) AS ideal_full, n_terms, n_present, orphans, round(orphan_share, 4) AS orphan_share FROM stats2")
def term_stats_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """A06"""
    q = A.questions(spark, sf)
    s = keyword.term_stats(q, None, prepared=A.index(spark, sf).prepare(q))
    return s.select("query_id", F.round("ideal", 4).alias("ideal"), F.round("ideal_full", 4).alias("ideal_full"), "n_terms", "n_present", F.array_join("orphans", " ").alias("orphans"), F.round("orphan_share", 4).alias("orphan_share"))


@query(f"""{_STATS}, raw AS (SELECT query_id, doc_ord, sum(idf * w * 2.2 / (1.2 + w)) AS raw FROM (
 SELECT q.query_id, p.doc_ord, i.idf, tft / (0.25 + 0.75 * lt / mt) + tfb / (0.25 + 0.75 * lb / mb) AS w FROM qterms q JOIN post p USING (term) JOIN idf i USING (term) JOIN lens USING (doc_ord), stats) GROUP BY 1, 2),
m AS (SELECT query_id, doc_ord, raw, ideal, greatest(0, least(1, (raw - least(8.0, 0.6 * ideal)) / (least(20.0, 0.85 * ideal) - least(8.0, 0.6 * ideal)))) AS size FROM raw JOIN stats2 USING (query_id))
SELECT query_id, doc_ord, round(size * greatest(0, least(1, raw / ideal / 0.6)), 4) AS keyword_score FROM m WHERE size > 1e-9""")
def absolute_keyword(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword scores on the absolute scale; documents at or below its floor are dropped."""
    q, d = A.questions(spark, sf), None
    p = A.index(spark, sf).prepare(q)
    rows = keyword.bm25f(q, d, prepared=p).join(keyword.term_stats(q, d, prepared=p).select("query_id", "corpus", "ideal"), ["query_id", "corpus"])
    return _on_scale(rows)


def _on_scale(rows: DataFrame) -> DataFrame:
    """Rows whose magnitude is above the floor; what coverage makes of it may round to nothing."""
    above = rows.where(S.keyword_size(F.col("raw"), F.col("ideal")) > 1e-9)
    return above.select("query_id", "doc_ord", F.round(S.absolute_keyword(F.col("raw"), F.col("ideal")), 4).alias("keyword_score"))


@query(f"""{_STATS}, raw AS (SELECT query_id, doc_ord, sum(idf * w * 2.2 / (1.2 + w)) AS raw FROM (
 SELECT q.query_id, p.doc_ord, i.idf, tft / (0.25 + 0.75 * lt / mt) + tfb / (0.25 + 0.75 * lb / mb) AS w FROM qterms q JOIN post p USING (term) JOIN idf i USING (term) JOIN lens USING (doc_ord), stats) GROUP BY 1, 2),
b AS (SELECT query_id, max(raw) AS best FROM raw GROUP BY 1),
v AS (SELECT query_id, best / ideal_full AS cov, orphan_share AS os, best / ideal AS top FROM stats2 JOIN b USING (query_id)),
w AS (SELECT *, 0.5 * least(1, cov / 0.2) AS ph FROM v)
SELECT query_id, round(cov, 4) AS lexical_coverage, round(ph, 4) AS effective_phrase,
 CASE WHEN os >= 0.4 AND ph < 0.4 THEN 'vocabulary' WHEN top < 0.38 AND ph < 0.4 AND cov < 0.2 THEN 'evidence' END AS route,
 CASE WHEN (os >= 0.4 AND ph < 0.4) OR (top < 0.38 AND ph < 0.4 AND cov < 0.2) THEN 'low' WHEN top >= 0.38 THEN 'high' ELSE 'medium' END AS confidence FROM w""")
def absence_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The refusal arithmetic, on the keyword evidence and a fixed phrase of 0.5."""
    q, d = A.questions(spark, sf), None
    p = A.index(spark, sf).prepare(q)
    best = keyword.best(p, 1).groupBy("query_id", "corpus").agg(F.max("raw").alias("best_raw"))
    rows = keyword.term_stats(q, d, prepared=p).join(best, ["query_id", "corpus"]).withColumn("mode", F.lit("hybrid")).withColumn("top_phrase", F.lit(0.5)).withColumn("top_score", F.col("best_raw") / F.col("ideal"))
    return ranking.verdict(rows).select("query_id", F.round("lexical_coverage", 4).alias("lexical_coverage"), F.round("effective_phrase", 4).alias("effective_phrase"), "route", "confidence")


@query(f"WITH {X.DOCS}, c AS (SELECT doc_ord, len({X.words('body')}) AS n FROM docs) SELECT doc_ord, least(200, t)::BIGINT AS n_chunks, t::BIGINT AS total, t > 200 AS truncated FROM (SELECT doc_ord, CASE WHEN n = 0 THEN 0 WHEN n <= 200 THEN 1 ELSE ceil((n - 200) / 160.0) + 1 END AS t FROM c)")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each document, how many there would be without the cap, and whether it cut."""
    total = T.chunk_total(F.size(T.words(F.col("body"))))
    return A.plain_docs(spark, sf).select("doc_ord", F.least(total, F.lit(CONFIG.chunk_cap)).cast("long").alias("n_chunks"), total.alias("total"), (total > CONFIG.chunk_cap).alias("truncated"))


@query(f"""WITH w AS (SELECT doc_id, {X.words('text')} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, (CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1 ELSE ceil((len(w) - 200) / 160.0) + 1 END)::BIGINT)) AS ix FROM w)
SELECT doc_id AS doc_ord, ix AS chunk_ix, md5(array_to_string(w[ix * 160 + 1 : ix * 160 + 200], ' ')) AS chunk FROM c""")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk, by digest."""
    return A.table(spark, sf, "documents").select(F.col("doc_id").alias("doc_ord"), F.posexplode(T.chunks(F.col("text"), cap=None)).alias("chunk_ix", "c")).select("doc_ord", "chunk_ix", F.md5("c").alias("chunk"))


@query(f"SELECT doc_id AS doc_ord, md5(array_to_string({X.words('text')}, ' ')) AS body FROM documents")
def unchunk_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks put together again are the text with single spaces."""
    return A.table(spark, sf, "documents").select(F.col("doc_id").alias("doc_ord"), F.md5(T.unchunk(T.chunks(F.col("text"), cap=None))).alias("body"))


@query(f"""WITH {X.DOCS}, c AS (SELECT least(200, CASE WHEN len({X.words('body')}) = 0 THEN 0 WHEN len({X.words('body')}) <= 200 THEN 1 ELSE ceil((len({X.words('body')}) - 200) / 160.0) + 1 END)::BIGINT AS n FROM docs),
s AS (SELECT list_sort(list(n)) AS a FROM c) SELECT 'curated' AS corpus, greatest(1, a[floor(0.9 * (len(a) - 1))::BIGINT + 1]) AS reference FROM s""")
def ref_chunks_p90(spark: SparkSession, sf: str) -> DataFrame:
    """A08"""
    return ranking.reference_chunks(A.plain_docs(spark, sf).select("corpus", F.size(T.chunks(F.col("body"))).alias("n_chunks")))


@query(f"""WITH {X.DOCS} SELECT doc_ord, round((CASE WHEN tier = 'archive' THEN 1.0 ELSE 1.15 END) * (0.85 + 0.15 * exp(-greatest(0, (1719792000000 - epoch_ms(modified)) / 86400000.0) / 180)), 6) AS envelope,
 round(0.85 + 0.15 * pow(0.5, abs(1706745600000 - epoch_ms(modified)) / 86400000.0 / 180), 6) AS near FROM docs""")
def recency_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Tier, recency and nearness factors."""
    from datetime import datetime

    d = A.docs(spark, sf)
    return d.select("doc_ord", F.round(S.tier_boost(F.col("tier"), F.col("in_memory_index")) * S.recency_factor(F.col("modified"), A.AS_OF), 6).alias("envelope"), F.round(S.near_factor(F.col("modified"), F.lit(datetime(2024, 2, 1))), 6).alias("near"))


_DOT = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) SELECT query_id, rank, id, round(score, 4) AS score FROM r WHERE rank <= 8""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The eight nearest vectors of every vector whose id is divisible by 100."""
    e = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense.top_k(e.where("id % 100 = 0"), e, 8).withColumn("score", F.round("score", 4))


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p WHERE score > 0) SELECT query_id, rank, id, round(score, 4) AS score FROM r WHERE rank <= 3""")
def neighbors3(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest others of every vector, in blocks."""
    e = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense.top_k(e, e, 3, exclude_same=True, above=0.0).withColumn("score", F.round("score", 4))


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.label AS doc, b.vec_id AS ix, {_DOT} AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT query_id, doc, round(max(cos), 4) AS best, arg_min(ix, (-cos, ix)) AS chunk, round(greatest(0, least(1, (max(cos) - 0.4) / 0.3)), 4) AS semantic_score FROM p GROUP BY 1, 2""")
def dense_max_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    """Each label as a document of chunks, its best chunk and the rescaled cosine."""
    e = A.table(spark, sf, "embeddings")
    rows = dense.best_by_document(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.select(F.col("label").alias("doc"), F.col("vec_id").alias("chunk_ix"), F.col("embedding").alias("vec")))
    return rows.select("query_id", "doc", F.round("best", 4).alias("best"), "chunk", F.round(S.rescale_cosine(F.col("best")), 4).alias("semantic_score"))


_SLOTS = f"""WITH {X.RAW}, j AS (SELECT r.query_id, r.doc_ord, r.raw, d.tier, d.project FROM raw r JOIN docs d USING (doc_ord))"""


@query(f"""{_SLOTS}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY round(raw, 6) DESC, doc_ord) AS slot FROM j)
SELECT query_id, doc_ord, project, round(raw, 4) AS score FROM s WHERE slot <= 2""")
def slot_cap(spark: SparkSession, sf: str) -> DataFrame:
    """At most two rows a file, the source standing for the file."""
    q, index = A.questions(spark, sf), A.index(spark, sf)
    rows = keyword.best(index.prepare(q), 2, only=index.documents().select("corpus", "doc_ord", F.col("project").alias("file")), label="file").withColumn("score", F.round("raw", 6))
    return ranking.slot_cap(rows, 2).select("query_id", "doc_ord", F.col("file").alias("project"), F.round("raw", 4).alias("score"))


@query(f"""{_SLOTS}, a AS (SELECT *, sum((tier = 'archive')::INT) OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_ord ROWS UNBOUNDED PRECEDING) AS seen FROM j),
h AS (SELECT *, (tier = 'archive' AND seen > 4) AS held FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY held, round(raw, 6) DESC, doc_ord) AS rank FROM h)
SELECT query_id, rank, doc_ord, tier FROM r WHERE rank <= 8""")
def archive_share(spark: SparkSession, sf: str) -> DataFrame:
    """W05"""
    q, index = A.questions(spark, sf), A.index(spark, sf)
    # of no tier more rows than the limit can be shown
    rows = keyword.best(index.prepare(q), CONFIG.limit, only=index.documents(), label="tier").withColumn("score", F.round("raw", 6))
    return ranking.archive_cap(rows).select("query_id", "rank", "doc_ord", "tier")


@query(f"""WITH {X.RAW}, n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT query_id, doc_ord, round(raw / max(raw) OVER (PARTITION BY query_id), 3) AS score FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord) AS rank FROM r),
e AS (SELECT doc_id AS src, (doc_id * 7 + 1) % n AS dst FROM documents, n WHERE doc_id <> (doc_id * 7 + 1) % n),
b AS (SELECT DISTINCT * FROM (SELECT src AS donor, dst AS doc_ord FROM e UNION ALL SELECT dst, src FROM e)),
g AS (SELECT k.query_id, b.doc_ord, 0.1 * sum(k.score) AS gain FROM k JOIN b ON k.doc_ord = b.donor WHERE k.rank <= 10 GROUP BY 1, 2)
SELECT r.query_id, r.doc_ord, round(CASE WHEN r.score >= 0.2 AND gain > 0 THEN round(r.score + gain, 4) ELSE r.score END, 4) AS score FROM r LEFT JOIN g USING (query_id, doc_ord)""")
def graph_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Lending over a link graph made by rule; the scaled keyword score stands for the semantic one."""
    q = A.questions(spark, sf)
    raw = shared.written(keyword.bm25f(q, None, prepared=A.index(spark, sf).prepare(q)), "raw")
    best = raw.groupBy("query_id").agg(F.max("raw").alias("best"))  # a row a question
    rows = raw.join(keyword._bounded(best), "query_id").withColumn("score", F.round(F.col("raw") / F.col("best"), 3)).withColumn("semantic_score", F.col("score")).drop("best")
    return ranking.graph_spread(rows, A.edges(spark, sf)).select("query_id", "doc_ord", F.round("score", 4).alias("score"))


def _ranked(where: str = "true") -> str:
    """The keyword-mode ranking in SQL: scaled scores, the 30 best, envelope, archive share, limit."""
    return f"""WITH {X.RAW}, s AS (SELECT query_id, doc_ord, raw / max(raw) OVER (PARTITION BY query_id) AS kw FROM raw),
j AS (SELECT s.*, d.name, d.tier, (CASE WHEN tier = 'archive' THEN 1.0 ELSE 1.15 END) * (0.85 + 0.15 * exp(-greatest(0, (1719792000000 - epoch_ms(modified)) / 86400000.0) / 180)) AS env FROM s JOIN docs d USING (doc_ord) WHERE {where}),
p AS (SELECT *, kw * env AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(kw, 9) DESC, doc_ord) AS pass1 FROM j WHERE kw > 0),
a AS (SELECT *, sum((tier = 'archive')::INT) OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_ord ROWS UNBOUNDED PRECEDING) AS seen FROM p WHERE pass1 <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (tier = 'archive' AND seen > 4), round(score, 9) DESC, doc_ord) AS rank FROM a)
SELECT query_id, 'curated' AS corpus, rank, name, round(score, 4) AS score, round(kw, 4) AS keyword_score, tier, false AS weak FROM r WHERE rank <= 8"""


_SHOWN = ["query_id", "corpus", "rank", "name", "score", "keyword_score", "tier", "weak"]


@query(_ranked())
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole keyword-mode search."""
    rows, _ = ranking.search(A.questions(spark, sf), None, A.AS_OF, index=A.index(spark, sf))
    return rows.withColumn("keyword_score", F.round("keyword_score", 4)).select(*_SHOWN)


@query(_ranked("account IS NULL OR account = 'fr'"))
def filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of one account (or none) only, chosen before the best thirty are."""
    rows, _ = ranking.search(A.questions(spark, sf), None, A.AS_OF, filters=ranking.passes(accounts=["fr"]), index=A.index(spark, sf))
    return rows.withColumn("keyword_score", F.round("keyword_score", 4)).select(*_SHOWN)


@query()
def hybrid_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """R01-R04 in hybrid mode: vectors stand for passages of documents, all above the cosine floor."""
    q = A.questions(spark, sf)
    e = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asks = e.join(q.select(F.col("query_id").alias("id")), "id", "left_semi")
    near = dense.top_k(asks, e, None, above=CONFIG.cosine_floor).select("query_id", F.lit("curated").alias("corpus"), F.col("id").alias("doc_ord"), F.col("score").alias("cos"))
    _, verdicts = ranking.search(q, None, A.AS_OF, semantic=near, index=A.index(spark, sf))
    return verdicts.select("query_id", "corpus", F.round("top_score", 4).alias("top_score"), F.round("top_phrase", 4).alias("top_phrase"), F.round("effective_phrase", 4).alias("effective_phrase"), F.round("lexical_coverage", 4).alias("lexical_coverage"), F.round("orphan_share", 4).alias("orphan_share"), "route", "confidence", "no_strong_match", "read_this_first")


@query()
def phrase_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's tightest window of the words of its own description (tests hold single windows)."""
    d = A.plain_docs(spark, sf)
    return d.select("doc_ord", phrase_window(F.col("body"), F.array_distinct(T.tokenize(F.col("description")))).alias("w")).select("doc_ord", F.round("w.phrase", 6).alias("phrase"), "w.first", "w.stop")


_SAID = "list_filter(list_transform(regexp_extract_all(lower(coalesce({}, '')), '[a-z][a-z0-9][a-z0-9.+/-]*'), lambda t: regexp_replace(t, '^[.\\-/+]+|[.\\-/+]+$', '', 'g')), lambda t: true)"
_STOPS = ", ".join(f"'{s}'" for s in STOP_WORDS)


@query(f"""WITH {X.RAW}, near AS (SELECT * FROM (SELECT query_id, doc_ord, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_ord) AS rank FROM raw) WHERE rank <= 3),
said AS (SELECT doc_ord, unnest(l) AS surface, generate_subscripts(l, 1) AS place, 3.0 AS w FROM (SELECT doc_ord, {_SAID.format("replace(replace(name, '-', ' '), '_', ' ')")} AS l FROM docs) UNION ALL SELECT doc_ord, unnest(l), 1000 + generate_subscripts(l, 1), 1.0 FROM (SELECT doc_ord, {_SAID.format('description')} AS l FROM docs)),
good AS (SELECT query_id, rank, place, w, surface, {X.stem('surface')} AS term FROM near JOIN said USING (doc_ord) WHERE length(surface) >= 3 AND surface NOT IN ({_STOPS}) AND NOT regexp_matches(surface, '[/]|\\.(md|json|js|mjs|txt)$|^[0-9a-f]{{7,}}$|^v\\d') AND NOT (regexp_matches(surface, '[0-9]') AND length(surface) >= 5)),
labels AS (SELECT term, count(*) AS labels FROM (SELECT DISTINCT doc_ord, unnest({X.tokens("replace(replace(name, '-', ' '), '_', ' ')")}) AS term FROM docs) GROUP BY 1),
g AS (SELECT query_id, term, sum(w * idf / (1 + 0.5 * (rank - 1))) AS weight, arg_min(surface, (rank, place)) AS surface FROM good JOIN idf USING (term) LEFT JOIN labels USING (term), stats
 WHERE idf >= ln(1 + (nd - nd / 4 + 0.5) / (nd / 4 + 0.5)) AND coalesce(labels, 0) <= greatest(2, ceil(0.1 * nd)) AND (query_id, term) NOT IN (SELECT (query_id, term) FROM qterms) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, surface) AS pos FROM g) SELECT query_id, surface AS term, round(weight, 4) AS weight, pos FROM r WHERE pos <= 6""")
def requery_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Better question words from the three nearest documents of each passage."""
    q, index = A.questions(spark, sf), A.index(spark, sf)
    w = Window.partitionBy("query_id", "corpus").orderBy(F.desc(F.round("raw", 6)), "doc_ord")
    weak = keyword.best(index.prepare(q), 3).withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return ranking.requery_terms(weak, None, q, index=index).select("query_id", "term", F.round("weight", 4).alias("weight"), "pos")


_T = f"""{_STATS}, raw AS (SELECT query_id, doc_ord, sum(idf * w * 2.2 / (1.2 + w)) AS raw FROM (
 SELECT q.query_id, p.doc_ord, i.idf, tft / (0.25 + 0.75 * lt / mt) + tfb / (0.25 + 0.75 * lb / mb) AS w FROM qterms q JOIN post p USING (term) JOIN idf i USING (term) JOIN lens USING (doc_ord), stats) GROUP BY 1, 2),
tops AS (SELECT query_id % 2 AS population, max(raw) / any_value(ideal) AS ratio FROM raw JOIN stats2 USING (query_id) GROUP BY query_id)"""


@query(f"{_T} SELECT population::VARCHAR AS population, threshold, round(avg((ratio >= threshold)::INT), 4) AS share FROM tops, (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) GROUP BY 1, 2")
def keyword_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of two populations of questions at eight thresholds."""
    q, d = A.questions(spark, sf), None
    p = A.index(spark, sf).prepare(q)
    best = keyword.best(p, 1).groupBy("query_id", "corpus").agg(F.max("raw").alias("raw"))
    tops = best.join(keyword.term_stats(q, d, prepared=p).select("query_id", "corpus", "ideal"), ["query_id", "corpus"]).select((F.col("query_id") % 2).cast("string").alias("population"), (F.col("raw") / F.col("ideal")).alias("ratio"))
    return querylog.keyword_scale(tops).withColumn("share", F.round("share", 4))
