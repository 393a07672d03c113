"""Registered queries of unread files, phrasings, vectors, sections in rankings and streamed capture."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomery.config import CONFIG
from loomery.functions import text as T, vectors
from loomery.operators import fresh, postings, ranking, state, structure
from loomery.sources import shared
from loomery.sources.buckets import BucketTable

from . import adapters as A, sqltext as X
from .stateful import _EX, _HAY

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SAID = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '([a-z0-9][a-z0-9._\\-]{{2,}})', 1))"


@query(f"""WITH {X.DOCS}, d AS (SELECT *, {_HAY} AS hay FROM docs), q AS (SELECT doc_ord AS query_id, unnest(({_SAID.format('description')})[1:200]) AS term FROM d WHERE doc_ord % 10 = 0),
known AS (SELECT term FROM (SELECT DISTINCT term FROM q) t WHERE EXISTS (SELECT 1 FROM d WHERE doc_ord % 10 <> 0 AND contains(hay, term))),
un AS (SELECT DISTINCT query_id, term FROM q ANTI JOIN known USING (term)),
s AS (SELECT doc_ord, 'notes/' || doc_ord || ' ' || lower({X.first_words('description', 3)}) AS file, lower(coalesce(body, '')) AS body FROM d WHERE doc_ord % 10 = 0 AND doc_ord % 70 <> 0),
h AS (SELECT term, 'name' AS kind, doc_ord, file FROM (SELECT DISTINCT term FROM un), s WHERE contains(file, term) UNION ALL SELECT term, 'content', doc_ord, file FROM (SELECT DISTINCT term FROM un), s WHERE contains(body, term)),
r AS (SELECT *, row_number() OVER (PARTITION BY term, kind ORDER BY doc_ord DESC, file) AS n FROM h),
a AS (SELECT term, coalesce(string_agg(file, '|' ORDER BY n) FILTER (kind = 'name' AND n <= 4), '') AS in_names, coalesce(string_agg(file, '|' ORDER BY n) FILTER (kind = 'content' AND n <= 6), '') AS in_contents, count(*) FILTER (kind = 'content') AS n_files FROM r GROUP BY 1)
SELECT query_id, term, in_names, in_contents, n_files FROM un JOIN a USING (term)""")
def stale_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth document is not indexed yet and asks for its own first words; every seventh of those is gated."""
    d = A.plain_docs(spark, sf)
    late = d.where("doc_ord % 10 = 0")
    unmatched = shared.written(fresh.unmatched_terms(late.select(F.col("doc_ord").alias("query_id"), F.col("description").alias("query")), d.where("doc_ord % 10 <> 0")), "unmatched")
    stale = late.select("corpus", F.concat(F.lit("notes/"), F.col("doc_ord").cast("string"), F.lit(" "), F.lower(T.first_words(F.col("description"), 3))).alias("file"), "body", F.col("doc_ord").alias("mtime_ms"), (F.col("doc_ord") % 70 == 0).alias("gated"))
    return fresh.stale_terms(unmatched, stale).select("query_id", "term", F.array_join("in_names", "|").alias("in_names"), F.array_join("in_contents", "|").alias("in_contents"), "n_files")


_READ_CFG = replace(CONFIG, unindexed_files=20, unindexed_bytes=30_000)
_LIVE = f"""WITH {X.DOCS}, live AS (SELECT coalesce(account, 'none') AS corpus, doc_ord, name, file, description, body, modified, epoch_ms(modified) AS ms, strlen(coalesce(body, '')) AS size, doc_ord % 24 = 0 AS gated FROM docs),
f AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY ms DESC, file) AS n FROM live WHERE doc_ord % 4 = 0),
b AS (SELECT corpus, file, coalesce(sum(size) OVER (PARTITION BY corpus ORDER BY ms DESC, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE n <= 20),
fr AS (SELECT f.*, coalesce(before <= 30000, false) AS read FROM f LEFT JOIN b USING (corpus, file)),
direct AS (SELECT corpus, doc_ord, file, modified, {_HAY} AS hay, 'unindexed-direct' AS provenance FROM fr WHERE read AND NOT gated),
old AS (SELECT corpus, doc_ord, file, modified, lower(concat_ws(' ', name, description, CASE WHEN doc_ord % 8 = 0 THEN 'stale ' || description ELSE body END)) AS hay, 'index' AS provenance FROM live WHERE doc_ord % 4 <> 0 OR doc_ord % 8 = 0),
m AS (SELECT * FROM old ANTI JOIN direct USING (corpus, file) UNION ALL SELECT * FROM direct),
asks AS (SELECT item_id AS query_id, {X.first_words('text', 2)} AS q FROM benchmark), t AS (SELECT query_id, unnest({_SAID.format('q')}) AS term FROM asks),
h AS (SELECT query_id, corpus, doc_ord, any_value(modified) AS modified, any_value(provenance) AS provenance, count(*) AS matched FROM t JOIN m ON contains(hay, term) GROUP BY 1, 2, 3),
k AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, corpus ORDER BY modified DESC, doc_ord) AS rank FROM h JOIN (SELECT query_id, corpus, max(matched) AS most FROM h GROUP BY 1, 2) x USING (query_id, corpus) WHERE matched = most)"""


def _latest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = A.plain_docs(spark, sf).withColumn("corpus", F.coalesce("account", F.lit("none"))).withColumn("mtime_ms", F.unix_millis("modified"))
    d = d.withColumn("ts", F.when(F.col("corpus").isin("de", "fr"), F.col("modified"))).withColumn("modified_source", F.lit(None).cast("string"))
    old = d.where("doc_ord % 4 <> 0 or doc_ord % 8 = 0").withColumn("body", F.when(F.col("doc_ord") % 8 == 0, F.concat(F.lit("stale "), "description")).otherwise(F.col("body"))).withColumn("mtime_ms", F.when(F.col("doc_ord") % 8 == 0, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")))
    live = d.withColumn("size", F.octet_length(F.coalesce("body", F.lit(""))).cast("long")).withColumn("gated", F.col("doc_ord") % 24 == 0)
    asks = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.first_words(F.col("text"), 2).alias("query"))
    return fresh.latest(asks, old, live, cfg=_READ_CFG)


@query(f"""{_LIVE}, o AS (SELECT corpus, row_number() OVER (ORDER BY corpus NOT IN ('de', 'fr'), corpus) AS section FROM (SELECT DISTINCT corpus FROM m))
SELECT query_id, corpus, section, rank, doc_ord, provenance FROM k JOIN o USING (corpus) WHERE rank <= 5""")
def direct_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Newest mentions over the index and files read past it, languages standing for corpora."""
    return _latest(spark, sf)[0].select("query_id", "corpus", "section", "rank", "doc_ord", "provenance")


@query(f"""{_LIVE}, i AS (SELECT corpus, count(*) AS total, count(*) FILTER (read) AS scanned, count(*) FILTER (read AND gated) AS excluded, max(ms) FILTER (NOT read AND NOT gated) AS newest FROM fr GROUP BY 1),
u AS (SELECT corpus, string_agg(file, '|' ORDER BY w) AS files FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY ms DESC, file) AS w FROM fr WHERE NOT read AND NOT gated) WHERE w <= 15 GROUP BY 1),
q AS (SELECT query_id, corpus, count(*) FILTER (rank <= 5 AND provenance = 'unindexed-direct') AS merged, epoch_ms(max(modified) FILTER (rank = 1)) AS top FROM k GROUP BY 1, 2)
SELECT query_id, corpus, total, scanned, excluded, merged, coalesce(newest > top, false) AS recency_void, CASE WHEN newest > top THEN files END AS unread_files FROM q LEFT JOIN i USING (corpus) LEFT JOIN u USING (corpus)""")
def recency_void(spark: SparkSession, sf: str) -> DataFrame:
    """What was read and left unread beside the index, and where newest-first cannot be promised."""
    rows = _latest(spark, sf)[1].where("corpus is not null")
    return rows.select("query_id", "corpus", "total", "scanned", "excluded", "merged", "recency_void", F.array_join("unread_files", "|").alias("unread_files"))


@query(f"WITH {X.DOCS} SELECT coalesce(account, 'none') AS corpus, epoch_ms(max(CASE WHEN account IN ('de', 'fr') THEN modified + INTERVAL 1 DAY ELSE modified END)) AS newest_ms FROM docs GROUP BY 1")
def newest_times(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus's newest time, a document's own before its file's."""
    d = A.plain_docs(spark, sf).withColumn("corpus", F.coalesce("account", F.lit("none")))
    return fresh.newest(d.withColumn("ts", F.when(F.col("account").isin("de", "fr"), F.col("modified") + F.expr("interval 1 day")))).select("corpus", F.unix_millis("newest").alias("newest_ms"))


# Phrasings -----------------------------------------------------------------------------------

_W = X.words("text")
_PHRASED = f"""WITH {X.POSTINGS}, asked AS (SELECT item_id AS query_id, array_to_string(({_W})[1:12], ' ') AS q0, array_to_string(({_W})[13:24], ' ') AS q1, array_to_string(({_W})[25:36], ' ') AS q2 FROM benchmark),
every AS (SELECT query_id, 0 AS variant, q0 AS query FROM asked UNION ALL SELECT query_id, 1, q1 FROM asked WHERE q1 <> '' UNION ALL SELECT query_id, 2, q2 FROM asked WHERE q2 <> ''),
qterms AS (SELECT DISTINCT query_id, variant, unnest({X.tokens('query')}) AS term FROM every),
raw AS (SELECT query_id, variant, doc_ord, sum(idf * w * 2.2 / (1.2 + w)) AS raw FROM (
 SELECT q.query_id, q.variant, p.doc_ord, i.idf, tft / (0.25 + 0.75 * lt / mt) + tfb / (0.25 + 0.75 * lb / mb) AS w FROM qterms q JOIN post p USING (term) JOIN idf i USING (term) JOIN lens USING (doc_ord), stats) GROUP BY 1, 2, 3),
s AS (SELECT query_id, variant, doc_ord, raw / max(raw) OVER (PARTITION BY query_id, variant) AS kw FROM raw),
j AS (SELECT s.*, d.name, d.tier, kw * (CASE WHEN tier = 'archive' THEN 1.0 ELSE 1.15 END) * (0.85 + 0.15 * exp(-greatest(0, (1719792000000 - epoch_ms(modified)) / 86400000.0) / 180)) AS score FROM s JOIN docs d USING (doc_ord)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY round(kw, 9) DESC, doc_ord) AS pass1 FROM j),
a AS (SELECT *, sum((tier = 'archive')::INT) OVER (PARTITION BY query_id, variant ORDER BY round(score, 9) DESC, doc_ord ROWS UNBOUNDED PRECEDING) AS seen FROM p WHERE pass1 <= 30),
r AS (SELECT *, round(score, 4) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY (tier = 'archive' AND seen > 4), round(score, 9) DESC, doc_ord) AS rank FROM a) WHERE rank <= 8),
strong AS (SELECT * FROM r WHERE variant > 0 AND shown >= 0.38)"""


def _phrased(spark: SparkSession, sf: str) -> ranking.Phrased:
    """Words 1 to 12 of a passage as the question; words 13 to 24 and 25 to 36 as phrasings, among blank, equal and repeated ones."""
    b, w = A.table(spark, sf, "benchmark"), T.words(F.col("text"))
    part = lambda k: F.array_join(F.slice(w, k, 12), " ")
    asks = b.select(F.col("item_id").alias("query_id"), part(1).alias("query"))
    said = F.array(F.concat(F.lit("¿"), part(1), F.lit(" ?!")), F.lit("  "), part(13), F.concat(F.lit("?"), part(13), F.lit("!")), part(25))
    return ranking.search_phrasings(asks, b.select(F.col("item_id").alias("query_id"), F.posexplode(said).alias("pos", "query")), None, A.AS_OF, index=A.index(spark, sf))


@query(f"""{_PHRASED} SELECT query_id, r.rank, doc_ord, r.shown AS score, concat_ws(',', 'query', string_agg('queries[' || (g.variant - 1) || ']', ',' ORDER BY g.variant)) AS matched_via
FROM r LEFT JOIN strong g USING (query_id, doc_ord) WHERE r.variant = 0 GROUP BY query_id, r.rank, doc_ord, r.shown""")
def phrased_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The question's own rows, as they are without phrasings, with the phrasings that reach them too."""
    return _phrased(spark, sf).rows.select("query_id", "rank", "doc_ord", "score", F.array_join("matched_via", ",").alias("matched_via"))


@query(f"""{_PHRASED}, v AS (SELECT query_id, doc_ord, max(shown) AS score, string_agg('queries[' || (variant - 1) || ']', ',' ORDER BY variant) AS matched_via FROM strong g
 WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.variant = 0 AND r.query_id = g.query_id AND r.doc_ord = g.doc_ord) GROUP BY 1, 2)
SELECT query_id, doc_ord, v.score, matched_via, coalesce(round(j.score, 4), 0) AS query_score, false AS also_best_weak FROM v LEFT JOIN (SELECT * FROM j WHERE variant = 0) j USING (query_id, doc_ord)""")
def phrased_via(spark: SparkSession, sf: str) -> DataFrame:
    """What only phrasings reach, with the score that the question itself gives it."""
    return _phrased(spark, sf).via.select("query_id", "doc_ord", "score", F.array_join("matched_via", ",").alias("matched_via"), "query_score", "also_best_weak")


@query(f"""{_PHRASED} SELECT e.query_id, e.variant, coalesce(t.top, NULL) IS NULL AS no_strong_match, CASE WHEN t.top IS NULL THEN 'none' ELSE 'unrated' END AS confidence, round(t.top, 4) AS top_score, coalesce(n, 0) AS strong_rows
FROM (SELECT DISTINCT query_id, variant FROM qterms WHERE variant > 0) e LEFT JOIN (SELECT query_id, variant, max(score) AS top FROM a GROUP BY 1, 2) t USING (query_id, variant) LEFT JOIN (SELECT query_id, variant, count(*) AS n FROM strong GROUP BY 1, 2) s USING (query_id, variant)""")
def phrased_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each phrasing."""
    return _phrased(spark, sf).runs.select("query_id", "variant", "no_strong_match", "confidence", "top_score", "strong_rows")


# Vectors -------------------------------------------------------------------------------------


@query("""SELECT vec_id, CASE vec_id % 50 WHEN 0 THEN '63 floats, not 64' WHEN 1 THEN '253 bytes, not a whole number of floats' WHEN 2 THEN 'not base64' END AS refusal,
 CASE WHEN vec_id % 50 > 2 THEN round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) END AS total, CASE WHEN vec_id % 50 > 2 THEN round(list_sum(list_transform(range(1, 65), lambda i: i * embedding[i]::DOUBLE)), 3) END AS moment FROM embeddings""")
def vector_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors through text and back; texts that were cut or spoilt are refused, not read as shorter vectors."""
    e = vectors.encode(A.table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", "blob").select("vec_id", "blob")
    k = F.col("vec_id") % 50
    cut = lambda n: F.base64(F.substring(F.unbase64("blob"), 1, n))
    got = vectors.decode(e.withColumn("blob", F.when(k == 0, cut(252)).when(k == 1, cut(253)).when(k == 2, F.lit("*no*")).otherwise(F.col("blob"))), "blob", "vec", 64)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    moment = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return got.select("vec_id", "refusal", F.round(total, 4).alias("total"), F.round(moment, 3).alias("moment"))


@query(f"""WITH c AS (SELECT doc_id, {X.first_words('text', 3)} AS text FROM documents), s AS (SELECT DISTINCT sha256(text) AS text_sha, text FROM c)
SELECT text_sha, length(text) AS n FROM s WHERE text_sha NOT IN (SELECT sha256(text) FROM c WHERE doc_id % 3 = 0)""")
def seeded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors lifted out of an index by the hash of their text; those that the cache has stay out."""
    c = A.table(spark, sf, "documents").select("doc_id", T.first_words(F.col("text"), 3).alias("text")).withColumn("vec", F.array(F.length("text").cast("float")))
    have = vectors.seed_cache(c.where("doc_id % 3 = 0"), "c1")
    return vectors.seed_cache(c, "c1", have).select("text_sha", F.get("vec", F.lit(0)).cast("int").alias("n"))


# Sections in rankings --------------------------------------------------------------------------

_FLAT = "regexp_replace(coalesce(text, ''), '[#`~]', ' '{})"
_CUT = f"""c AS (SELECT doc_id, {X.words(_FLAT.format(", 'g'"))} AS w, {X.first_words(_FLAT.format(", 'g'"), 12)} AS description, make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS modified FROM documents),
k AS (SELECT *, len(w) // 3 AS n FROM c),
docs AS (SELECT doc_id * 1048576 AS doc_ord, 'doc-' || doc_id AS name, 'doc-' || doc_id AS file, description, '' AS heading, 'hot' AS tier, modified, CASE WHEN n >= 10 THEN CASE WHEN description <> '' THEN description ELSE 'doc-' || doc_id END || chr(10) || chr(10) || '(3 sections, indexed individually.)' ELSE array_to_string(w, ' ') END AS body FROM k
 UNION ALL SELECT doc_id * 1048576 + i, 'doc-' || doc_id || '#part-v' || i, 'doc-' || doc_id, 'doc-' || doc_id || ' — Part v' || i, 'Part v' || i, CASE WHEN i = 1 THEN 'archive' ELSE 'hot' END, modified, '## Part v' || i || chr(10) || array_to_string(w[(i - 1) * n + 1 : CASE WHEN i = 3 THEN len(w) ELSE i * n END], ' ') FROM k, (SELECT unnest([1, 2, 3]) AS i) WHERE n >= 10)"""


@query(f"""WITH {_CUT}, {X.QUERY_TERMS},
toks AS (SELECT doc_ord, file, list_concat({X.tokens("replace(replace(name, '-', ' '), '_', ' ')")}, {X.tokens('name')}) AS n, {X.tokens('description')} AS de, {X.tokens('heading')} AS he, {X.tokens('body')} AS b FROM docs),
lens AS (SELECT doc_ord, len(n) * 3.0 + len(de) * 2.0 AS lt, len(he) * 1.5 AS lh, len(b) * 0.3 AS lb FROM toks),
stats AS (SELECT (SELECT count(*) FROM documents) AS nd, avg(lt) AS mt, CASE WHEN avg(lh) = 0 THEN 1 ELSE avg(lh) END AS mh, CASE WHEN avg(lb) = 0 THEN 1 ELSE avg(lb) END AS mb FROM lens),
post AS (SELECT doc_ord, file, term, sum(CASE WHEN g = 't' THEN w ELSE 0 END) AS tft, sum(CASE WHEN g = 'h' THEN w ELSE 0 END) AS tfh, sum(CASE WHEN g = 'b' THEN w ELSE 0 END) AS tfb FROM (
 SELECT doc_ord, file, unnest(n) AS term, 't' AS g, 3.0::DOUBLE AS w FROM toks UNION ALL SELECT doc_ord, file, unnest(de), 't', 2.0 FROM toks UNION ALL SELECT doc_ord, file, unnest(he), 'h', 1.5 FROM toks UNION ALL SELECT doc_ord, file, unnest(b), 'b', 0.3 FROM toks) GROUP BY 1, 2, 3),
idf AS (SELECT term, ln(1 + (any_value(nd) - count(DISTINCT file) + 0.5) / (count(DISTINCT file) + 0.5)) AS idf FROM post, stats GROUP BY term),
raw AS (SELECT query_id, doc_ord, sum(idf * w * 2.2 / (1.2 + w)) AS raw FROM (SELECT q.query_id, p.doc_ord, i.idf, tft / (0.25 + 0.75 * lt / mt) + tfh / (0.25 + 0.75 * lh / mh) + tfb / (0.25 + 0.75 * lb / mb) AS w
 FROM qterms q JOIN post p USING (term) JOIN idf i USING (term) JOIN lens USING (doc_ord), stats) GROUP BY 1, 2),
s AS (SELECT query_id, doc_ord, raw / max(raw) OVER (PARTITION BY query_id) AS kw FROM raw),
p AS (SELECT s.*, d.name, d.file, d.tier, kw * (CASE WHEN tier = 'archive' THEN 1.0 ELSE 1.15 END) * (0.85 + 0.15 * exp(-greatest(0, (1719792000000 - epoch_ms(modified)) / 86400000.0) / 180)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(kw, 9) DESC, doc_ord) AS pass1 FROM s JOIN docs d USING (doc_ord)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY round(score, 9) DESC, doc_ord) AS slot FROM p WHERE pass1 <= 30) WHERE slot <= 1),
a AS (SELECT *, sum((tier = 'archive')::INT) OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_ord ROWS UNBOUNDED PRECEDING) AS seen FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (tier = 'archive' AND seen > 4), round(score, 9) DESC, doc_ord) AS rank FROM a)
SELECT query_id, rank, name, tier, round(score, 4) AS score FROM r WHERE rank <= 8""")
def section_search(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut into three sections, indexed and ranked beside their stubs; a file has one row, the oldest version is archived."""
    flat = F.regexp_replace(F.coalesce("body", F.lit("")), "[#`~]", " ")
    d = A.plain_docs(spark, sf).withColumn("w", T.words(flat)).withColumn("n", F.floor(F.size("w") / 3).cast("int"))
    part = lambda i, n: F.concat(F.lit(f"## Part v{i}\n"), F.array_join(F.slice("w", (i - 1) * F.col("n") + 1, n), " "))
    whole = F.concat_ws("\n", part(1, F.col("n")), part(2, F.col("n")), part(3, F.size("w") - 2 * F.col("n")))
    d = d.withColumn("description", F.array_join(F.slice("w", 1, 12), " ")).withColumn("body", F.when(F.col("n") >= 10, whole).otherwise(F.array_join("w", " "))).drop("w", "n")
    d = d.withColumn("tier", F.lit("hot")).withColumn("in_memory_index", F.lit(False)).withColumn("session_id", F.lit(None).cast("string"))
    sections = structure.section_docs(d, replace(CONFIG, section_min_doc=0, section_min_chars=0, section_keep=2))
    index = postings.build(sections, shared.fresh_path(spark, "sections"))
    rows, _ = ranking.search(A.questions(spark, sf), None, A.AS_OF, index=index)
    return rows.select("query_id", "rank", "name", "tier", "score")


# Capture ---------------------------------------------------------------------------------------


@query(f"{_EX} SELECT name, session_id, turns::INT AS turns, md5(ask) AS ask, md5(reply) AS reply, epoch_ms(end_ts) AS end_ms FROM named")
def captured_growing(spark: SparkSession, sf: str) -> DataFrame:
    """ST3-ST6: conversations captured by a stream in three growing parts are those captured once.

    Between two parts a writer dies after its files and before its manifest: what it wrote counts for nothing.
    """
    from loomery.streaming import capture as live

    turns = A.turns(spark, sf).withColumn("stop_reason", F.when(F.col("role") == "assistant", "end_turn"))
    src, out, mark = (shared.fresh_path(spark, k) for k in ("turns", "captured", "mark"))
    for part in range(3):
        turns.where(F.least(F.floor(F.col("ix") / 3), F.lit(2)) == part).write.mode("append").json(src)
        live.start(live.turns_stream(spark, src), out, mark).awaitTermination()
        if part == 1:
            table = BucketTable(spark, out, "name")
            table.commit, keep = (lambda *a: None), table.commit
            table.upsert(table.read().withColumn("reply", F.lit("lost")), [F.col("turns")])
            table.commit = keep
    return live.captured(spark, out).select("name", "session_id", "turns", F.md5("ask").alias("ask"), F.md5("reply").alias("reply"), F.unix_millis("end_ts").alias("end_ms"))
