"""Registered upkeep, audit and query-log queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomery.operators import commits, keyword, probes, querylog, upkeep

from . import adapters as A, sqltext as X

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _listing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What is there now and what the index knows: by rule a tenth is new, a tenth gone and a tenth changed."""
    d = A.table(spark, sf, "documents").select("doc_id", F.lit("curated").alias("corpus"), F.concat(F.lit("doc-"), "doc_id").alias("file"), (F.col("doc_id") * 1000).alias("mtime_ms"), F.col("n_chars").alias("size"))
    live = d.where("doc_id % 10 <> 1").drop("doc_id")
    known = d.where("doc_id % 10 <> 2").withColumn("size", F.when(F.col("doc_id") % 10 == 3, F.col("size") + 1).otherwise(F.col("size"))).drop("doc_id")
    return live, known


@query("SELECT 'doc-' || doc_id AS file, CASE doc_id % 10 WHEN 1 THEN 'removed' WHEN 2 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def listing_diff(spark: SparkSession, sf: str) -> DataFrame:
    """J13"""
    return upkeep.listing_diff(*_listing(spark, sf)).select("file", "change")


@query("SELECT 'curated' AS corpus, count(*) FILTER (doc_id % 10 = 2) AS added, count(*) FILTER (doc_id % 10 = 1) AS removed, count(*) FILTER (doc_id % 10 = 3) AS changed, CASE WHEN count(*) FILTER (doc_id % 10 IN (1, 2, 3)) = 0 THEN 'fresh' WHEN count(*) FILTER (doc_id % 10 IN (1, 2, 3)) <= 8 THEN 'incremental' ELSE 'index_stale' END AS policy FROM documents")
def freshness_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A17, R17"""
    corpora = spark.createDataFrame([("curated",)], "corpus string")
    return upkeep.freshness(upkeep.listing_diff(*_listing(spark, sf)), corpora).select("corpus", "added", "removed", "changed", "policy")


@query("SELECT 'curated' AS corpus, sha256(string_agg(l, chr(10) ORDER BY l)) AS digest, count(*) AS \"count\" FROM (SELECT 'doc-' || doc_id || ':' || doc_id * 1000 || ':' || n_chars AS l FROM documents)")
def listing_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A18"""
    d = A.table(spark, sf, "documents").select(F.lit("curated").alias("corpus"), F.concat(F.lit("doc-"), "doc_id").alias("file"), (F.col("doc_id") * 1000).alias("mtime_ms"), F.col("n_chars").alias("size"))
    return upkeep.listing_digest(d)


@query("SELECT 'curated' AS corpus, sha256(string_agg(l, '|' ORDER BY l)) AS corpus_hash FROM (SELECT 'doc-' || doc_id || ':' || sha256(text) AS l FROM documents)")
def corpus_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A19"""
    return upkeep.corpus_hash(A.plain_docs(spark, sf).withColumn("hash", F.sha2("body", 256)))


@query("SELECT doc_id AS doc_ord, doc_id % 3 <> 0 AS reuse FROM documents")
def build_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document has changed since the index before."""
    d = A.plain_docs(spark, sf).select("doc_ord", "name", F.md5("body").alias("hash"), F.unix_millis("modified").alias("mtime_ms"))
    before = d.where("doc_ord % 3 <> 0").drop("doc_ord").unionByName(d.where("doc_ord % 3 = 0").drop("doc_ord").withColumn("hash", F.lit("old")))
    return upkeep.plan_build(d, before).select("doc_ord", "reuse")


@query("SELECT 'doc-' || doc_id AS name FROM documents WHERE doc_id % 7 = 0")
def vanished(spark: SparkSession, sf: str) -> DataFrame:
    """K04, J15"""
    d = A.plain_docs(spark, sf)
    return upkeep.vanished(d, d.where("doc_ord % 7 <> 0")).select("name")


#: Events as a run log: purchases are captures (every seventh a walk that agreed), errors failures, views starts, others skipped or of audits.
_RUNS = """r AS (SELECT user_id AS pid, event_id AS seq, ts AS tm, user_id % 3 AS session,
 CASE WHEN event_id % 7 = 0 THEN 'walker' WHEN event_id % 11 = 0 THEN 'audit' END AS trigger,
 CASE WHEN event_id % 7 = 0 AND event_type = 'purchase' THEN 'agrees' WHEN event_id % 7 = 0 AND event_type = 'error' THEN 'failed' END AS reconcile,
 CASE WHEN event_id % 7 = 0 THEN 'finished' WHEN event_type = 'purchase' THEN 'captured' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'started' ELSE 'skipped' END AS outcome FROM events)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    walk = k % 7 == 0
    outcome = F.when(walk, "finished").when(kind == "purchase", "captured").when(kind == "error", "failed").when(kind == "view", "started").otherwise("skipped")
    reconcile = F.when(walk & (kind == "purchase"), "agrees").when(walk & (kind == "error"), "failed")
    return A.table(spark, sf, "events").select(F.col("user_id").alias("pid"), k.alias("seq"), F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 3).alias("session"), F.when(walk, "walker").when(k % 11 == 0, "audit").alias("trigger"), reconcile.alias("reconcile"), outcome.alias("outcome"))


@query(f"""WITH {_RUNS}, v AS (SELECT *, CASE WHEN trigger = 'walker' THEN CASE reconcile WHEN 'agrees' THEN 1 WHEN 'failed' THEN -1 ELSE 0 END WHEN trigger = 'audit' THEN 0 WHEN outcome = 'captured' THEN 1 WHEN outcome = 'failed' THEN -1 ELSE 0 END AS v FROM r),
o AS (SELECT *, sum((v = 1)::INT) OVER (PARTITION BY pid ORDER BY tm DESC, seq DESC) AS good FROM v)
SELECT pid AS user_id, count(*) FILTER (v = -1 AND good = 0) AS streak, epoch_us(min(tm) FILTER (v = -1 AND good = 0)) // 1000 AS since_ms, count(*) FILTER (v = 1) = 0 AND count(*) FILTER (v = -1) > 0 AS lower_bound FROM o GROUP BY pid""")
def failure_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of each process since the last run that ended well; skipped runs and audits are passed over."""
    return upkeep.failure_streak(_runs(spark, sf), key="pid").select(F.col("pid").alias("user_id"), "streak", F.unix_millis("since").alias("since_ms"), "lower_bound")


@query(f"""WITH {_RUNS}, early AS (SELECT * FROM r WHERE NOT (tm >= TIMESTAMP '2024-01-20' AND (outcome = 'captured' OR coalesce(reconcile, '') = 'agrees'))),
l AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tm DESC, seq DESC) AS n FROM early WHERE trigger IS NULL),
ok AS (SELECT max((tm, seq)) AS ok FROM early WHERE reconcile = 'agrees' OR (trigger IS NULL AND outcome = 'captured'))
SELECT pid AS user_id, seq AS event_id FROM l, ok WHERE n = 1 AND outcome = 'started' AND tm <= TIMESTAMP '2024-01-30' AND pid % 5 <> 0 AND (tm, seq) > ok""")
def crashed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Starts that nothing followed and no later run repaired, of whatever session; every fifth process is alive."""
    rows = _runs(spark, sf).where(~((F.col("at") >= F.lit(datetime(2024, 1, 20))) & ((F.col("outcome") == "captured") | F.coalesce(F.col("reconcile") == "agrees", F.lit(False)))))
    alive = rows.where("pid % 5 = 0").select("pid").distinct()
    return upkeep.crashed_runs(rows, alive, F.lit(datetime(2024, 1, 30, 0, 10))).select(F.col("pid").alias("user_id"), F.col("seq").alias("event_id"))


@query("SELECT user_id::VARCHAR AS caller, count(*) AS calls, bool_and(event_type = 'error') AS missed FROM events GROUP BY 1")
def caller_misses(spark: SparkSession, sf: str) -> DataFrame:
    """A20, F12"""
    return querylog.caller_misses(A.log(spark, sf)).select("caller", "calls", "missed")


@query("SELECT CASE WHEN value > 50 THEN 'hybrid' ELSE 'bm25-only' END AS mode, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 1) AS percent FROM events GROUP BY 1")
def mode_split(spark: SparkSession, sf: str) -> DataFrame:
    """A21"""
    return querylog.mode_split(A.log(spark, sf))


@query("SELECT event_type AS shape, count(*) AS n, 1 AS wordings FROM events WHERE event_type = 'error' GROUP BY 1")
def failure_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """A21"""
    return querylog.failure_shapes(A.log(spark, sf))


@query("SELECT event_type AS term, count(*) AS fails FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3")
def dead_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A21"""
    return querylog.dead_terms(A.log(spark, sf))


@query("""WITH f AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'),
p AS (SELECT f.user_id, f.event_id, count(e.event_id) AS n, bool_or(e.event_type <> 'error') AS rec FROM f LEFT JOIN events e ON e.user_id = f.user_id AND (e.ts, e.event_id) > (f.ts, f.event_id) AND e.ts <= f.ts + INTERVAL 3600 SECOND GROUP BY 1, 2)
SELECT event_id, n AS later_calls, n > 0 AS retried, coalesce(rec, false) AS recovered FROM p""")
def retry_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and what the user did within the hour; all events share a term here."""
    return querylog.retries(A.log(spark, sf), F.array(F.lit("x")), "query_id", seconds=3600).select(F.col("fail_seq").alias("event_id"), "later_calls", "retried", "recovered")


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE event_type IN (SELECT lower(event_type) FROM events) GROUP BY 1")
def bench_flag(spark: SparkSession, sf: str) -> DataFrame:
    """flagged rows of the log by membership."""
    log = A.log(spark, sf)
    flagged = querylog.flag_benchmark(log, log.select(F.col("q").alias("text")).distinct())
    return flagged.where("benchmark").groupBy(F.col("query_id").alias("user_id")).agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("failed"), 1)).alias("errors"))


@query("""WITH s AS (SELECT source AS corpus, n_chars::DOUBLE AS v FROM documents), m AS (SELECT corpus, count(*) AS n, median(v) AS score FROM s GROUP BY 1)
SELECT corpus, round(0.38 * score / (SELECT score FROM m WHERE corpus = 'src0'), 4) AS score_floor, round(0.2 * score / (SELECT score FROM m WHERE corpus = 'src0'), 4) AS coverage_floor FROM m WHERE n >= 5""")
def derived_floors(spark: SparkSession, sf: str) -> DataFrame:
    """Floors by medians relative to a base, sources standing for corpora and lengths for scores."""
    d = A.table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.col("n_chars").cast("double").alias("top_score"), F.col("n_chars").cast("double").alias("coverage"))
    return querylog.derived_floors(d, "src0")


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda z: length(z) > 3 AND lower(z) NOT IN ('with', 'that', 'this', 'from', 'were', 'have', 'they', 'their', 'which', 'what', 'when', 'there', 'been', 'would', 'could', 'into', 'than', 'then', 'them')) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(0, 6)) AS i, w FROM w WHERE len(w) >= 24), q AS (SELECT doc_id, w[i * (len(w) // 6) + 1] AS t, min(i) AS i FROM p GROUP BY 1, 2)
SELECT doc_id AS doc_ord, string_agg(t, ' ' ORDER BY i) AS question FROM q GROUP BY 1""")
def self_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Six words from across each document that has enough of them."""
    d = A.plain_docs(spark, sf).select("doc_ord", querylog.self_query(F.col("body")).alias("question"))
    return d.where("question is not null")


@query("SELECT project AS corpus, max(doc_ord) FILTER (n = k) AS doc_ord FROM (SELECT source AS project, doc_id AS doc_ord, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, floor(0.9 * (count(*) OVER (PARTITION BY source) - 1)) + 1 AS k FROM documents) GROUP BY 1")
def floor_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """M01's percentile: the value at floor(0.9 (n - 1))."""
    d = A.plain_docs(spark, sf).select(F.col("project").alias("corpus"), "doc_ord")
    return querylog.floor_percentile(d, "corpus", "doc_ord", 0.9)


@query("SELECT event_type AS repo, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS since, floor(epoch(max(ts)))::BIGINT AS last_s FROM events GROUP BY 1")
def corpus_currency(spark: SparkSession, sf: str) -> DataFrame:
    """Commits of each repo since the newest exchange."""
    newest = spark.sql("SELECT timestamp_ntz'2024-01-15 00:00:00' AS ts")
    c = A.table(spark, sf, "events").select(F.col("event_type").alias("repo"), F.col("ts").alias("at"))
    return commits.currency(newest, c).select("repo", "since", F.unix_seconds(F.col("last_commit").cast("timestamp")).alias("last_s"))


_PROBE = """CASE doc_id % 13 WHEN 0 THEN 'date_past 2020-01-01' WHEN 1 THEN 'date_past soon' WHEN 2 THEN 'moon_phase full' WHEN 3 THEN 'port_listening 80'
 WHEN 4 THEN 'file_exists /srv/' || source || '/' || doc_id || '.md' WHEN 5 THEN 'file_exists /srv/' || source || '/none.md' WHEN 6 THEN 'file_exists /gone/' || source || '/a.md'
 WHEN 7 THEN 'grep_count /srv/' || source || '/' || doc_id || '.md :: ' || left(text, 2) WHEN 8 THEN 'file_hash_span /srv/' || source || '/' || doc_id || '.md :: 1-6'
 WHEN 9 THEN 'git_tag_exists /repo/' || source || ' :: v' || doc_id WHEN 10 THEN 'git_rev_parse /repo/' || source || ' :: v' || (doc_id - 1) || '^{}'
 WHEN 11 THEN 'git_rev_count /repo/' || source || ' :: --since=2024-01-10' ELSE 'grep_count /srv/' || source || ' :: ' || left(text, 3) END"""
_WANT = "CASE doc_id % 13 WHEN 7 THEN '>= 3' WHEN 8 THEN '~A' WHEN 10 THEN '~' || left(md5(CAST(doc_id - 1 AS STRING)), 5) WHEN 11 THEN '> 40' WHEN 12 THEN '<2000' ELSE 'true' END"


@query(f"""WITH d AS (SELECT *, string_split(text, chr(10)) AS lines, {_WANT.replace('STRING', 'VARCHAR')} AS want FROM documents),
folder AS (SELECT d.doc_id, sum(len(list_filter(f.lines, lambda s: contains(s, trim(left(d.text, 3)))))) AS n FROM d JOIN d f USING (source) WHERE d.doc_id % 13 = 12 GROUP BY 1),
repo AS (SELECT source, count(*) FILTER (doc_id * 3600 >= 9 * 86400 AND doc_id % 3 > 0) AS n, bool_or(doc_id % 2 = 0) AS known FROM documents GROUP BY 1),
a AS (SELECT d.doc_id, want, doc_id % 5 = 0 AS expired, CASE doc_id % 13 WHEN 0 THEN 'true' WHEN 4 THEN 'true' WHEN 5 THEN 'false' WHEN 7 THEN len(list_filter(lines, lambda s: contains(s, trim(left(text, 2)))))::VARCHAR
 WHEN 8 THEN CASE WHEN len(lines) >= 6 THEN left(sha256(array_to_string(lines[1:6], chr(10))), 12) END WHEN 9 THEN CASE WHEN known THEN CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END END
 WHEN 10 THEN (SELECT md5(r.doc_id::VARCHAR) FROM documents r WHERE r.doc_id = d.doc_id - 1 AND r.source = d.source AND r.doc_id % 2 = 0)
 WHEN 11 THEN CASE WHEN known THEN repo.n::VARCHAR END WHEN 12 THEN folder.n::VARCHAR END AS actual,
 doc_id % 13 = 6 OR doc_id % 13 = 8 AND len(lines) < 6 OR doc_id % 13 IN (9, 10, 11) AND NOT known AS gone FROM d LEFT JOIN folder USING (doc_id) LEFT JOIN repo USING (source))
SELECT doc_id AS doc_ord, CASE WHEN NOT expired THEN actual END AS actual, CASE WHEN expired THEN 'STALE' WHEN actual IS NOT NULL THEN CASE WHEN CASE left(want, 1) WHEN '~' THEN contains(lower(actual), lower(want[2:])) WHEN '>' THEN CASE WHEN want = '>= 3' THEN actual::INT >= 3 ELSE actual::INT > 40 END WHEN '<' THEN actual::INT < 2000 ELSE actual = want END THEN 'FRESH' ELSE 'STALE' END
 WHEN gone THEN 'UNPROVABLE' ELSE 'UNKNOWN' END AS verdict FROM a""")
def probe_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files in folders of their sources, every second one a tag, two of three a commit; a probe of each by rule."""
    t = A.table(spark, sf, "documents")
    d = t.selectExpr("'curated' AS corpus", "doc_id AS doc_ord", "concat('doc-', doc_id) AS name", f"{_PROBE} AS probe", f"{_WANT} AS probe_expected", "CASE WHEN doc_id % 5 = 0 THEN timestamp'2024-01-01' END AS valid_until")
    files = t.selectExpr("'/srv/' || source || '/' || doc_id || '.md' AS path", "text")
    refs = t.where("doc_id % 2 = 0").selectExpr("'/repo/' || source AS repo", "'refs/tags/v' || doc_id AS ref", "'tag' AS sha", "md5(CAST(doc_id AS STRING)) AS peeled")
    log = t.selectExpr("'/repo/' || source AS repo", "md5(CAST(doc_id AS STRING)) AS sha", "timestamp_seconds(1704067200 + doc_id * 3600) AS at", "doc_id % 3 > 0 AS on_mainline")
    return probes.sweep(d, files, refs, log, F.lit(A.AS_OF)).select("doc_ord", "actual", "verdict")


@query("SELECT doc_id AS doc_ord, CASE WHEN doc_id % 2 = 0 THEN 'missing' ELSE 'orphan' END AS kind FROM documents WHERE doc_id % 10 = 0 OR doc_id % 10 = 1 AND source IN (SELECT source FROM documents WHERE doc_id % 10 <> 1)")
def store_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A store and a fresh extraction that differ by rule."""
    d = A.plain_docs(spark, sf).select(F.col("doc_ord"), F.col("project").alias("session_id"), "name", F.concat("name", F.lit("x")).alias("body"), F.col("modified").alias("ts"))
    store = d.where("doc_ord % 10 <> 0")
    extracted = d.where("doc_ord % 10 <> 1").select("session_id", "name", "ts")
    found = upkeep.store_audit(store, extracted, F.lit(datetime(2000, 1, 1))).where("kind in ('missing', 'orphan')")
    return found.select(F.substring_index("name", "-", -1).cast("long").alias("doc_ord"), "kind")


@query("SELECT doc_id AS doc_ord FROM documents WHERE doc_id % 9 = 0")
def snapshot_difference(spark: SparkSession, sf: str) -> DataFrame:
    """M08"""
    d = A.plain_docs(spark, sf).select("doc_ord", "name")
    other = d.withColumn("name", F.when(F.col("doc_ord") % 9 == 0, F.lit("other")).otherwise(F.col("name")))
    return upkeep.snapshot_difference(d, other, ["doc_ord"], ["name"]).select("doc_ord")


@query(f"WITH {X.TURNS}, f AS (SELECT doc_id, text FROM documents) SELECT doc_id AS doc_ord, sha256(text) AS text_sha FROM f WHERE doc_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AND text NOT IN (SELECT text FROM f WHERE doc_id % 2 = 0)")
def missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that a cache of the even documents lacks, each once."""
    d = A.plain_docs(spark, sf).select("doc_ord", F.col("body").alias("text"))
    cache = d.where("doc_ord % 2 = 0").select(F.lit("c").alias("contract"), F.sha2("text", 256).alias("text_sha"), F.array(F.lit(1.0)).alias("vec")).distinct()
    _, miss = upkeep.missing_vectors(d, cache, "c")
    return d.withColumn("text_sha", F.sha2("text", 256)).join(miss.select("text_sha"), "text_sha").groupBy("text_sha").agg(F.min("doc_ord").alias("doc_ord"))
