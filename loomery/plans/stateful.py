"""Registered state, capture and interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomery.functions import text as T
from loomery.operators import capture, commits, state

from . import adapters as A, sqltext as X

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_HAY = "lower(concat_ws(' ', name, description, body))"
_TERMS = "list_distinct(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9._\\-]{2,})', 1))"
#: Questions of state: whole benchmark passages, at most 200 terms of each.
_ASK = f"asks AS (SELECT item_id AS query_id, text FROM benchmark), at AS (SELECT query_id, unnest(({_TERMS})[1:200]) AS term FROM asks), an AS (SELECT query_id, count(*) AS n FROM at GROUP BY 1)".replace(" at AS", " aterm AS").replace("FROM at ", "FROM aterm ")
_HITS = f"""WITH {X.DOCS}, {_ASK}, h AS (SELECT query_id, doc_ord, any_value(modified) AS modified, count(*) AS m FROM aterm JOIN docs ON contains({_HAY}, term) GROUP BY 1, 2)"""


def _asks(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"""{_HITS}, s AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY modified DESC, doc_ord) AS rank FROM h JOIN an USING (query_id) WHERE m = n)
SELECT query_id, rank, doc_ord FROM s WHERE rank <= 5""")
def contains_all_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The five newest documents with every term."""
    rows, _ = state.latest(_asks(spark, sf), A.plain_docs(spark, sf))
    return rows.where("not relaxed").select("query_id", "rank", "doc_ord")


@query(f"""{_HITS}, x AS (SELECT query_id, max(m) AS most FROM h GROUP BY 1)
SELECT query_id, count(*) AS total_mentions, any_value(most) < any_value(n) AS relaxed FROM h JOIN x USING (query_id) JOIN an USING (query_id) WHERE m = most GROUP BY 1
UNION ALL SELECT query_id, 0, false FROM asks WHERE query_id NOT IN (SELECT query_id FROM h)""")
def relaxed_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of each question, relaxed where no document has all its terms."""
    _, info = state.latest(_asks(spark, sf), A.plain_docs(spark, sf))
    return info.select("query_id", "total_mentions", "relaxed")


@query(f"""WITH {X.DOCS}, {_ASK}, t AS (SELECT DISTINCT term FROM aterm)
SELECT term, count(doc_ord) AS df, count(*) FILTER (regexp_matches(hay, '(^|[^a-z0-9_])' || replace(replace(term, '.', '\\.'), '-', '\\-') || '($|[^a-z0-9_])')) AS df_word
FROM t LEFT JOIN (SELECT doc_ord, {_HAY} AS hay FROM docs) ON contains(hay, term) GROUP BY 1""")
def df_word_vs_substring(spark: SparkSession, sf: str) -> DataFrame:
    """F05, A11"""
    terms = _asks(spark, sf).select(F.explode(state.contains_terms(F.col("query"))).alias("term"))
    return state.term_frequencies(terms, A.plain_docs(spark, sf))


@query(f"""{_HITS} SELECT h.query_id, h.doc_ord, sum((length(hay) - length(replace(hay, term, ''))) // length(term))::BIGINT AS term_hits FROM h JOIN aterm USING (query_id) JOIN (SELECT doc_ord, {_HAY} AS hay FROM docs) USING (doc_ord) GROUP BY 1, 2""")
def term_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Non-overlapping occurrences of a question's terms."""
    return state.mentions(_asks(spark, sf), A.plain_docs(spark, sf)).select("query_id", "doc_ord", "term_hits")


@query(f"WITH {X.DOCS}, r AS (SELECT *, row_number() OVER (ORDER BY modified DESC, doc_ord) AS rank FROM docs) SELECT doc_ord, rank FROM r WHERE rank <= 10")
def browse_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest ten, as a top-k report."""
    return A.plain_docs(spark, sf).orderBy(F.desc("modified"), "doc_ord").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("modified"), "doc_ord"))).select("doc_ord", "rank")


_EX = f"""WITH {X.TURNS}, n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY ix) AS n FROM turns),
ex AS (SELECT session_id, n, arg_min(text, ix) AS ask, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ix) FILTER (role = 'assistant'), '') AS reply, arg_min(ts, ix) AS ts, max(ts) AS end_ts, count(*) AS turns FROM n WHERE n > 0 GROUP BY 1, 2),
named AS (SELECT *, 'x-' || left(session_id, 8) || '-' || strftime(ts, '%Y%m%dT%H%M%S') || '000Z' AS name FROM ex)"""


@query(f"{_EX} SELECT name, session_id, n, turns, md5(ask) AS ask, md5(reply) AS reply, epoch_ms(end_ts) AS end_ms FROM named")
def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as exchanges."""
    ex = capture.exchanges(A.turns(spark, sf))
    return ex.select("name", "session_id", "n", "turns", F.md5("ask").alias("ask"), F.md5("reply").alias("reply"), F.unix_millis("end_ts").alias("end_ms"))


@query(f"{_EX} SELECT name, lag(name) OVER (PARTITION BY session_id ORDER BY n) AS previous FROM named")
def prev_link(spark: SparkSession, sf: str) -> DataFrame:
    """W07"""
    return capture.exchanges(A.turns(spark, sf)).select("name", "previous")


def _exchange_docs(spark: SparkSession, sf: str) -> DataFrame:
    ex = capture.render(capture.exchanges(A.turns(spark, sf)))
    return ex.select(F.lit("staging").alias("corpus"), (F.col("session_id").cast("long") * 1000 + F.col("n")).alias("doc_ord"), "session_id", "name", "description", "body", "ts", F.col("name").alias("file"), F.lit(None).cast("string").alias("session_title"), F.lit(None).cast("string").alias("account"), F.lit(None).cast("string").alias("project"), F.lit(False).alias("in_flight"))


@query(f"{_EX} SELECT session_id, count(*) AS \"count\", epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms, arg_max(name, ts) AS last_exchange, left(session_id, 8) AS sid8 FROM named GROUP BY 1")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """R10, A13"""
    return state.sessions(_exchange_docs(spark, sf)).select("session_id", "count", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"), "last_exchange", "sid8")


@query(f"{_EX} SELECT name, row_number() OVER w AS position, count(*) OVER (PARTITION BY session_id) AS total, last_value(name) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS thread_last FROM named WINDOW w AS (PARTITION BY session_id ORDER BY ts, name)")
def thread_position(spark: SparkSession, sf: str) -> DataFrame:
    """W01"""
    return state.thread_positions(_exchange_docs(spark, sf)).select("name", "position", "total", "thread_last")


@query(f"""{_EX}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, name) AS position FROM named)
SELECT a.name AS anchor, b.name, b.position - a.position AS "offset", a.name = b.name AS is_anchor FROM p a JOIN p b ON a.session_id = b.session_id AND b.position BETWEEN a.position - 1 AND a.position + 2""")
def thread_window(spark: SparkSession, sf: str) -> DataFrame:
    """One back and two forward of every exchange."""
    d = _exchange_docs(spark, sf)
    return state.thread(d.select("name"), d, forward=2, back=1).select("anchor", "name", "offset", "is_anchor")


_SAID = "CASE WHEN ix > 0 THEN text WHEN session_id % 5 = 1 THEN '<system-reminder> ' || text WHEN session_id % 5 = 2 THEN 'Mail  bob@acme.com ' || text WHEN session_id % 5 = 3 THEN 'Ask ann@gmail.com, ' || text WHEN session_id % 5 = 4 THEN '  Caveat: ' || text ELSE text END"


@query(rf"""WITH {X.TURNS}, s AS (SELECT session_id, ix, trim(regexp_replace({_SAID.replace('session_id %', 'session_id::BIGINT %')}, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM turns WHERE role = 'user'),
f AS (SELECT session_id, arg_min(t, ix) AS t FROM s WHERE t <> '' AND NOT contains(t, '<system-reminder>') AND NOT starts_with(t, 'Caveat:') GROUP BY 1)
SELECT session_id, trim(left(regexp_split_to_array(replace(replace(t, 'bob@acme.com', '[email@acme.com]'), 'ann@gmail.com', '[email]'), '[.?!\n]')[1], 80)) AS session_title FROM f""")
def session_titles(spark: SparkSession, sf: str) -> DataFrame:
    """First turns with a system mark, an address or a caveat by rule."""
    return capture.session_titles(A.turns(spark, sf).withColumn("text", F.expr(_SAID)))


_COMMITS = "c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), x AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click')"


@query(f"""WITH {_COMMITS}, e AS (SELECT user_id, max(ts) AS last FROM x GROUP BY 1),
j AS (SELECT c.user_id, c.event_id AS sha, c.ts AS ts, arg_max(x.event_id::VARCHAR, (x.ts, x.event_id::VARCHAR)) AS exchange FROM c JOIN x ON x.user_id = c.user_id AND x.ts <= c.ts JOIN e ON e.user_id = c.user_id AND c.ts <= e.last + INTERVAL 30 MINUTE GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, exchange ORDER BY ts, sha::VARCHAR) AS n FROM j) SELECT user_id, exchange, sha::VARCHAR AS sha FROM r WHERE n <= 12""")
def commit_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with the user's last click by then, clicks standing for exchanges."""
    e = A.table(spark, sf, "events")
    x = e.where("event_type = 'click'").select("user_id", F.col("event_id").cast("string").alias("name"), "ts")
    c = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").cast("string").alias("sha"), F.col("ts").alias("at"))
    return capture.commits_to_exchanges(x, c, ["user_id"]).select("user_id", "exchange", "sha")


@query("""SELECT w.event_id AS window_id, c.event_id AS sha FROM events w JOIN events c ON c.user_id = w.user_id AND c.event_type = 'purchase' AND c.ts BETWEEN w.ts AND w.ts + INTERVAL 1 DAY WHERE w.event_type = 'signup'""")
def interval_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases of the user within a day of each signup."""
    e = A.table(spark, sf, "events")
    w = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("window_id"), F.col("ts").alias("first"), (F.col("ts") + F.expr("interval 1 day")).alias("stop"))
    c = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("sha"), F.col("ts").alias("at"))
    return commits.in_windows(w, c, ["user_id"]).select("window_id", "sha")


@query("WITH r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM documents) SELECT doc_id AS doc_ord FROM r WHERE n > 1")
def dup_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated bodies of a source."""
    return capture.duplicate_bodies(A.plain_docs(spark, sf), key="project").select("doc_ord")


_LATE = "ts + INTERVAL (event_id % 5 * 2) DAY"


@query(f"WITH e AS (SELECT event_id, user_id, {_LATE} AS ts FROM events), r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e) SELECT event_id, a AS by_name, b AS by_time FROM r WHERE a <> b")
def order_check(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose place by id is not their place by time, users standing for sessions; times are moved by rule."""
    late = F.col("ts") + F.make_dt_interval((F.col("event_id") % 5 * 2).cast("int"))
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("name"), late.alias("ts"))
    return capture.order_faults(e).select(F.col("name").alias("event_id"), "by_name", "by_time")


@query(rf"""WITH {X.TURNS} SELECT session_id, ix, coalesce(text, '') = '' OR contains(text, '<system-reminder>') OR contains(text, '<task-notification>') OR regexp_matches(text, '^\s*<cross-session-message\b') OR starts_with(text, '[SYSTEM NOTIFICATION') OR starts_with(text, 'Caveat: The messages below') OR regexp_matches(text, '^<(command-name|local-command|command-message|bash-input|bash-stdout)')
 OR length(array_to_string(regexp_extract_all(text, '</?[A-Za-z][A-Za-z0-9-]*>'), '')) > 0.15 * length(text) AS machine FROM turns""")
def machine_turns(spark: SparkSession, sf: str) -> DataFrame:
    """F07"""
    return A.turns(spark, sf).select("session_id", "ix", capture.is_machine(F.col("text")).alias("machine"))


@query(rf"""{_EX}, s AS (SELECT name, ask, left(reply, 150) AS reply FROM named)
SELECT name, length(reply) < 200 AND NOT (length(reply) > 0 AND length(ask) >= 40 AND (regexp_matches(ask, '\b[A-Z]{{2,}}-\d{{2,}}\b') OR len(list_filter(regexp_extract_all(ask, '\b[0-9a-f]{{7,40}}\b'), lambda h: regexp_matches(h, '\d'))) > 0
 OR regexp_matches(ask, '\b\d{{4,}}\b') OR regexp_matches(ask, 'https?://\S+') OR regexp_matches(ask, '(^|[\s"''(<])[~.]?/[\w.+-]+(/[\w.+-]+)+') OR regexp_matches(ask, '\b[\w.+-]+\.(js|mjs|cjs|ts|json|jsonl|md|sh|zsh|py|yml|yaml|html|css|xlsx|csv|txt|log|zip)\b'))) AS empty FROM s""")
def factless_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """exchanges whose replies are cut short by rule."""
    ex = capture.exchanges(A.turns(spark, sf))
    return ex.select("name", capture.carries_no_fact(F.col("ask"), F.substring("reply", 1, 150)).alias("empty"))
