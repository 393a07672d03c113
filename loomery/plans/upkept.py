"""Registered queries of corrections, renaming and written files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomery.config import CONFIG, STOP_WORDS
from loomery.functions import text as T
from loomery.operators import curate, filewrites, postings, ranking, renames
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


# Corrections -----------------------------------------------------------------------------------

_SAYS = """CASE doc_id % 5 WHEN 0 THEN '. I was wrong about ' || {six} || '. Go on.' WHEN 1 THEN '. I misread it, but the memory says so. Fine.' WHEN 2 THEN '. I owe you a correction, let me check the log first. Fine.' WHEN 3 THEN '. Your token is wrong.' ELSE '' END"""
_BODY = "'**Asked:** about it' || chr(10) || chr(10) || coalesce({t}, '') || " + _SAYS.replace("doc_id", "{d}")
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FIXED = X.DOCS.replace("d.text AS body", _BODY.format(t="d.text", d="d.doc_id", six=X.first_words("d.text", 6)) + " AS body")
_PHRASE, _CONFIRMS, _PREAMBLE = (p.replace("'", "''") for p in (curate.CORRECTION, curate.CONFIRMS, curate.PREAMBLE))
_CLAIMS = f"""h AS (SELECT *, substr(body, 22) AS h FROM docs), p AS (SELECT *, regexp_extract(h, '(?i){_PHRASE}', 0) AS ph FROM h),
loc AS (SELECT *, strpos(lower(h), lower(ph)) AS loc FROM p WHERE ph <> ''),
st AS (SELECT *, loc - 1 - length(list_last(string_split(left(h, loc - 1), '.'))) AS start, strpos(substr(h, loc + length(ph)), '.') AS stop FROM loc),
cl AS (SELECT *, substr(h, start + 1, least(CASE WHEN stop > 0 THEN loc + length(ph) + stop - 1 ELSE least(length(h), loc - 1 + 260) + 1 END - start, 400)) AS claim FROM st),
claims AS (SELECT *, list_distinct(list_filter(regexp_extract_all(replace(lower(claim), lower(ph), ' '), '[a-z][a-z0-9_.-]{{3,}}'), lambda t: t NOT IN ({_STOPS}))) AS terms FROM cl WHERE NOT regexp_matches(claim, '(?i){_CONFIRMS}') AND NOT regexp_matches(claim, '(?i){_PREAMBLE}'))"""


def _corrected(spark: SparkSession, sf: str) -> DataFrame:
    """docs as exchanges: every fifth withdraws its first words, others confirm, announce, blame or say nothing."""
    d = A.docs(spark, sf)
    body = F.col("body")
    says = F.expr(_SAYS.format(six="six").replace("doc_id", "doc_ord").replace("||", "||"))
    return d.withColumn("six", T.first_words(body, 6)).withColumn("body", F.concat(F.lit("**Asked:** about it\n\n"), F.coalesce(body, F.lit("")), says)).drop("six")


@query(f"WITH {_FIXED}, {_CLAIMS} SELECT doc_ord, ph AS phrase, claim, array_to_string(list_sort(terms), ' ') AS terms FROM claims")
def withdrawn_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences that withdraw something, with their terms; blame, confirmation and announcement are none."""
    c = curate.claims(_corrected(spark, sf).withColumn("query_id", F.col("doc_ord")))
    return c.select("doc_ord", "phrase", "claim", F.array_join(F.array_sort("claim_terms"), " ").alias("terms"))


@query(f"""WITH {X.POSTINGS.replace(X.DOCS, _FIXED)}, {_CLAIMS},
qterms AS (SELECT DISTINCT doc_ord AS query_id, unnest({X.tokens("description || ' ' || left(body, 300)")}) AS term FROM claims),
raw AS (SELECT query_id, doc_ord, sum(idf * w * 2.2 / (1.2 + w)) AS raw FROM (
 SELECT q.query_id, p.doc_ord, i.idf, tft / (0.25 + 0.75 * lt / mt) + tfb / (0.25 + 0.75 * lb / mb) AS w FROM qterms q JOIN post p USING (term) JOIN idf i USING (term) JOIN lens USING (doc_ord), stats) GROUP BY 1, 2),
k AS (SELECT query_id, doc_ord, raw / max(raw) OVER (PARTITION BY query_id) AS kw FROM raw),
j AS (SELECT k.*, d.name, d.tier, d.modified, kw * (CASE WHEN tier = 'archive' THEN 1.0 ELSE 1.15 END) * (0.85 + 0.15 * exp(-greatest(0, (1719792000000 - epoch_ms(modified)) / 86400000.0) / 180)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(kw, 9) DESC, doc_ord) AS pass1 FROM k JOIN docs d USING (doc_ord)),
a AS (SELECT *, sum((tier = 'archive')::INT) OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_ord ROWS UNBOUNDED PRECEDING) AS seen FROM j WHERE pass1 <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (tier = 'archive' AND seen > 1), round(score, 9) DESC, doc_ord) AS rank FROM a),
f AS (SELECT r.query_id, r.doc_ord, r.name, round(r.score, 4) AS score, r.modified, c.modified AS said, c.name AS "by", c.terms, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) AS n FROM r JOIN claims c ON c.doc_ord = r.query_id WHERE rank <= 3 AND round(r.score, 4) >= 0.2 AND r.name <> c.name AND r.modified < c.modified),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY score DESC, query_id) AS best FROM f WHERE n = 1),
x AS (SELECT b.*, len(list_filter(terms, lambda t: contains(lower(d.body), t))) AS held FROM b JOIN docs d USING (doc_ord) WHERE best = 1)
SELECT doc_ord, name, "by", score, round((epoch_ms(said) - epoch_ms(modified)) / 86400000.0, 4) AS days, round(CASE WHEN len(terms) >= 3 THEN held / len(terms) ELSE 0 END, 4) AS share, held >= 3 AND len(terms) >= 3 AND held / len(terms) >= 0.34 AS passes FROM x""")
def superseded(spark: SparkSession, sf: str) -> DataFrame:
    """For each correction the first older hit of a search with it; of each older document the best correction."""
    d = _corrected(spark, sf)
    index = postings.build(d, shared.fresh_path(spark, "corrected"))
    claimed = shared.written(curate.claims(index.documents().withColumn("query_id", F.col("doc_ord"))), "claims")
    hits, _ = ranking.search(claimed.select("query_id", "query"), None, A.AS_OF, limit=3, index=index)
    out = curate.supersessions(claimed, hits, index.documents(), replace(CONFIG, supersede_score=0.2))
    return out.select("doc_ord", "name", "by", "score", F.round("days", 4).alias("days"), F.round("share", 4).alias("share"), "passes")


# Renaming --------------------------------------------------------------------------------------

_PLACED = """e AS (SELECT doc_id, lower(printf('%08x', doc_id // 10)) AS sid8, 'session-' || (doc_id // 10) AS session_id, doc_id % 10 AS place, make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS ts, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, 'x-' || sid8 || '-' || lpad(place::VARCHAR, 4, '0') AS name, 'x-' || sid8 || '-' || lpad((place - 1)::VARCHAR, 4, '0') AS before FROM e)"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """documents as exchanges of ten a session, named by place, each with a quoted link and one to the exchange before."""
    d = A.table(spark, sf, "documents")
    sid8, place = F.lower(F.lpad(F.hex(F.floor(F.col("doc_id") / 10).cast("long")), 8, "0")), F.col("doc_id") % 10
    name = lambda k: F.concat(F.lit("x-"), sid8, F.lit("-"), F.lpad(k.cast("string"), 4, "0"))
    link = F.when(place > 0, F.concat(F.lit("\nPrevious: [["), name(place - 1), F.lit("]]"))).otherwise("")
    body = F.concat(F.lit("Previous: [["), name(place), F.lit("]]\n"), F.coalesce("text", F.lit("")), link)
    return d.select("doc_id", name(place).alias("name"), F.concat(F.lit("session-"), F.floor(F.col("doc_id") / 10).cast("string")).alias("session_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("ts"), body.alias("body"))


@query(f"""WITH {_PLACED}, m AS (SELECT *, 'x-' || sid8 || '-' || strftime(ts, '%Y%m%dT%H%M%S') || '000Z' AS new_name FROM n),
l AS (SELECT m.*, p.new_name AS target FROM m LEFT JOIN m p ON p.name = m.before AND m.place > 0)
SELECT doc_id, new_name AS name, md5(CASE WHEN target IS NULL THEN CASE WHEN place > 0 THEN 'Previous: [[' || name || ']]' || chr(10) || text || chr(10) || 'Previous: [[' || before || ']]' ELSE 'Previous: [[' || new_name || ']]' || chr(10) || text END
 ELSE 'Previous: [[' || name || ']]' || chr(10) || text || chr(10) || 'Previous: [[' || target || ']]' END) AS body FROM l""")
def renamed_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Names by time, and the last Previous line of each exchange with them; quoted ones before it stay."""
    d = _placed(spark, sf)
    return renames.apply(d, *renames.plan(d)).select("doc_id", "name", F.md5("body").alias("body"))


@query(f"""WITH {_PLACED}, b AS (SELECT doc_id, name, sid8, place, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE session_id END AS session_id,
 CASE WHEN doc_id % 60 = 14 THEN NULL WHEN doc_id % 70 = 23 THEN ts - INTERVAL 1 HOUR WHEN doc_id % 90 = 36 THEN ts - INTERVAL 150 MINUTE ELSE ts END AS ts FROM n),
m AS (SELECT *, CASE WHEN session_id IS NOT NULL AND ts IS NOT NULL THEN 'x-' || sid8 || '-' || strftime(ts, '%Y%m%dT%H%M%S') || '000Z' END AS new_name FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY sid8, session_id ORDER BY place, name) AS a, row_number() OVER (PARTITION BY sid8, session_id ORDER BY new_name, place, name) AS z FROM m WHERE new_name IS NOT NULL),
held AS (SELECT 'x-' || sid8 || '-' || strftime(ts, '%Y%m%dT%H%M%S') || '000Z' AS new_name FROM n WHERE doc_id % 40 = 9)
SELECT name, 'no session' AS problem FROM m WHERE session_id IS NULL UNION ALL SELECT name, 'no time' FROM m WHERE session_id IS NOT NULL AND ts IS NULL
UNION ALL SELECT name, 'name is taken' FROM m WHERE new_name IN (SELECT new_name FROM held) UNION ALL SELECT name, 'name for several' FROM m WHERE new_name IN (SELECT new_name FROM m GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT arg_min(name, a), 'order changes' FROM o WHERE a <> z GROUP BY sid8, session_id""")
def rename_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What forbids renaming: no session, no time, names that are taken or meant for several, an order that would change."""
    d, k = _placed(spark, sf), F.col("doc_id")
    ts = F.when(k % 60 == 14, None).when(k % 70 == 23, F.col("ts") - F.expr("interval 1 hour")).when(k % 90 == 36, F.col("ts") - F.expr("interval 150 minutes")).otherwise(F.col("ts"))
    held = renames.plan(d)[0].join(d.where(k % 40 == 9).select("name"), "name", "left_semi").select(F.col("new_name").alias("name"))
    dirty = d.withColumn("ts", ts).withColumn("session_id", F.when(k % 50 != 7, F.col("session_id")))
    return renames.plan(dirty.unionByName(held, allowMissingColumns=True))[1]


# Written files ---------------------------------------------------------------------------------

_MADE = """c AS (SELECT conv_id, turn, role, text, '/srv/app/module-' || conv_id || '-' || turn || '.py' AS own, '/srv/' || (turn % 3) || '/shared_names.md' AS twice FROM conversations),
w AS (SELECT conv_id, CASE turn % 4 WHEN 1 THEN own ELSE twice END AS path FROM c WHERE role = 'assistant' AND turn % 4 IN (1, 3)),
f AS (SELECT DISTINCT conv_id, path FROM w), u AS (SELECT conv_id, list_last(string_split(path, '/')) AS base, count(*) AS n, min(path) AS path FROM f GROUP BY 1, 2),
prose AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn % 4 = 2 AND conv_id % 2 = 0 THEN coalesce(text, '') || ' (see module-' || conv_id || '-' || (turn - 1) || '.py)' WHEN role = 'user' AND conv_id % 3 = 0 THEN coalesce(text, '') || ' in /srv/0/shared_names.md' ELSE trim(coalesce(text, '')) END AS p FROM c)"""


def _tooled(spark: SparkSession, sf: str) -> DataFrame:
    """conversations whose assistant turns are JSON blocks with tool calls, by turn, and whose users name some of the files."""
    c, t = A.table(spark, sf, "conversations"), F.col("turn")
    own = F.concat(F.lit("/srv/app/module-"), "conv_id", F.lit("-"), t, F.lit(".py"))
    twice = F.concat(F.lit("/srv/"), (t % 3).cast("string"), F.lit("/shared_names.md"))
    call = lambda name, path: F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(name).alias("name"), F.struct(path.alias("file_path"), F.lit(None).cast("string").alias("notebook_path")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<file_path:string,notebook_path:string>").alias("input"))
    tmp, read = call("Write", F.lit("/tmp/x.py")), call("Read", F.lit("/srv/app/read_only_file.py"))
    blocks = F.when(t % 4 == 1, F.array(said, call("Write", own), tmp)).when(t % 4 == 3, F.array(said, call("Edit", twice), read)).otherwise(F.array(said))
    user = F.when((t % 4 == 2) & (F.col("conv_id") % 2 == 0), F.concat(F.coalesce("text", F.lit("")), F.lit(" (see module-"), "conv_id", F.lit("-"), t - 1, F.lit(".py)"))).when(F.col("conv_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" in /srv/0/shared_names.md"))).otherwise(F.coalesce("text", F.lit("")))
    return c.select(F.col("conv_id").alias("session_id"), t.alias("ix"), "role", F.when(F.col("role") == "assistant", F.to_json(blocks)).otherwise(user).alias("content"))


@query(f"""WITH {_MADE}, t AS (SELECT conv_id, path, path AS term FROM f UNION ALL SELECT conv_id, path, base FROM u WHERE n = 1 AND length(base) >= 12),
named AS (SELECT DISTINCT t.conv_id, t.path FROM t JOIN prose USING (conv_id) WHERE contains(p, term)),
k AS (SELECT conv_id, count(*) AS files, count(*) FILTER (path LIKE '%.md') AS doc, count(*) FILTER (path LIKE '%.py') AS code FROM f GROUP BY 1)
SELECT conv_id AS session_id, (SELECT count(*) FROM c x WHERE x.conv_id = s.conv_id AND role = 'assistant' AND turn % 4 IN (1, 3)) + (SELECT count(*) FROM c x WHERE x.conv_id = s.conv_id AND role = 'assistant' AND turn % 4 = 1) AS tool_writes,
 coalesce(k.files, 0) AS files, coalesce(doc, 0) AS doc, coalesce(code, 0) AS code, (SELECT count(*) FROM named x WHERE x.conv_id = s.conv_id) AS named FROM (SELECT DISTINCT conv_id FROM c) s LEFT JOIN k USING (conv_id)""")
def written_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that tools wrote in a session, by kind, and how many its prose names by path or by a base name of its own."""
    return filewrites.measure(_tooled(spark, sf)).select("session_id", "tool_writes", "files", "doc", "code", "named")
