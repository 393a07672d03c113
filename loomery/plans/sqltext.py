"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from loomery.config import STOP_WORDS

BLANK = r"[\x20\x09-\x0D]+"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({e}, ''), '{BLANK}'), lambda w: w <> '')"


def stem(t: str) -> str:
    n = f"length({t})"
    return (
        f"CASE WHEN NOT regexp_full_match({t}, '[a-z]{{5,}}') THEN {t} WHEN {t} LIKE '%ies' AND {n} > 5 THEN left({t}, {n} - 3) || 'y' "
        f"WHEN {t} LIKE '%sses' OR {t} LIKE '%shes' OR {t} LIKE '%ches' THEN left({t}, {n} - 2) WHEN {t} LIKE '%ing' AND {n} > 6 THEN left({t}, {n} - 3) "
        f"WHEN {t} LIKE '%ed' AND {n} > 5 THEN left({t}, {n} - 2) WHEN {t} LIKE '%es' AND {n} > 5 THEN left({t}, {n} - 1) "
        f"WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, {n} - 1) ELSE {t} END"
    )


def tokens(e: str) -> str:
    plain = f"regexp_replace(lower(coalesce({e}, '')), '[`*_~>#|]', ' ', 'g')"
    compounds = f"list_filter(list_transform(regexp_split_to_array({plain}, '[^a-z0-9.+/\\-]+'), lambda c: regexp_replace(c, '^[.\\-/+]+|[.\\-/+]+$', '', 'g')), lambda c: c <> '')"
    parts = "list_filter(regexp_split_to_array(d, '[.\\-/]'), lambda p: length(p) > 1)"
    spread = f"flatten(list_transform({compounds}, lambda d: CASE WHEN len({parts}) > 1 THEN list_concat([d], {parts}) ELSE [d] END))"
    stops = ", ".join(f"'{s}'" for s in STOP_WORDS)
    return f"list_transform(list_filter({spread}, lambda t: length(t) > 1 AND t NOT IN ({stops})), lambda u: {stem('u')})"


def first_words(e: str, n: int) -> str:
    return f"array_to_string(({words(e)})[1:{n}], ' ')"


#: documents as the engine's docs.
DOCS = f"""docs AS (SELECT 'curated' AS corpus, d.doc_id AS doc_ord, 'doc-' || d.doc_id AS name, 'doc-' || d.doc_id AS file,
 {first_words('d.text', 12)} AS description, lang AS account, source AS project, CASE WHEN q.quality = 0 THEN 'archive' ELSE 'hot' END AS tier,
 make_timestamp((1704067200 + d.doc_id * 3600) * 1000000) AS modified, d.text AS body
 FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) q USING (doc_id))"""

QUERY_TERMS = f"qterms AS (SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark)"

POSTINGS = f"""{DOCS},
toks AS (SELECT doc_ord, list_concat({tokens("replace(replace(name, '-', ' '), '_', ' ')")}, {tokens('name')}) AS n, {tokens('description')} AS de, {tokens('body')} AS b FROM docs),
lens AS (SELECT doc_ord, len(n) * 3.0 + len(de) * 2.0 AS lt, len(b) * 0.3 AS lb FROM toks),
stats AS (SELECT count(*) AS nd, CASE WHEN avg(lt) = 0 THEN 1 ELSE avg(lt) END AS mt, CASE WHEN avg(lb) = 0 THEN 1 ELSE avg(lb) END AS mb FROM lens),
post AS (SELECT doc_ord, term, sum(CASE WHEN g = 't' THEN w ELSE 0 END) AS tft, sum(CASE WHEN g = 'b' THEN w ELSE 0 END) AS tfb FROM (
 SELECT doc_ord, unnest(n) AS term, 't' AS g, 3.0::DOUBLE AS w FROM toks UNION ALL SELECT doc_ord, unnest(de), 't', 2.0 FROM toks UNION ALL SELECT doc_ord, unnest(b), 'b', 0.3 FROM toks) GROUP BY 1, 2),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(nd) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, stats GROUP BY term)"""

RAW = f"""{POSTINGS}, {QUERY_TERMS},
raw AS (SELECT query_id, doc_ord, sum(idf * w * 2.2 / (1.2 + w)) AS raw FROM (
 SELECT q.query_id, p.doc_ord, i.idf, tft / (0.25 + 0.75 * lt / mt) + tfb / (0.25 + 0.75 * lb / mb) AS w
 FROM qterms q JOIN post p USING (term) JOIN idf i USING (term) JOIN lens USING (doc_ord), stats) GROUP BY 1, 2)"""

TURNS = "turns AS (SELECT conv_id::VARCHAR AS session_id, turn AS ix, role, text, make_timestamp((1704067200 + conv_id * 86400 + turn * 60) * 1000000) AS ts FROM conversations)"
