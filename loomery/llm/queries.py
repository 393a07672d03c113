"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .sparkutil import held_out, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4)
    net = langid.fit(docs.where(~held))
    return langid.predict(docs, net, keep=[F.col("doc_id"), held.alias("held_out")])


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs), keep=["doc_id"])
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op5_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    tokens = packing.encoded(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packing.pack(tokens, digests=True)


def op6_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op7_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ppm

    return ppm.score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7))


def op9_example_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 4)
    index = toxicity.fit(docs, labels.where(~held).select("doc_id", "toxic"))
    return toxicity.score(docs, index, keep=[F.col("doc_id"), held.alias("held_out")])


def op10_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep=["doc_id"], digests=True)


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some texts are made periodic first, by the rule of the query: word i of those comes from word a + (i - a) % p."""
    from . import periods

    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.withColumn("w", F.when(h % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    g, n = F.floor(h / 10), F.size("w").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    made = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    planted = words.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return periods.periodic_runs(planted, F.when(F.col("p").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")), keep=["doc_id"], digests=True)


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whiten

    return whiten.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sigtree

    return sigtree.join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_convnet": op1_byte_convnet,
    "op2_collision_counting": op2_collision_counting,
    "op3_deletion_variants": op3_deletion_variants,
    "op4_divergence_rules": op4_divergence_rules,
    "op5_shortest_pack_first": op5_shortest_pack_first,
    "op6_relative_lz": op6_relative_lz,
    "op7_warc_shards": op7_warc_shards,
    "op8_partial_matching": op8_partial_matching,
    "op9_example_votes": op9_example_votes,
    "op10_bpe_trie": op10_bpe_trie,
    "op11_tandem_runs": op11_tandem_runs,
    "op12_tsqr_whitening": op12_tsqr_whitening,
    "op13_signature_trees": op13_signature_trees,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_CLASSES = {"a": "[^a-z]", "b": "[^A-Z]", "c": "[^0-9]", "d": "[^.,;:!?''\"()-]", "e": "[^#*$%&|<>]", "f": r"[^\x21-\x7F]|[a-zA-Z0-9.,;:!?''\"()#*$%&|<>-]", "g": r"[\x00-\x7F]"}
_HALF = "CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END".format
#: Jensen-Shannon distances are summed over the words of a reference that a document has; each of the others adds its share.
_QUALITY = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM t),
v AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS v FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
x AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM v), (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY r),
b AS (SELECT r, doc_id, lang, w, len(w) AS n, length(array_to_string(w, '')) AS chars, {', '.join(f"length(regexp_replace(text, '{p}', '', 'g'))::DOUBLE AS {c}" for c, p in _CLASSES.items())},
 len(l) - len(list_distinct(l)) AS dup, coalesce(x.n, 0) AS rep FROM t JOIN l USING (r) LEFT JOIN x USING (r)),
o AS (SELECT *, n < 10 OR 100 * rep > 20 * n AS failed, a + b + c + d + e + f + g AS sum FROM b),
h AS (SELECT lang, sum(n) AS words, count(*) AS docs, {', '.join(f"sum({c}) AS {c}" for c in _CLASSES)}, sum(sum) AS sum FROM o WHERE NOT failed AND lang IS NOT NULL GROUP BY 1),
j AS (SELECT * FROM h WHERE docs >= 0.001 * (SELECT sum(docs) FROM h) AND sum > 0),
q AS (SELECT lang, u.w, count(*) / any_value(j.words) AS q FROM (SELECT lang, unnest(w) AS w FROM o WHERE NOT failed AND lang IS NOT NULL) u JOIN j USING (lang) GROUP BY 1, 2 HAVING count(*) >= 0.002 * any_value(j.words)),
z AS (SELECT j.lang, coalesce(sum(q), 0) AS known, greatest(0, 1 - coalesce(sum(q), 0)) AS rest FROM j LEFT JOIN q USING (lang) GROUP BY 1),
c AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(w) AS w FROM o) GROUP BY 1, 2),
s AS (SELECT r, lang, sum({_HALF(p='(c / n)', q='q')}) AS js, sum(q) AS q, sum(c) / any_value(n) AS p FROM c JOIN q USING (w) JOIN (SELECT r, n FROM o) USING (r) GROUP BY 1, 2),
k AS (SELECT o.r, j.lang, sqrt(least(1, greatest(0, ({' + '.join(_HALF(p=f'(o.{c} / greatest(1, o.sum))', q=f'(j.{c} / j.sum)') for c in _CLASSES)}) / 2))) AS by_class,
 sqrt(least(1, greatest(0, (coalesce(s.js, 0) + z.known - coalesce(s.q, 0) + {_HALF(p='(CASE WHEN n = 0 THEN 0 ELSE greatest(0, 1 - coalesce(s.p, 0)) END)', q='z.rest')}) / 2))) AS by_word
 FROM o CROSS JOIN j JOIN z ON z.lang = j.lang LEFT JOIN s ON s.r = o.r AND s.lang = j.lang),
m AS (SELECT r, first(struct_pack(lang := lang, c := by_class, w := by_word) ORDER BY by_class + by_word, lang) AS m FROM k GROUP BY r)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, e::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, failed AS base_failed,
 NOT failed AND NOT (n >= 50 AND m.m.lang IS NOT NULL AND (m.m.c > 0.30 OR m.m.w > 0.55 OR m.m.c + m.m.w > 0.57)) AS kept,
 round(coalesce(m.m.c, 0), 6) AS class_distance, round(coalesce(m.m.w, 0), 6) AS word_distance, m.m.lang AS nearest_lang FROM o LEFT JOIN m USING (r)"""

_SUBSTRING = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
g AS (SELECT DISTINCT h.doc_id, unnest(range(i, i + 50)) AS pos FROM h JOIN f USING (h) WHERE first < h.doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
k AS (SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL) AS kept FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_NIBBLES = ", ".join(f"'{n:04b}'" for n in range(16))
_FIVE = " + ".join(f"(substr(bits, i * 5 + {k + 1}, 1) = '1')::INT * {16 >> k}" for k in range(5))
_WARC = f"""WITH s AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda c: [{_NIBBLES}][strpos('0123456789abcdef', c)]), '') AS bits, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS best FROM s)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
 CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM b"""

_CRC = "list_reduce([4294967295] || list_reverse(flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: [-1, -1, -1, -1, -1, -1, -1, -1, ascii(substr(reverse(CAST(doc_id AS VARCHAR)), i, 1))]))), lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"
#: A run of period q has at least max(6, 4 * q) - q words that equal the one q words on, so at least five in a row.
_RUNS = f"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w, xor({_CRC}::BIGINT, 4294967295) AS h FROM documents),
u AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
v AS (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM u),
f AS (SELECT k, i, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS f FROM (SELECT k, w, unnest(range(0, n - 4)) AS i FROM v WHERE n >= 6)),
r AS (SELECT * FROM f SEMI JOIN (SELECT k, f FROM f GROUP BY ALL HAVING count(*) > 1) USING (k, f)),
e AS (SELECT x.k, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.k, y.i - x.i ORDER BY x.i) AS isle FROM r x JOIN r y ON x.k = y.k AND x.f = y.f AND x.i < y.i),
s AS (SELECT k, q, min(i) AS start, count(*) + 4 + q AS length FROM e GROUP BY k, q, isle HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
z AS (SELECT k, start, length, min(q) AS period FROM s GROUP BY k, start, length),
b AS (SELECT k, count(*) AS n_runs, first(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM z GROUP BY k),
d AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM z),
c AS (SELECT k, string_agg(w, ' ' ORDER BY i) AS kept FROM (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM v) ANTI JOIN d USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM v LEFT JOIN b USING (k) LEFT JOIN c USING (k)"""

_LOWER = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_ALIKE = f"""WITH RECURSIVE w AS (SELECT doc_id, {_LOWER} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS s FROM s),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.s = y.s AND x.doc_id <> y.doc_id AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id FROM s JOIN (SELECT a, min(root) AS root FROM r GROUP BY a) ON a = doc_id"""

#: The other operators hold trained models, XXH64 or tokenizers, which SQL lacks: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_divergence_rules": _QUALITY,
    "op6_relative_lz": _SUBSTRING,
    "op7_warc_shards": _WARC,
    "op11_tandem_runs": _RUNS,
    "op13_signature_trees": _ALIKE,
}
