"""Registered queries of the persistent index: what it holds after updates is what a count of all documents gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomery.config import CONFIG
from loomery.operators import keyword, postings
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


def _grown(spark: SparkSession, sf: str) -> postings.Index:
    """An index that came to hold docs in three builds.

    First without every third document, with other texts for every fifth and with documents that go later; then with those, without others; then whole.
    """
    path, docs = shared.fresh_path(spark, "grown"), A.docs(spark, sf)
    other = F.when(F.col("doc_ord") % 5 == 0, F.concat(F.lit("early words "), F.col("description"))).otherwise(F.col("body"))
    early = docs.where("doc_ord % 3 <> 0").withColumn("body", other)
    leaving = docs.where("doc_ord % 11 = 0").withColumn("name", F.concat(F.lit("old-"), F.col("name"))).withColumn("file", F.col("name")).withColumn("doc_ord", -1 - F.col("doc_ord"))
    postings.build(early.unionByName(leaving), path)
    postings.build(docs.where("doc_ord % 4 <> 1").unionByName(leaving.where("doc_ord % 2 = 0")), path)
    return postings.build(docs, path)


@query(f"WITH {X.POSTINGS}, n AS (SELECT term, count(*) AS df, round(sum(tft + tfb), 4) AS weight FROM post GROUP BY term) SELECT term, df, weight, nd AS n_docs, round(mt, 4) AS avg_title, round(mb, 4) AS avg_body FROM n, stats")
def index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """K01, K02, ST11, D7, D8: frequencies, weights and averages of an index kept up by deltas."""
    index = _grown(spark, sf)
    weight = index.postings().groupBy("term").agg(F.round(F.sum(F.col("tf_title") + F.col("tf_body")), 4).alias("weight"))
    stats = index.stats().select("n_docs", F.round("avg_title", 4).alias("avg_title"), F.round("avg_body", 4).alias("avg_body"))
    return index.document_frequency().select("term", "df").join(weight, "term", "full_outer").join(F.broadcast(stats))


@query(f"""WITH {X.RAW}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_ord) AS rank FROM raw)
SELECT query_id, rank, doc_ord, round(raw, 4) AS raw FROM r WHERE rank <= 8""")
def index_incremental_topk(spark: SparkSession, sf: str) -> DataFrame:
    """ST11: rankings of an index kept up by deltas are those of one built at once."""
    q = A.questions(spark, sf)
    raw = keyword.best(_grown(spark, sf).prepare(q), CONFIG.limit)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 6)), "doc_ord")
    return raw.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= CONFIG.limit).select("query_id", "rank", "doc_ord", F.round("raw", 4).alias("raw"))


@query("""WITH a AS (SELECT 'doc-' || doc_id AS file, doc_id FROM documents),
early AS (SELECT file FROM a WHERE doc_id % 3 <> 0 UNION ALL SELECT 'old-' || file FROM a WHERE doc_id % 11 = 0),
late AS (SELECT file FROM a WHERE doc_id % 4 <> 1)
SELECT (SELECT count(*) FROM late) AS docs, (SELECT count(*) FROM late ANTI JOIN early USING (file)) AS added, (SELECT count(*) FROM early ANTI JOIN late USING (file)) AS removed,
 (SELECT count(*) FROM a WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 1 AND doc_id % 5 = 0) AS changed""")
def index_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What an update found added, removed and changed."""
    path, docs = shared.fresh_path(spark, "grown"), A.docs(spark, sf)
    other = F.when(F.col("doc_ord") % 5 == 0, F.concat(F.lit("early words "), F.coalesce("body", F.lit("")))).otherwise(F.col("body"))
    leaving = docs.where("doc_ord % 11 = 0").withColumn("name", F.concat(F.lit("old-"), F.col("name"))).withColumn("file", F.col("name")).withColumn("doc_ord", -1 - F.col("doc_ord"))
    postings.build(docs.where("doc_ord % 3 <> 0").withColumn("body", other).unionByName(leaving), path)
    m = postings.build(docs.where("doc_ord % 4 <> 1"), path).manifest
    return spark.createDataFrame([{k: m[k] for k in ("docs", "added", "removed", "changed")}], "docs long, added long, removed long, changed long")
