"""The engine's tables made from the plain test tables."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomery.functions import text as T
from loomery.operators import postings
from loomery.sources import shared

EPOCH = datetime(2024, 1, 1)
#: The instant that decays and ages are measured from.
AS_OF = datetime(2024, 7, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents (and labels) as a corpus of documents."""
    d = table(spark, sf_dir, "documents")
    low = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    name = F.concat(F.lit("doc-"), F.col("doc_id"))
    return d.join(low, "doc_id", "left").select(
        F.lit("curated").alias("corpus"), F.col("doc_id").alias("doc_ord"), name.alias("name"), name.alias("file"),
        T.first_words(F.col("text"), 12).alias("description"), F.col("lang").alias("account"), F.col("source").alias("project"),
        F.when(F.col("quality") == 0, "archive").otherwise("hot").alias("tier"), F.lit(False).alias("in_memory_index"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("modified"), F.lit(None).cast("string").alias("session_id"), F.col("text").alias("body"),
    )


def index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The index of docs: opened where this application has indexed these very files before, else built."""
    parts = [shared.fingerprint(table(spark, sf_dir, t)) for t in ("documents", "labels")]
    path = f"{shared.shared_dir(spark)}/loomery-index-{hashlib.sha256('|'.join([spark.sparkContext.applicationId, sf_dir, *parts]).encode()).hexdigest()[:24]}"
    return postings.Index.open(spark, path) or postings.build(docs(spark, sf_dir), path)


def plain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs without the tier, for questions that do not need labels: one scan."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id"))
    return d.select(F.lit("curated").alias("corpus"), F.col("doc_id").alias("doc_ord"), name.alias("name"), name.alias("file"), T.first_words(F.col("text"), 12).alias("description"), F.col("lang").alias("account"), F.col("source").alias("project"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("modified"), F.col("text").alias("body"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark passages as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as transcript turns, a day apart and a minute a turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ix"), "role", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 86400 + F.col("turn") * 60).alias("ts"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as library documents, their HTML as text."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.lit("library").alias("corpus"), F.col("page_id").alias("doc_ord"), F.concat(F.lit("page-"), F.col("page_id")).alias("name"), F.col("url").alias("file"), T.html_to_text(F.col("html")).alias("body"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a query log: errors are failures, the event type is the question."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("query_id"), F.col("event_type").alias("q"), (F.col("event_type") == "error").alias("failed"), F.lit(None).cast("string").alias("fail_kind"), F.when(F.col("value") > 50, "hybrid").otherwise("bm25-only").alias("mode"), F.lit("live").alias("src"), F.lit(None).cast("string").alias("run_id"), F.lit(False).alias("benchmark"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link from every document to another, by rule."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return d.join(F.broadcast(n)).select(F.lit("curated").alias("corpus"), F.col("doc_id").alias("src"), ((F.col("doc_id") * 7 + 1) % F.col("n")).alias("dst")).where("src <> dst")
