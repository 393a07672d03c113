"""Query-log analytics.

log: (seq, ts, query_id, q, failed, fail_kind, mode, src, run_id, benchmark). seq breaks ties of ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomery.config import CONFIG, EngineConfig
from loomery.functions import text as T


def is_suite() -> Column:
    """F12"""
    return F.coalesce(F.col("src").isin("test", "unknown"), F.lit(False)) | F.coalesce(F.col("run_id").startswith("suite-"), F.lit(False))


def flag_benchmark(log: DataFrame, questions: DataFrame) -> DataFrame:
    """exact membership of the lower-cased query among the benchmark's."""
    known = questions.select(F.lower("text").alias("_q")).distinct().withColumn("benchmark", F.lit(True))
    return log.drop("benchmark").join(known, F.lower("q") == F.col("_q"), "left").drop("_q").fillna(False, ["benchmark"])


def caller_misses(log: DataFrame) -> DataFrame:
    """Per caller (query id, else the query itself): calls, and whether every one failed."""
    live = log.where(~is_suite() & ~F.coalesce("benchmark", F.lit(False)) & F.coalesce(F.col("src") != "canary", F.lit(True)))
    key = F.coalesce(F.col("query_id").cast("string"), F.lower("q")).alias("caller")
    return live.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.every("failed").alias("missed"), F.every(F.coalesce(F.col("fail_kind") == "scope_empty", F.lit(False))).alias("scope_empty_only"))


def failure_shapes(log: DataFrame) -> DataFrame:
    """Failed queries by their sorted distinct terms."""
    key = F.array_join(F.array_sort(F.array_distinct(T.tokenize(F.col("q")))), " ")
    return log.where("failed").groupBy(key.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("q").alias("wordings"))


def dead_terms(log: DataFrame, least: int = 3) -> DataFrame:
    """Terms of at least three failures and no success."""
    rows = log.select("failed", F.explode(F.array_distinct(T.tokenize(F.col("q")))).alias("term"))
    n = rows.groupBy("term").agg(F.count(F.when(F.col("failed"), 1)).alias("fails"), F.count(F.when(~F.col("failed"), 1)).alias("wins"))
    return n.where((F.col("fails") >= least) & (F.col("wins") == 0)).select("term", "fails")


def mode_split(log: DataFrame) -> DataFrame:
    """Share of each mode in percent."""
    n = log.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))  # a row a mode


def retries(log: DataFrame, terms: Column, key: str, seconds: int = CONFIG.retry_seconds) -> DataFrame:
    """Each failure of a key with whether a later call within ``seconds`` shares a term, and whether such a
    call, before or at the first success, succeeded.

    The interval join is an equality join on time slots of ``seconds``: a failure looks in its own and the next.
    """
    rows = log.select(key, "seq", "ts", "failed", terms.alias("terms"))
    slot = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / (1000 * seconds))
    fails = rows.where("failed").select(key, F.col("seq").alias("fail_seq"), F.col("ts").alias("fail_ts"), F.col("terms").alias("fail_terms"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    later = rows.select(key, "seq", "ts", "failed", "terms", slot.alias("slot"))
    pairs = fails.join(later, [key, "slot"]).where((F.struct("ts", "seq") > F.struct("fail_ts", "fail_seq")) & (F.col("ts") <= F.col("fail_ts") + F.expr(f"interval {seconds} seconds")) & F.arrays_overlap("terms", "fail_terms"))
    found = pairs.groupBy(key, "fail_seq").agg(F.count(F.lit(1)).alias("n"), F.some(~F.col("failed")).alias("recovered"))
    base = rows.where("failed").select(key, F.col("seq").alias("fail_seq"))
    return base.join(found, [key, "fail_seq"], "left").select(key, "fail_seq", F.coalesce("n", F.lit(0)).alias("later_calls"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("retried"), F.coalesce("recovered", F.lit(False)).alias("recovered"))


def retrieval_telemetry(log: DataFrame, weak_below: float = CONFIG.absence_score) -> DataFrame:
    """Per document name: hits, best and worst rank, hits with a weak score. log has top: array of (name, score)."""
    rows = log.select(F.posexplode("top").alias("pos", "t"))
    return rows.groupBy("t.name").agg(F.count(F.lit(1)).alias("hits"), (F.min("pos") + 1).alias("best_rank"), (F.max("pos") + 1).alias("worst_rank"), F.count(F.when(F.col("t.score") < weak_below, 1)).alias("weak_hits"))


def never_retrieved(docs: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Documents with their telemetry, zero where there is none."""
    return docs.select("corpus", "doc_ord", "name").join(telemetry, "name", "left").fillna(0, ["hits", "weak_hits"])


def derived_floors(top_scores: DataFrame, base_corpus: str = "curated", least: int = 5, cfg: EngineConfig = CONFIG) -> DataFrame:
    """Floors of each corpus from the medians of its self-queries' top scores and coverages, relative to the base's."""
    m = top_scores.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.median("top_score").alias("score"), F.median("coverage").alias("coverage")).where(F.col("n") >= least)
    base = m.where(F.col("corpus") == base_corpus).select(F.col("score").alias("s0"), F.col("coverage").alias("c0"))
    rows = m.join(F.broadcast(base))  # the base is one row
    return rows.select("corpus", F.round(cfg.absence_score * F.col("score") / F.col("s0"), 4).alias("score_floor"), F.round(cfg.absence_coverage * F.col("coverage") / F.col("c0"), 4).alias("coverage_floor"))


#: Words of no use in a question about a text, besides those of three letters and fewer. Fixed values.
SELF_STOP = ("with", "that", "this", "from", "were", "have", "they", "their", "which", "what", "when", "there", "been", "would", "could", "into", "than", "then", "them")


def self_query(body: Column, n: int = 6, least: int = 24) -> Column:
    """N words from across a body, of letters and digits, over three long and no stop words, each once, as a
    question about it; null where there are fewer than ``least`` of them."""
    plain = F.regexp_replace(F.coalesce(body, F.lit("")), "[^A-Za-z0-9]+", " ")
    w = F.filter(F.split(plain, " "), lambda x: (F.length(x) > 3) & ~F.lower(x).isin(*SELF_STOP))
    picked = lambda v: F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(v, i * F.floor(F.size(v) / n).cast("int"))))
    return F.get(F.transform(F.array(w), lambda v: F.when(F.size(v) >= least, F.array_join(picked(v), " "))), F.lit(0))


def keyword_scale(tops: DataFrame, thresholds: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Of each population of queries, the share whose top raw / ideal reaches each threshold. tops: (population, ratio)."""
    return tops.select("population", "ratio", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).groupBy("population", "threshold").agg(F.avg((F.col("ratio") >= F.col("threshold")).cast("double")).alias("share"))


def floor_percentile(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """The value at floor(q * (n - 1)) of each key's sorted values."""
    w = Window.partitionBy(key)
    at = rows.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return at.where(F.col("_r") == F.floor(q * (F.col("_n") - 1)) + 1).select(key, value)
