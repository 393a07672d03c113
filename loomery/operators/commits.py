"""Commits as tables, and the verdicts of probes on rows.

commits: (repo, repo_ord, sha, at, author, subject, on_mainline).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomery.functions import text as T


def in_windows(windows: DataFrame, commits: DataFrame, key: list[str], slot_seconds: int = 86_400) -> DataFrame:
    """Commits of each window (key..., window_id, first, stop), bounds included, by time, repo, sha.

    The interval join is an equality join on time slots; a window takes one row a slot that it touches.
    """
    slot = lambda c: F.floor(F.unix_millis(F.col(c).cast("timestamp")) / (1000 * slot_seconds))
    w = windows.withColumn("_slot", F.explode(F.sequence(slot("first"), slot("stop"))))
    rows = w.join(commits.withColumn("_slot", slot("at")), [*key, "_slot"]).where("at between first and stop")
    return rows.drop("_slot")


def cited(docs: DataFrame, commits: DataFrame, per_doc: int = 12) -> DataFrame:
    """(doc_ord, token, sha, repo): hash-like tokens with the commit they begin, the first repo by order.

    A prefix join as equality joins: commits are keyed by every prefix length that a token may have (7 to 10).
    """
    tokens = docs.select("doc_ord", F.posexplode(T.sha_tokens(F.col("body"))).alias("pos", "token")).where(F.col("pos") < per_doc)
    keys = commits.select("repo", "repo_ord", "sha", "at", "on_mainline", "subject", F.explode(F.transform(F.sequence(F.lit(7), F.lit(10)), lambda n: F.substring("sha", F.lit(1), n))).alias("token"))
    w = Window.partitionBy("doc_ord", "token").orderBy("repo_ord", "sha")
    rows = tokens.join(keys, "token").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows.select("doc_ord", "pos", "token", "sha", "repo", "at", "on_mainline", "subject")


#: Names that only code has: constants, flags, paths of files. Fixed values.
CODE_NAMES = (r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b", r"--[a-z][a-z0-9-]{2,}\b", r"\b[\w.-]+/[\w./-]+\.[a-z]{2,4}\b")


def identifiers(text: Column) -> Column:
    """Code-like names, distinct, shape by shape in order."""
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(T.edged(p)), F.lit(0)) for p in CODE_NAMES])))


def known_identifiers(docs: DataFrame, code_tokens: DataFrame) -> DataFrame:
    """(doc_ord, identifier, found): whether the code has them."""
    rows = docs.select("doc_ord", F.explode(identifiers(F.col("body"))).alias("identifier"))
    return rows.join(code_tokens.select(F.col("token").alias("identifier")).distinct().withColumn("_f", F.lit(True)), "identifier", "left").select("doc_ord", "identifier", F.coalesce("_f", F.lit(False)).alias("found"))


def currency(newest: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits of each repo since the newest exchange. newest: one row with ``ts``."""
    rows = commits.join(F.broadcast(newest.select(F.col("ts").alias("_ts"))))
    return rows.groupBy("repo").agg(F.count(F.when(F.col("at") > F.col("_ts"), 1)).alias("since"), F.max("at").alias("last_commit"))


def surface_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Probe verdicts on result rows, by name, else by the name before #."""
    v = verdicts.groupBy("corpus", "name").agg(F.min("verdict").alias("verdict"))
    own = v.select("corpus", "name", F.col("verdict").alias("_own"))
    parent = v.select("corpus", F.col("name").alias("_parent"), F.col("verdict").alias("_up"))
    return rows.withColumn("_parent", F.substring_index("name", "#", 1)).join(own, ["corpus", "name"], "left").join(parent, ["corpus", "_parent"], "left").withColumn("probe_verdict", F.coalesce("_own", "_up")).drop("_own", "_up", "_parent")
