"""Capture: transcript turns to exchanges, commits to exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomery.config import CONFIG, EngineConfig
from loomery.functions import text as T
from loomery.functions.redact import redact, scrub_addresses

#: What shows that a turn is machinery: marks anywhere in it, and how it may begin. Fixed values.
MACHINE_MARKS = ("<system-reminder>", "<task-notification>")
MACHINE_STARTS = (
    r"^\s*<cross-session-message\b",
    r"^\[SYSTEM NOTIFICATION",
    r"^Caveat: The messages below",
    r"^<(command-name|local-command|command-message|bash-input|bash-stdout)",
)
#: What a later search can find a short exchange by: ticket, hash, number, address, path, file name. Fixed values.
IDENTIFIERS = (
    r"\b[A-Z]{2,}-\d{2,}\b",
    r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,40}\b",
    r"\b\d{4,}\b",
    r"https?://\S+",
    r"(?:^|[\s\"'(<])[~.]?/[\w.+-]+(?:/[\w.+-]+)+",
    r"\b[\w.+-]+\.(?:js|mjs|cjs|ts|json|jsonl|md|sh|zsh|py|yml|yaml|html|css|xlsx|csv|txt|log|zip)\b",
)


def is_machine(text: Column) -> Column:
    """no text, a marked turn, or one of which bare tags make up over 15 %."""
    t = F.coalesce(text, F.lit(""))
    tags = F.length(F.array_join(F.regexp_extract_all(t, F.lit(r"(</?[A-Za-z][A-Za-z0-9-]*>)"), F.lit(1)), ""))
    marked = t == ""
    for mark in MACHINE_MARKS:
        marked = marked | F.contains(t, F.lit(mark))
    for start in MACHINE_STARTS:
        marked = marked | t.rlike(T.edged(start))
    return marked | (tags > 0.15 * F.length(t))


def carries_identifier(text: Column) -> Column:
    found = F.lit(False)
    for pattern in IDENTIFIERS:
        found = found | F.coalesce(text, F.lit("")).rlike(T.edged(pattern))
    return found


def carries_no_fact(ask: Column, reply: Column, cfg: EngineConfig = CONFIG) -> Column:
    """a short reply, unless it answers a question of some length that names something definite."""
    a, r = F.coalesce(ask, F.lit("")), F.coalesce(reply, F.lit(""))
    return (F.length(r) < cfg.short_reply) & ~((F.length(r) > 0) & (F.length(a) >= cfg.short_ask) & carries_identifier(a))


def capturable(turns: DataFrame) -> DataFrame:
    """turns of sessions whose first user turn is not a scheduled task."""
    w = Window.partitionBy("session_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return turns.withColumn("_first", first).where("_first is null or not startswith(ltrim(_first), '<scheduled-task')").drop("_first")


def drop_repeated_interjections(turns: DataFrame) -> DataFrame:
    """An interjection that one of the next three human turns repeats is that turn, not one of its own."""
    human = (F.col("role") == "user") & ~is_machine(F.col("text"))
    w = Window.partitionBy("session_id", "_human").orderBy("ix").rowsBetween(1, 3)
    rows = turns.withColumn("_human", human).withColumn("_next", F.collect_list("text").over(w))
    return rows.where("not (coalesce(interjection, false) and array_contains(_next, text))").drop("_human", "_next")


def exchange_name(session_id: Column, ts: Column, n: Column) -> Column:
    """X-<first 8 of the session>-<UTC stamp>, or the ordinal where there is no time."""
    return F.concat(F.lit("x-"), F.substring(session_id.cast("string"), 1, 8), F.lit("-"), F.coalesce(F.date_format(ts, "yyyyMMdd'T'HHmmssSSS'Z'"), F.lpad(n.cast("string"), 4, "0")))


def exchanges(turns: DataFrame) -> DataFrame:
    """One row an exchange: a human turn and all up to the next; machine turns are left out.

    turns: (session_id, ix, role, text, ts). What comes before a session's first human turn belongs to none.
    One shuffle by session; a session's turns are one group, as its order asks for.
    """
    human = (F.col("role") == "user") & ~is_machine(F.col("text"))
    w = Window.partitionBy("session_id").orderBy("ix")
    rows = turns.withColumn("human", human).withColumn("n", F.sum(human.cast("int")).over(w)).where("n > 0")
    said = F.when((F.col("role") == "assistant") | (F.col("human")), F.struct("ix", "role", "text"))
    parts = rows.groupBy("session_id", "n").agg(F.min_by("text", "ix").alias("ask"), F.array_sort(F.collect_list(F.when(~F.col("human"), said))).alias("_said"), F.min_by("ts", "ix").alias("ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("turns"))
    reply = F.array_join(F.transform("_said", lambda x: x["text"]), "\n\n")
    named = parts.withColumn("reply", reply).drop("_said").withColumn("name", exchange_name(F.col("session_id"), F.col("ts"), F.col("n")))
    before = F.lag("name").over(Window.partitionBy("session_id").orderBy("n"))
    return named.withColumn("previous", before).withColumn("no_fact", carries_no_fact(F.col("ask"), F.col("reply"))).withColumn("description", T.first_words(F.col("ask"), 40))


def render(ex: DataFrame) -> DataFrame:
    """The body of an exchange document: question, reply, link to the one before."""
    link = F.when(F.col("previous").isNotNull(), F.concat(F.lit("Previous: [["), "previous", F.lit("]]")))
    return ex.withColumn("body", F.concat_ws("\n\n", F.concat(F.lit("**Asked:** "), "ask"), F.nullif(F.col("reply"), F.lit("")), link))


#: How a turn begins that gives a session no title. Fixed values.
NO_TITLE = ("[SYSTEM NOTIFICATION", "Caveat:")


def session_titles(turns: DataFrame) -> DataFrame:
    """(session_id, session_title): the first thing that a person said, up to its first sentence's end, at most 80 characters.

    What was typed while a turn ran (operation = 'enqueue', where turns has that column) counts as said. White space
    is squeezed; texts with a system mark are passed over. Secrets and addresses go before the sentence is cut, so that
    no part of one is left. A session in which nobody said anything has no row.
    """
    said = F.col("role") == "user"
    if "operation" in turns.columns:
        said = said | (F.coalesce("operation", F.lit("")) == "enqueue")
    t = F.col("t")
    skip = (t == "") | F.contains(t, F.lit(MACHINE_MARKS[0]))
    for start in NO_TITLE:
        skip = skip | t.startswith(start)
    rows = turns.where(said).select("session_id", "ix", T.squeeze(F.col("text")).alias("t")).where(~skip)
    first = rows.groupBy("session_id").agg(F.min_by("t", F.struct("ix", "t")).alias("t"))
    clean = scrub_addresses(redact(t))
    return first.select("session_id", F.trim(F.substring(F.get(F.split(clean, r"[.?!\n]"), F.lit(0)), 1, 80)).alias("session_title"))


def commits_to_exchanges(ex: DataFrame, commits: DataFrame, key: list[str], cfg: EngineConfig = CONFIG) -> DataFrame:
    """Each commit with the last exchange that began by then, within ``key``; none past the grace after the
    last exchange, at most twelve an exchange (the first by time and sha).

    An as-of join as a running last value over the two tables' union: one shuffle by key, no pairs.
    ex: (key..., name, ts); commits: (key..., sha, at).
    """
    both = ex.select(*key, F.col("ts").alias("t"), F.lit(0).alias("kind"), "name", F.lit(None).cast("string").alias("sha")).unionByName(commits.select(*key, F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("name"), F.col("sha").cast("string").alias("sha")))
    o = Window.partitionBy(*key).orderBy("t", "kind", "name", "sha")
    end = F.max(F.when(F.col("kind") == 0, F.col("t"))).over(Window.partitionBy(*key))
    rows = both.withColumn("exchange", F.last("name", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_end", end)
    rows = rows.where((F.col("kind") == 1) & F.col("exchange").isNotNull() & (F.col("t") <= F.col("_end") + F.expr(f"interval {cfg.commit_grace_minutes} minutes")))
    n = F.row_number().over(Window.partitionBy(*key, "exchange").orderBy("t", "sha"))
    return rows.withColumn("_n", n).where(F.col("_n") <= cfg.commits_per_exchange).select(*key, "exchange", "sha", F.col("t").alias("at"))


def order_faults(docs: DataFrame) -> DataFrame:
    """Exchanges whose place by name is not their place by time."""
    w = Window.partitionBy("session_id")
    rows = docs.withColumn("by_name", F.row_number().over(w.orderBy("name"))).withColumn("by_time", F.row_number().over(w.orderBy("ts", "name")))
    return rows.where("by_name <> by_time")


def duplicate_bodies(docs: DataFrame, key: str = "session_id") -> DataFrame:
    """All but the first document of each body in a session."""
    w = Window.partitionBy(key, "_sha").orderBy("doc_ord")
    return docs.withColumn("_sha", F.sha2(F.coalesce("body", F.lit("")), 256)).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n", "_sha")


def write_exchanges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store after a capture: rows of the same name are replaced, unknown columns of old ones kept,
    and orphans whose body a row of the same session repeats are pruned."""
    merged = old.join(new.select("name"), "name", "left_anti").unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("session_id", F.sha2(F.coalesce("body", F.lit("")), 256)).orderBy(F.col("_new").desc(), "name")
    flagged = merged.join(new.select("name", F.lit(1).alias("_new")), "name", "left").fillna(0, ["_new"])
    return flagged.withColumn("_n", F.row_number().over(w)).where("_n = 1 or _new = 1").drop("_n", "_new")
