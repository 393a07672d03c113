"""Freshness, incremental builds, health and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomery.config import CONFIG, EngineConfig
from loomery.functions import text as T


def listing_diff(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """(corpus, file, change): added, removed or changed (time or size). One full outer join."""
    a = live.select("corpus", "file", F.struct("mtime_ms", "size").alias("now"))
    b = indexed.select("corpus", "file", F.struct("mtime_ms", "size").alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, ["corpus", "file"], "full_outer").select("corpus", "file", change.alias("change")).where("change is not null")


def freshness(diff: DataFrame, corpora: DataFrame, has_index: Column | None = None, cfg: EngineConfig = CONFIG) -> DataFrame:
    """Counts of changes a corpus, and what to do: nothing, an inline update or first build, or answer as stale."""
    n = diff.groupBy("corpus").agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "removed", "changed")])
    rows = corpora.join(n, "corpus", "left").fillna(0, ["added", "removed", "changed"])
    total = F.col("added") + F.col("removed") + F.col("changed")
    built = F.lit(True) if has_index is None else has_index
    policy = F.when(~built & (F.col("added") == 0), "no_index").when(~built & (F.col("added") <= cfg.inline_first_build), "first_build").when(total == 0, "fresh").when(total <= cfg.inline_changes, "incremental").otherwise("index_stale")
    return rows.withColumn("total", total).withColumn("policy", policy)


def listing_digest(listing: DataFrame) -> DataFrame:
    """A digest of each corpus's file:mtime:size lines, sorted."""
    return listing.groupBy("corpus").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "file", "mtime_ms", "size"))), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("count"))


def corpus_hash(docs: DataFrame) -> DataFrame:
    """A digest of each corpus's file:hash pairs, sorted."""
    return docs.groupBy("corpus").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "file", "hash"))), "|"), 256).alias("corpus_hash"))


def plan_build(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Each document with ``reuse``: whether name, hash and time are those of the index before."""
    known = previous.select("name", "hash", "mtime_ms", F.lit(True).alias("_known")).distinct()
    return new.join(known, ["name", "hash", "mtime_ms"], "left").withColumn("reuse", F.coalesce("_known", F.lit(False))).drop("_known")


def refuse_build(new: DataFrame, previous: DataFrame, failed: int = 0) -> str | None:
    """Why a build must not replace the index: nothing to read, all gone, or too many unreadable documents."""
    return refusal(new.count(), previous.count(), failed)


def refusal(n: int, before: int, failed: int = 0) -> str | None:
    """refuse_build() by counts."""
    if n == 0:
        return "every document vanished" if before else "no documents"
    if failed > max(3, 0.01 * (n + failed)):
        return f"{failed} documents failed"
    return None


def missing_vectors(chunks: DataFrame, cache: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with their cached vector, distinct texts to embed); the cache is keyed by contract and text hash."""
    keyed = chunks.withColumn("text_sha", F.sha2("text", 256))
    own = cache.where(F.col("contract") == contract).select("text_sha", "vec")
    found = keyed.join(own, "text_sha", "left")
    return found, found.where("vec is null").select("text_sha", "text").dropDuplicates(["text_sha"])


def vanished(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Names of the index before that the corpus no longer has."""
    return previous.select("corpus", "name").distinct().join(current.select("corpus", "name").distinct(), ["corpus", "name"], "left_anti")


def restore(store: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The rows of a snapshot whose names the store lacks."""
    return snapshot.join(store.select("name"), "name", "left_anti")


def snapshot_due(store_digest: DataFrame, last_digest: DataFrame) -> DataFrame:
    """Corpora whose listing digest is not the last snapshot's."""
    return store_digest.join(last_digest.select("corpus", F.col("digest").alias("_last")), "corpus", "left").where("not (digest <=> _last)").drop("_last")


def big_documents(docs: DataFrame, share: float = 0.25, least: int = 200) -> DataFrame:
    """Documents with a quarter of a corpus of at least 200 chunks."""
    total = F.sum("n_chunks").over(Window.partitionBy("corpus"))
    return docs.withColumn("total", total).where((F.col("total") >= least) & (F.col("n_chunks") >= share * F.col("total")))


#: What outcomes say of a run. Fixed values.
ENDED_WELL = ("captured", "reconciled", "no-op")
ENDED = (*ENDED_WELL, "skipped", "failed")
UNFINISHED = ("started", "exited")
REPAIRS = ("crash-recovered", "reconciled", "captured")
COMPARED = ("agrees", "reconciled")


def _run_columns(runs: DataFrame) -> DataFrame:
    """runs with trigger and reconcile, null where the log has none."""
    for c in ("trigger", "reconcile"):
        if c not in runs.columns:
            runs = runs.withColumn(c, F.lit(None).cast("string"))
    return runs.withColumn("_walker", F.coalesce(F.col("trigger") == "walker", F.lit(False))).withColumn("_audit", F.coalesce(F.col("trigger") == "audit", F.lit(False)))


def failure_streak(runs: DataFrame, key: str | None = None) -> DataFrame:
    """How many runs failed since the last that ended well, when the first and the last of them did, and ``lower_bound``: no run ended well before.

    A walk counts by its verdict once it is finished: a failed reconcile is a failure, one that compared ends well. Audits, skipped runs and
    whatever else says nothing of the index are passed over. The newest good run is a grouped maximum and the streak a count of
    failures that are later: nothing is sorted whole.
    """
    keys = [key] if key else []
    rows = _run_columns(runs)
    done = F.col("_walker") & (F.col("outcome") == "finished")
    good = F.coalesce(F.when(F.col("_walker"), done & F.col("reconcile").isin(*COMPARED)).when(F.col("_audit"), False).otherwise(F.col("outcome").isin(*ENDED_WELL)), F.lit(False))
    bad = F.coalesce(F.when(F.col("_walker"), done & (F.col("reconcile") == "failed")).when(F.col("_audit"), False).otherwise(F.col("outcome") == "failed"), F.lit(False))
    last = rows.where(good).groupBy(*keys).agg(F.max(F.struct("at", "seq")).alias("_last"))
    rows = rows.join(last, keys, "left") if keys else rows.join(F.broadcast(last))  # one row
    later = bad & (F.col("_last").isNull() | (F.struct("at", "seq") > F.col("_last")))
    count = F.count(F.when(later, 1))
    return rows.groupBy(*keys).agg(count.alias("streak"), F.min(F.when(later, F.col("at"))).alias("since"), F.max(F.when(later, F.col("at"))).alias("last_at"), (F.max("_last").isNull() & (count > 0)).alias("lower_bound"))


def crashed_runs(runs: DataFrame, alive: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """Last rows of processes that did not finish, are dead, are older than ``minutes`` and were not repaired later.

    Any later run that repairs, of whatever process or session, closes a crash, and so does a finished walk that compared store and index. Rows of
    walks and audits are nobody's last rows: neither writes to the store.
    """
    rows = _run_columns(runs)
    own = rows.where(~F.col("_walker") & ~F.col("_audit") & F.col("pid").isNotNull())
    w = Window.partitionBy("pid").orderBy(F.desc("at"), F.desc("seq"))
    last = own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    dead = last.where(F.col("outcome").isin(*UNFINISHED)).where(F.col("at") <= as_of - F.expr(f"interval {minutes} minutes")).join(alive.select("pid"), "pid", "left_anti")
    walked = F.col("_walker") & (F.col("outcome") == "finished") & F.col("reconcile").isin(*COMPARED)
    repair = F.coalesce(F.when(F.col("_walker"), walked).when(F.col("_audit"), False).otherwise(F.col("outcome").isin(*REPAIRS)), F.lit(False))
    repaired = rows.where(repair).agg(F.max(F.struct("at", "seq")).alias("_ok"))  # one row
    return dead.join(F.broadcast(repaired)).where("_ok is null or struct(at, seq) > _ok").drop("_ok", "_walker", "_audit")


def uncaptured(transcripts: DataFrame, stamps: DataFrame) -> DataFrame:
    """Transcripts that have grown since they were captured, or never were."""
    return transcripts.join(stamps.select("path", F.col("size").alias("captured")), "path", "left").where("captured is null or size > captured").withColumn("pending_bytes", F.col("size") - F.coalesce("captured", F.lit(0)))


def store_audit(store: DataFrame, extracted: DataFrame, as_of: Column, grace: int = 15) -> DataFrame:
    """(session_id, kind, name): missing, missingStale, orphan, duplicate or order.

    store: (session_id, name, body, ts, doc_ord); extracted: (session_id, name, ts).
    """
    from .capture import duplicate_bodies, order_faults

    lost = extracted.join(store.select("session_id", "name"), ["session_id", "name"], "left_anti")
    kind = F.when(F.col("ts") < as_of - F.expr(f"interval {grace} minutes"), "missingStale").otherwise("missing")
    out = lost.select("session_id", kind.alias("kind"), "name")
    known = extracted.select("session_id").distinct()
    out = out.unionByName(store.join(known, "session_id", "left_semi").join(extracted.select("session_id", "name"), ["session_id", "name"], "left_anti").select("session_id", F.lit("orphan").alias("kind"), "name"))
    out = out.unionByName(duplicate_bodies(store).select("session_id", F.lit("duplicate").alias("kind"), "name"))
    return out.unionByName(order_faults(store).select("session_id", F.lit("order").alias("kind"), "name"))


def dangling_links(docs: DataFrame) -> DataFrame:
    """Previous-links of exchanges whose target the store lacks."""
    links = docs.select("session_id", "name", F.explode(T.wiki_links(F.col("body"))).alias("target"))
    return links.join(docs.select(F.col("name").alias("target")), "target", "left_anti")


def health(crashed: DataFrame, streaks: DataFrame, pending: DataFrame, problems: DataFrame, worst_streak: int = 3) -> DataFrame:
    """One row of counts, and whether capture is healthy."""
    c = crashed.agg(F.count(F.lit(1)).alias("crashed"))
    s = streaks.agg(F.coalesce(F.max("streak"), F.lit(0)).alias("streak"))
    p = pending.agg(F.count(F.lit(1)).alias("pending"))
    a = problems.where("kind <> 'missing'").agg(F.count(F.lit(1)).alias("problems"))
    row = c.join(s).join(p).join(a)  # four tables of one row
    return row.withColumn("healthy", (F.col("crashed") == 0) & (F.col("streak") < worst_streak) & (F.col("problems") == 0))


def reconcile_reason(state: DataFrame) -> DataFrame:
    """Why an index must be reconciled, null if it need not be.

    state: crash_pending, force (a crash in the run log), header_digest (null: the index lists no sources) and
    live_digest of each corpus. Somebody's unfinished write outranks what digests can see.
    """
    reason = F.when(F.col("crash_pending"), "pending-marker").when(F.col("force"), "crash-signature").when(F.col("header_digest").isNull(), "no-source-listing").when(F.col("header_digest") != F.col("live_digest"), "listing-digest-mismatch")
    return state.withColumn("reason", reason)


def reconcile_allowed(state: DataFrame, as_of: Column, min_seconds: int = 600) -> DataFrame:
    """Whether the rebuild may run now. Adds ``allowed`` to reconcile_reason()'s rows.

    Of the last rebuild: last_at, last_digest, last_count (null: none); of the store: live_digest, live_count.
    A pending marker always may; a crash not twice for one listing; growth and a stamp of the future do not wait.
    """
    age = F.unix_millis(as_of) / 1000.0 - F.unix_millis("last_at") / 1000.0
    again = (F.col("reason") == "crash-signature") & F.coalesce(F.col("last_digest") == F.col("live_digest"), F.lit(False))
    free = F.col("last_at").isNull() | (F.col("live_count") > F.coalesce("last_count", F.lit(0))) | (age < 0) | (age >= min_seconds)
    allowed = F.when(F.col("reason").isNull(), False).when(F.col("reason") == "pending-marker", True).when(again, False).otherwise(free)
    return state.withColumn("allowed", allowed)


def snapshot_difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of two result snapshots that differ, with both values."""
    left = a.select(*keys, F.struct(*values).alias("left"))
    right = b.select(*keys, F.struct(*values).alias("right"))
    return left.join(right, keys, "full_outer").where("not (left <=> right)")


def visibility_lag(built: DataFrame, listing: DataFrame) -> DataFrame:
    """A30, ST8: seconds from a file's time to the build that first had it, with percentiles a corpus."""
    seen = built.groupBy("corpus", "file").agg(F.min("built_at").alias("built_at"))
    lag = listing.join(seen, ["corpus", "file"]).withColumn("lag_s", (F.unix_millis("built_at") - F.col("mtime_ms")) / 1000.0).where("lag_s >= 0")
    return lag.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.percentile("lag_s", F.lit(0.5)).alias("p50"), F.percentile("lag_s", F.lit(0.9)).alias("p90"), F.max("lag_s").alias("worst"))


def honesty(responses: DataFrame) -> DataFrame:
    """Whether an answer owned up to a file that was not indexed yet.

    responses: name (of that file; null: there was none), token (asked about), rows (array of name, file, snippet),
    owned (array of files that the answer says it did not read or found unindexed), admits (it says that it did not
    read everything), note and no_strong_match.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    same = lambda c: F.coalesce((c == F.col("name")) | (base(c) == base(F.col("name"))), F.lit(False))
    said = lambda r: F.coalesce(F.contains(F.lower(r["snippet"]), F.lower(F.col("token"))) & (F.col("token") != ""), F.lit(False))
    present = F.exists("rows", lambda r: same(r["name"]) | same(r["file"]) | said(r))
    named = F.exists("owned", same) | F.coalesce("admits", F.lit(False))
    absence = F.lower(F.coalesce("note", F.lit(""))).rlike("no document (in any corpus )?mentions every term|no index for this scope") | F.coalesce("no_strong_match", F.lit(False))
    v = F.when(F.col("name").isNull(), "N/A").when(present, "HONEST-PRESENT").when(named, "HONEST-NAMED").when((F.size("rows") > 0) | absence, "DISHONEST").otherwise("N/A")
    return responses.withColumn("honesty", v)


def git_floor(docs: DataFrame, commit_files: DataFrame) -> DataFrame:
    """The newest commit time of files whose documents have front matter but no date; four outcomes."""
    newest = commit_files.groupBy("file").agg(F.max("at").alias("floor"))
    rows = docs.join(newest, "file", "left")
    outcome = F.when(F.col("modified_given"), "has-date").when(~F.col("has_frontmatter"), "no-front-matter").when(F.col("floor").isNull(), "no-commit").otherwise("stamped")
    return rows.withColumn("outcome", outcome).withColumn("modified", F.when(F.col("outcome") == "stamped", F.col("floor")).otherwise(F.col("modified")))
