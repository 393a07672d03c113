"""State questions: newest mentions, sessions, threads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomery.config import CONFIG, EngineConfig
from loomery.functions import text as T

#: How a summary of an earlier conversation announces itself. Fixed value.
SUMMARY_MARK = "This session is being continued from a previous conversation"


def contains_terms(query: Column, cap: int = 200) -> Column:
    """the terms of a state question."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9._\-]{2,})"), F.lit(1))), 1, cap)


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "name", "description", "body"))


def is_summary() -> Column:
    """F06"""
    return F.contains(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.substring(F.coalesce("body", F.lit("")), 1, 400)), F.lit(SUMMARY_MARK))


def occurrences(docs: DataFrame, terms: DataFrame, cfg: EngineConfig = CONFIG, words: bool = False) -> DataFrame:
    """(corpus, doc_ord, term, hits, word): what each document holds of the terms (one column); word (null unless asked for by
    ``words``): whether a term also stands alone.

    The one operator here that SQL functions cannot do well: an automaton finds all terms in one pass over a text,
    where ``contains`` needs one a term. It travels with the tasks and holds at most ``state_terms`` terms; more
    of them take more passes.
    """
    distinct = terms.select("term").distinct()
    parts = max(1, -(-distinct.count() // cfg.state_terms))
    hay = docs.select("corpus", "doc_ord", haystack().alias("hay"))
    out = None
    for k in range(parts):
        batch = [r["term"] for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()]
        found = hay.mapInArrow(lambda rows, b=batch: _found(rows, b, words), "corpus string, doc_ord long, term string, hits long, word boolean")
        out = found if out is None else out.unionByName(found)
    return out


def _found(rows: Iterator[pa.RecordBatch], terms: list[str], words: bool) -> Iterator[pa.RecordBatch]:
    import re

    import ahocorasick

    tree = ahocorasick.Automaton()
    for t in terms:
        tree.add_word(t, t)
    if terms:
        tree.make_automaton()
    alone = {t: re.compile(rf"(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])") for t in terms} if words else {}
    for batch in rows:
        at, term, hits, word = [], [], [], []
        for k, hay in enumerate(batch.column(2).to_pylist()):
            for t in sorted({t for _, t in tree.iter(hay)}) if terms else ():
                at.append(k)
                term.append(t)
                hits.append(hay.count(t))
                word.append(bool(alone[t].search(hay)) if words else None)
        own = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(term, pa.string()), pa.array(hits, pa.int64()), pa.array(word, pa.bool_())], names=["corpus", "doc_ord", "term", "hits", "word"])


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(contains_terms(F.col("query"))).alias("term"))


def mentions(queries: DataFrame, docs: DataFrame, cfg: EngineConfig = CONFIG) -> DataFrame:
    """(query_id, corpus, doc_ord, n_terms, n_matched, term_hits) of documents with any of a query's terms."""
    terms = _asked(queries)
    return _counted(occurrences(docs, terms, cfg).join(terms, "term"), terms)


def _counted(held: DataFrame, terms: DataFrame) -> DataFrame:
    rows = held.groupBy("query_id", "corpus", "doc_ord").agg(F.count(F.lit(1)).alias("n_matched"), F.sum("hits").alias("term_hits"))
    return rows.join(terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms")), "query_id")


def latest(queries: DataFrame, docs: DataFrame, limit: int = 5, include_summaries: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, query rows): documents that hold all terms, newest first, summaries last.

    Where none holds all of several terms, those that hold most of them stand in and the query row is
    marked relaxed, with the terms that none of these holds (F04).
    """
    terms = _asked(queries)
    held = occurrences(docs, terms).join(terms, "term")
    hits = _counted(held, terms)
    best = hits.groupBy("query_id", "corpus").agg(F.max("n_matched").alias("most"), F.max("n_terms").alias("n_terms"))
    rows = hits.join(best.select("query_id", "corpus", "most"), ["query_id", "corpus"]).where("n_matched = most").withColumn("relaxed", F.col("most") < F.col("n_terms"))
    meta = docs.select("corpus", "doc_ord", "name", "file", "modified", is_summary().alias("is_summary"))
    rows = rows.join(meta, ["corpus", "doc_ord"])
    if not include_summaries:
        rows = rows.where("not is_summary")
    order = Window.partitionBy("query_id", "corpus").orderBy("is_summary", F.desc("modified"), "doc_ord")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    ranked = ranked.join(docs.select("corpus", "doc_ord", T.trim_snippet(F.col("body")).alias("snippet")), ["corpus", "doc_ord"])
    asked = queries.select("query_id", contains_terms(F.col("query")).alias("terms"))
    seen = held.groupBy("query_id", "corpus").agg(F.collect_set("term").alias("seen"))
    whole = held.join(rows.select("query_id", "corpus", "doc_ord"), ["query_id", "corpus", "doc_ord"]).groupBy("query_id", "corpus").agg(F.collect_set("term").alias("held"))
    total = rows.groupBy("query_id", "corpus").agg(F.count(F.lit(1)).alias("total_mentions"), F.first("relaxed").alias("relaxed"), F.count(F.when(F.col("is_summary"), 1)).alias("summaries_demoted"))
    info = asked.join(total, "query_id", "left").join(seen, ["query_id", "corpus"], "left").join(whole, ["query_id", "corpus"], "left")
    info = info.select("query_id", "corpus", F.coalesce("total_mentions", F.lit(0)).alias("total_mentions"), F.coalesce("relaxed", F.lit(False)).alias("relaxed"), F.array_sort(F.array_except("terms", F.coalesce("held", F.array().cast("array<string>")))).alias("dropped_terms"), F.array_sort(F.array_except("terms", F.coalesce("seen", F.array().cast("array<string>")))).alias("unmatchable_terms"), F.coalesce("summaries_demoted", F.lit(0)).alias("summaries_demoted"), (F.coalesce("total_mentions", F.lit(0)) > 0).alias("premise_supported"))
    return ranked, info


def browse(docs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest documents of each corpus; more than 50 are refused."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    w = Window.partitionBy("corpus").orderBy(F.desc("modified"), "doc_ord")
    return docs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


#: Characters of which a term lies whole between two others, and runs of which a task keeps what they hold.
_PIECE = r"[a-z0-9._-]+"
KNOWN_RUNS = 300_000


def _held_by_run(rows: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """(term, df, df_word) of a task's texts. A term lies in one run of its characters, so each distinct run is looked through once, not each text."""
    import re

    import ahocorasick

    tree, piece = ahocorasick.Automaton(), re.compile(_PIECE)
    for k, t in enumerate(terms):
        tree.add_word(t, (k, len(t)))
    if terms:
        tree.make_automaton()
    df, df_word, known = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64), {}

    def look(run: str) -> tuple[frozenset, frozenset]:
        held, alone = set(), set()
        for end, (k, n) in tree.iter(run):
            held.add(k)
            if (end - n < 0 or run[end - n] in ".-") and (end + 1 == len(run) or run[end + 1] in ".-"):
                alone.add(k)
        return frozenset(held), frozenset(alone)

    for batch in rows if terms else ():
        for hay in batch.column(0):
            text = hay.as_py()
            held, alone = set(), set()
            for run in set(piece.findall(text)):
                found = known.get(run)
                if found is None:
                    if len(known) >= KNOWN_RUNS:
                        known.clear()
                    found = known[run] = look(run)
                if found[0]:
                    held |= found[0]
                    alone |= found[1]
            df[list(held)] += 1
            df_word[list(alone)] += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([terms[k] for k in some], pa.string()), pa.array(df[some]), pa.array(df_word[some])], names=["term", "df", "df_word"])


def term_frequencies(terms: DataFrame, docs: DataFrame, cfg: EngineConfig = CONFIG) -> DataFrame:
    """(term, df, df_word): documents that hold a term at all, and as a whole word.

    Tasks count by themselves and give a row a term; no pair of a term and a document is a row. Terms of other characters than a state question's are looked for in whole texts.
    """
    own = terms.select("term").where("term is not null").distinct()
    plain = own.where(F.col("term").rlike(rf"\A{_PIECE}\z"))
    parts = max(1, -(-plain.count() // cfg.state_terms))
    others = own.join(plain, "term", "left_anti")
    found = own.limit(0).select("term", F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("df_word"))
    if others.limit(1).count():
        found = occurrences(docs, others, cfg, words=True).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count(F.when(F.col("word"), 1)).alias("df_word"))
    hay = docs.select(haystack().alias("hay"))
    for k in range(parts):
        batch = [r["term"] for r in plain.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()]
        counted = hay.mapInArrow(lambda rows, b=batch: _held_by_run(rows, b), "term string, df long, df_word long")
        found = found.unionByName(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("df_word").alias("df_word")))
    return terms.select("term").distinct().join(found, "term", "left").fillna(0, ["df", "df_word"])


def corpus_clock(docs: DataFrame) -> DataFrame:
    """Which time orders a corpus: its documents' own, the time of the fact, or the file's."""
    n, ts, fact = F.count(F.lit(1)), F.count("ts"), F.count("modified_source")
    return docs.groupBy("corpus").agg(F.when(2 * ts > n, "ts").when(2 * fact > n, "factTime").otherwise("mtime").alias("ordered_by"))


def sessions(docs: DataFrame, limit: int | None = None, pending: DataFrame | None = None) -> DataFrame:
    """One row a session, newest first; pending rows merge in by one aggregate over both."""
    rows = docs.withColumn("pending", F.lit(False))
    if pending is not None:
        rows = rows.unionByName(pending.withColumn("pending", F.lit(True)), allowMissingColumns=True)
    rows = rows.where("session_id is not null")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("doc_ord"))).alias(c)
    out = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("description", F.struct("ts", "doc_ord")).alias("opening"), F.max_by("name", F.struct("ts", "doc_ord")).alias("last_exchange"), F.max_by("in_flight", F.struct("ts", "doc_ord")).alias("last_in_flight"),
        first("session_title"), first("account"), first("project"), F.count(F.when(is_summary(), 1)).alias("compaction_summaries"), F.max("pending").alias("pending_index"),
    )
    out = out.withColumn("sid8", F.substring("session_id", 1, 8))
    return out if limit is None else out.orderBy(F.desc("last_ts"), "session_id").limit(limit)


def thread_positions(docs: DataFrame) -> DataFrame:
    """Position, total and last name of each exchange in its session."""
    w = Window.partitionBy("corpus", "session_id")
    o = w.orderBy("ts", "name")
    return docs.where("session_id is not null").select("corpus", "session_id", "name", "doc_ord", "ts", F.row_number().over(o).alias("position"), F.count(F.lit(1)).over(w).alias("total"), F.last("name").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("thread_last"))


def thread(anchors: DataFrame, docs: DataFrame, forward: int = 8, back: int = 0) -> DataFrame:
    """(anchor, name, position, total, offset, is_anchor) of the exchanges around each anchor name."""
    if not (0 <= forward <= 50 and 0 <= back <= 50):
        raise ValueError("forward and back must be 0 to 50")
    pos = thread_positions(docs)
    at = anchors.select(F.col("name").alias("anchor")).join(pos.select("corpus", "session_id", F.col("name").alias("anchor"), F.col("position").alias("_at")), "anchor")
    offsets = at.withColumn("position", F.explode(F.sequence(F.col("_at") - back, F.col("_at") + forward)))  # an equality join, not a range
    rows = offsets.join(pos, ["corpus", "session_id", "position"])
    return rows.select("anchor", "corpus", "session_id", "name", "position", "total", (F.col("position") - F.col("_at")).alias("offset"), (F.col("position") == F.col("_at")).alias("is_anchor"), "ts")


def upsert(base: DataFrame, direct: DataFrame, key: str = "file") -> DataFrame:
    """Rows of direct replace those of base with the same key."""
    return base.join(direct.select(key), key, "left_anti").unionByName(direct, allowMissingColumns=True)


def unindexed(live: DataFrame, indexed: DataFrame, cfg: EngineConfig = CONFIG) -> DataFrame:
    """Files that are new or changed since the index, newest first, up to the file and byte limits."""
    fresh = live.join(indexed.select("corpus", "file", "mtime_ms"), ["corpus", "file", "mtime_ms"], "left_anti")
    w = Window.partitionBy("corpus").orderBy(F.desc("mtime_ms"), "file")
    rows = fresh.withColumn("_n", F.row_number().over(w)).withColumn("_bytes", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("_n") <= cfg.unindexed_files) & (F.col("_bytes") <= cfg.unindexed_bytes)).drop("_n", "_bytes")
