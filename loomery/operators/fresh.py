"""Answers about files that the index has not read yet: stale terms, direct reads, recency."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomery.config import CONFIG, EngineConfig
from loomery.sources import shared

from . import state
from .keyword import _bounded

#: Letters of a gram: terms of fewer are not looked for.
GRAM = 3
#: Terms of up to so many letters are looked for in pieces of runs, by their first letters; longer ones by grams in whole texts.
PIECE, HEAD = 64, 12
#: Most files that an answer names for a term, and most unread ones that it lists.
NAMES, CONTENTS, UNREAD = 4, 6, 15


def grams(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text."""
    letters = F.split(text, "")  # a substring would be counted from the start of the text each time
    whole = F.transform(F.sequence(F.lit(0), F.length(text) - GRAM), lambda i: F.concat(*[F.get(letters, i + k) for k in range(GRAM)]))
    return F.when(F.length(text) >= GRAM, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))


def holding(terms: DataFrame, texts: DataFrame, keys: list[str], text: str, scope: list[str] | None = None, lower: bool = True) -> DataFrame:
    """(scope, term, keys): which texts hold which terms as substrings; terms are lower case if texts are to be read so.

    A join on grams instead of all pairs: a text can hold a term only if it holds its rarest gram. Grams of texts count only if
    a term has them; a term of which some gram is nowhere has no candidates. Terms that are left are looked for in each candidate.
    scope: columns of both that must be equal, as where the texts of a session are asked for its own terms.
    """
    scope = scope or []
    asked = terms.select(*scope, "term").distinct().where(F.length("term") >= GRAM)
    parts = asked.select(*scope, "term", F.explode(grams(F.col("term"))).alias("gram"))
    body = F.coalesce(text, F.lit(""))
    hay = texts.select(*scope, *keys, (F.lower(body) if lower else body).alias("hay"))
    found = hay.select(*scope, *keys, F.explode(grams(F.col("hay"))).alias("gram")).join(_bounded(parts.select(*scope, "gram").distinct()), [*scope, "gram"], "left_semi")
    found = shared.written(found, "grams")
    often = found.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("n"))
    rare = parts.join(often, [*scope, "gram"], "left").groupBy(*scope, "term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("lost")).where("lost = 0")
    near = rare.join(found, [*scope, "gram"]).groupBy(*scope, *keys).agg(F.collect_set("term").alias("terms"))
    return near.join(hay, [*scope, *keys]).select(*scope, *keys, F.explode(F.filter("terms", lambda t: F.contains(F.col("hay"), t))).alias("term"))


def pieces(text: Column) -> Column:
    """The distinct pieces of a lower-case text's runs of characters that terms are made of (state.contains_terms).

    An occurrence of a term lies within one run; one of up to PIECE letters within one piece, as pieces begin every PIECE characters and go on for twice that.
    """
    run = r"[a-z0-9._\-]"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?=({run}{{1,{2 * PIECE - 1}}})){run}{{1,{PIECE}}}"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda p: F.length(p) >= GRAM))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 2_000):
            piece, head = [], []
            for p in batch.column(0).slice(part, 2_000).to_pylist():
                own = {p[i : i + k] for i in range(len(p) - GRAM + 1) for k in range(GRAM, min(HEAD, len(p) - i) + 1)}
                piece += [p] * len(own)
                head += own
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.string()), pa.array(head, pa.string())], names=["piece", "head"])


def within(terms: DataFrame, found: DataFrame) -> DataFrame:
    """(piece, term): which distinct pieces hold which terms of up to PIECE letters: an equality join on the terms' first letters, then the whole term."""
    asked = terms.select("term").distinct().where(F.length("term").between(GRAM, PIECE)).withColumn("head", F.substring("term", 1, HEAD))
    return found.mapInArrow(_heads, "piece string, head string").join(_bounded(asked), "head").where("contains(piece, term)").select("piece", "term").distinct()


def saying(terms: DataFrame, texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term): which texts hold which terms of state questions as substrings, letter case aside.

    Texts meet terms through the distinct pieces of all texts, so the work grows with the words that there are and not with texts times terms.
    """
    own = texts.select(*keys, F.explode(pieces(F.lower(F.col(text)))).alias("piece"))
    held = shared.written(within(terms, own.select("piece").distinct()), "pieces")
    rows = own.join(held, "piece").select(*keys, "term").distinct()
    long = terms.where(F.length("term") > PIECE)
    return rows if long.isEmpty() else rows.unionByName(holding(long, texts, keys, text))


def stale_terms(unmatched: DataFrame, stale: DataFrame) -> DataFrame:
    """(query_id, term, in_names, in_contents, n_files) of terms that no indexed document has and a file does that is not indexed yet.

    unmatched: (query_id, term). stale: (corpus, file, body, mtime_ms, gated) of files that are new or changed since the index.
    Gated files are neither read nor named. The newest files come first; n_files counts all that hold the term in their text.
    """
    asked = unmatched.select("query_id", F.lower("term").alias("term")).distinct()
    open_ = stale.where(~F.coalesce("gated", F.lit(False))).select("corpus", "file", "body", "mtime_ms")
    keys = ["corpus", "file"]
    kinds = [saying(asked, open_.withColumn("said", F.col(c)), keys, "said").withColumn("kind", F.lit(k)) for k, c in (("name", "file"), ("content", "body"))]
    hits = kinds[0].unionByName(kinds[1]).join(open_.select(*keys, "mtime_ms"), keys)
    w = Window.partitionBy("term", "kind").orderBy(F.desc("mtime_ms"), "corpus", "file")
    top = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(NAMES, CONTENTS))
    named = lambda kind, most: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("_n") <= most), F.struct("_n", "file")))), lambda x: x["file"])
    shown = top.groupBy("term").agg(named("name", NAMES).alias("in_names"), named("content", CONTENTS).alias("in_contents"))
    count = hits.where("kind = 'content'").groupBy("term").agg(F.count(F.lit(1)).alias("n_files"))
    return asked.join(shown, "term").join(count, "term", "left").select("query_id", "term", "in_names", "in_contents", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def unmatched_terms(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(query_id, term) of question terms that no indexed document holds."""
    terms = queries.select("query_id", F.explode(state.contains_terms(F.col("query"))).alias("term"))
    hay = indexed.select("corpus", "doc_ord", state.haystack().alias("hay_"))
    words = shared.written(hay.select(F.explode(pieces(F.col("hay_"))).alias("piece")).distinct(), "words")
    # most terms are a word of some document; only the others are looked for inside of words
    rest = shared.written(terms.select("term").distinct().join(words, F.col("term") == F.col("piece"), "left_anti"), "rest")
    known = within(rest, words).select("term").distinct()
    long = rest.where(F.length("term") > PIECE)
    if not long.isEmpty():
        known = known.unionByName(holding(long, hay, ["corpus", "doc_ord"], "hay_").select("term").distinct())
    return terms.join(rest.join(known, "term", "left_anti"), "term", "left_semi").select("query_id", "term")


def direct_reads(live: DataFrame, indexed: DataFrame, cfg: EngineConfig = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(documents read directly, a row a corpus of what was and was not read).

    live: documents with corpus, file, mtime_ms, size and gated; indexed: (corpus, file, mtime_ms). Files that the index lacks or has in another
    state are read newest first, up to ``unindexed_files`` of them and until ``unindexed_bytes`` are passed. A gated file counts as read and
    excluded; it is never shown or named. Only as many rows a corpus as the budget allows are ranked after the first cut.
    """
    fresh = live.join(indexed.select("corpus", "file", "mtime_ms"), ["corpus", "file", "mtime_ms"], "left_anti")
    w = Window.partitionBy("corpus").orderBy(F.desc("mtime_ms"), "file")
    first = fresh.select("corpus", "file", "mtime_ms", "size").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cfg.unindexed_files)
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = shared.written(first.withColumn("_before", before).where(F.col("_before") <= cfg.unindexed_bytes).select("corpus", "file"), "read")
    marked = fresh.join(read.withColumn("read", F.lit(True)), ["corpus", "file"], "left").withColumn("read", F.coalesce("read", F.lit(False))).withColumn("gated", F.coalesce("gated", F.lit(False)))
    named = F.col("unread") & ~F.col("gated")
    lost = marked.select("corpus", "file", "mtime_ms", "size", "gated", "read", (~F.col("read")).alias("unread"))
    info = lost.groupBy("corpus").agg(F.count(F.lit(1)).alias("total"), F.count_if("read").alias("scanned"), F.count_if(F.col("read") & F.col("gated")).alias("excluded"), F.coalesce(F.sum(F.when(F.col("read"), F.col("size"))), F.lit(0)).alias("bytes"), F.max(F.when(named, F.col("mtime_ms"))).alias("unread_newest_ms"), F.count_if("unread").alias("unread_count"))
    top = lost.where(named).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= UNREAD)
    files = top.groupBy("corpus").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "file"))), lambda x: x["file"]).alias("unread_files"))
    none = F.array().cast("array<string>")
    info = info.join(files, "corpus", "left").withColumn("unread_files", F.coalesce("unread_files", none)).withColumn("truncated", F.col("scanned") < F.col("total"))
    return marked.where("read and not gated").drop("read", "gated"), info


def newest(docs: DataFrame) -> DataFrame:
    """(corpus, newest): the newest time of a document, its own before its file's."""
    return docs.groupBy("corpus").agg(F.max(F.coalesce("ts", "modified")).alias("newest"))


def corpus_order(docs: DataFrame, cfg: EngineConfig = CONFIG) -> DataFrame:
    """(corpus, ordered_by, section): in what order corpora answer: those with captured times first, then as configured, then by name."""
    clock = state.corpus_clock(docs)
    known = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in cfg.scopes]), F.col("corpus")), F.lit(0))
    w = Window.orderBy(F.col("ordered_by") != "ts", known == 0, known, "corpus")  # a row a corpus
    return clock.withColumn("section", F.row_number().over(w))


def latest(queries: DataFrame, indexed: DataFrame, live: DataFrame, limit: int = 5, cfg: EngineConfig = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(rows, query rows) of the newest mentions over what is indexed and what was read directly.

    indexed: documents with mtime_ms, modified and ts; live: the same with size and gated. A file read directly replaces its indexed state. Rows say where they come from
    (``provenance``), and in which section of the answer their corpus stands. Where a file was left unread that is newer than a corpus's first row, the query row has
    ``recency_void``: what stands first may not be the last word, and ``unread_files`` says what to read.
    """
    direct, info = direct_reads(live, indexed, cfg)
    columns = [c for c in direct.columns if c in indexed.columns]
    merged = state.upsert(indexed.select(*columns).withColumn("provenance", F.lit("index")), direct.select(*columns).withColumn("provenance", F.lit("unindexed-direct")), ["corpus", "file"])
    merged = shared.written(merged, "merged")
    rows, asked = state.latest(queries, merged, limit)
    order = corpus_order(merged, cfg)
    rows = rows.join(merged.select("corpus", "doc_ord", "provenance"), ["corpus", "doc_ord"]).join(F.broadcast(order), "corpus")
    first = rows.where("rank = 1").select("query_id", "corpus", F.unix_millis("modified").alias("first_ms"))
    direct_rows = rows.where("provenance = 'unindexed-direct'").groupBy("query_id", "corpus").agg(F.count(F.lit(1)).alias("merged"))
    out = asked.join(first, ["query_id", "corpus"], "left").join(direct_rows, ["query_id", "corpus"], "left").join(F.broadcast(info), "corpus", "left")
    void = F.coalesce(F.col("unread_newest_ms") > F.col("first_ms"), F.lit(False))
    return rows, out.withColumn("recency_void", void).withColumn("unread_files", F.when(void, F.col("unread_files"))).withColumn("merged", F.coalesce("merged", F.lit(0))).drop("first_ms")
