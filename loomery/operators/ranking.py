"""Ranked search as one plan over a batch of queries: fusion, rerank, envelope, caps, verdict, spread.

R01-R05, R07, R08, J05-J07, F01, L01, L02, L06, W04, W05, A08, U02, U05.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomery.config import CONFIG, STOP_WORDS, EngineConfig
from loomery.functions import scoring as S, text as T

from loomery.sources import shared

from . import keyword
from .phrase import phrase_window, snippet_around
from .postings import Index


def reference_chunks(chunk_counts: DataFrame) -> DataFrame:
    """(corpus, reference): the value at floor(0.9 * (n - 1)) of the sorted chunk counts, 1 at least.

    Ranks come from a histogram of counts, which the chunk cap bounds.
    """
    hist = chunk_counts.groupBy("corpus", "n_chunks").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("corpus").orderBy("n_chunks"))
    total = F.sum("c").over(Window.partitionBy("corpus"))
    at = hist.withColumn("upto", upto).withColumn("want", F.floor(0.9 * (total - 1)) + 1)
    return at.where("upto >= want").groupBy("corpus").agg(F.greatest(F.min("n_chunks"), F.lit(1)).alias("reference"))


def passes(after: Column | None = None, before: Column | None = None, accounts: list[str] | None = None, projects: list[str] | None = None, session: str | None = None, archive: bool = True) -> Column:
    """hard filters of candidates. A document without account, project or date passes those; a session is strict."""
    c = F.lit(True)
    if not archive:
        c = c & (F.coalesce("tier", F.lit("hot")) != "archive")
    if session is not None:
        c = c & F.coalesce(F.col("session_id") == session, F.lit(False))
    for name, wanted in (("account", accounts), ("project", projects)):
        if wanted:
            c = c & (F.col(name).isNull() | F.col(name).isin(*wanted))
    if after is not None:
        c = c & (F.col("modified").isNull() | (F.col("modified") >= after))
    if before is not None:
        c = c & (F.col("modified").isNull() | (F.col("modified") <= before))
    return c


def slot_cap(rows: DataFrame, k: int = CONFIG.slots_per_document) -> DataFrame:
    """At most k rows a file for each query, the best first."""
    w = Window.partitionBy("query_id", "corpus", "file").orderBy(F.desc(F.round("score", 9)), "doc_ord")
    return rows.withColumn("_slot", F.row_number().over(w)).where(F.col("_slot") <= k).drop("_slot")


def archive_cap(rows: DataFrame, limit: int = CONFIG.limit, share: float = CONFIG.archive_share) -> DataFrame:
    """Adds ``rank`` and keeps ``limit`` rows a query: archive documents beyond their share come last."""
    most = max(1, int(limit * share))
    w = Window.partitionBy("query_id", "corpus").orderBy(F.desc(F.round("score", 9)), "doc_ord")
    flag = (F.col("tier") == "archive").cast("int")
    held = rows.withColumn("_held", (flag == 1) & (F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0)) > most))
    order = Window.partitionBy("query_id", "corpus").orderBy("_held", F.desc(F.round("score", 9)), "doc_ord")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_held")


#: What a result shows of its document, beside its text.
SHOWN = ["file", "name", "tier", "in_memory_index", "modified"]


def envelope(as_of: datetime, cfg: EngineConfig = CONFIG) -> Column:
    """What a score is multiplied by for its document's tier and age."""
    return S.tier_boost(F.col("tier"), F.col("in_memory_index"), cfg) * S.recency_factor(F.col("modified"), as_of, cfg)


def candidates(queries: DataFrame, docs: DataFrame, semantic: DataFrame | None = None, cfg: EngineConfig = CONFIG, filters: Column | None = None, prepared: keyword.Prepared | None = None, index: Index | None = None, most: int | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``base`` above 0, term statistics): the whole ranking of each query before its best go on.

    most: in keyword mode the first so many rows will do. only: (corpus, doc_ord) of the documents whose rows are asked for. In keyword mode without filters nothing but the score is known of a row: no other column of a document is read for it.
    """
    ready = prepared or (index.prepare(queries, cfg) if index is not None else keyword.prepare(queries, docs, cfg))
    stats = keyword.term_stats(queries, docs, cfg, ready)
    if semantic is None:
        top = Window.partitionBy("query_id", "corpus")
        scaled = lambda rows, best: rows.withColumn("keyword_score", F.col("raw") / best).withColumn("semantic_score", F.lit(0.0)).withColumn("base", F.col("keyword_score")).where("base > 0")
        if most and only is None:
            # the best row counts even where it does not pass
            seen = None if filters is None else docs.select("corpus", "doc_ord", F.coalesce(filters, F.lit(False)).alias("_passes"))
            rows = scaled(keyword.best(ready, most, cfg, seen, None if filters is None else "_passes"), F.max("raw").over(top))
            if filters is None:
                return rows, stats
            return rows.where("_passes").drop("_passes"), stats
        best = keyword.best(ready, 1, cfg).groupBy("query_id", "corpus").agg(F.max("raw").alias("_best"))
        raw = keyword.bm25f(queries, docs, cfg, ready, only if filters is None else _passing(docs, filters, only))
        return scaled(raw.join(keyword._bounded(best), ["query_id", "corpus"]), F.col("_best")).drop("_best"), stats
    raw = keyword.bm25f(queries, docs, cfg, ready)
    kw = raw.join(keyword._bounded(stats.select("query_id", "corpus", "ideal")), ["query_id", "corpus"]).withColumn("keyword_score", S.absolute_keyword(F.col("raw"), F.col("ideal"), cfg)).where("keyword_score is not null").drop("ideal")
    sem = semantic.select("query_id", "corpus", "doc_ord", S.rescale_cosine(F.col("cos"), cfg).alias("semantic_score"))
    found = kw.join(sem, ["query_id", "corpus", "doc_ord"], "full_outer").fillna(0.0, ["keyword_score", "semantic_score", "raw"])
    own = F.col("own_chunks") if "own_chunks" in docs.columns else F.least(T.chunk_total(F.size(T.words(F.col("body")))), F.lit(cfg.chunk_cap))
    section = F.coalesce(F.col("is_section"), F.lit(False)) if "is_section" in docs.columns else F.lit(False)
    meta = docs.select("corpus", "doc_ord", *SHOWN, own.alias("own_chunks"), section.alias("_section"), (F.lit(True) if filters is None else F.coalesce(filters, F.lit(False))).alias("_passes"))
    rows = found.join(meta.where("_passes").drop("_passes"), ["corpus", "doc_ord"])
    bulk = meta.groupBy("corpus", "file").agg(F.sum("own_chunks").alias("parent_chunks"))
    reference = reference_chunks(bulk.select("corpus", F.col("parent_chunks").alias("n_chunks")))
    # A section weighs as much of its file's bulk as cfg.section_beta says
    heavy = F.when(F.col("_section"), S.section_chunks(F.col("own_chunks"), F.col("parent_chunks"), cfg.section_beta)).otherwise(F.col("parent_chunks"))
    rows = rows.join(bulk, ["corpus", "file"]).join(F.broadcast(reference), "corpus").withColumn("n_chunks", heavy)
    long_doc = S.long_doc_factor(F.col("n_chunks"), F.col("reference"), F.col("keyword_score"), cfg)
    rows = rows.withColumn("base", cfg.fuse_keyword * F.col("keyword_score") + cfg.fuse_semantic * F.col("semantic_score") * long_doc)
    rows = rows.drop("_section").where("base > 0")
    return (rows if only is None else rows.join(only.select("corpus", "doc_ord"), ["corpus", "doc_ord"], "left_semi")), stats


def _passing(docs: DataFrame, filters: Column, only: DataFrame | None) -> DataFrame:
    passing = docs.where(filters).select("corpus", "doc_ord")
    return passing if only is None else passing.join(only.select("corpus", "doc_ord"), ["corpus", "doc_ord"], "left_semi")


def rank_one(queries: DataFrame, docs: DataFrame, as_of: datetime, semantic: DataFrame | None = None, cfg: EngineConfig = CONFIG, filters: Column | None = None, limit: int = CONFIG.limit, prepared: keyword.Prepared | None = None, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored candidates, term statistics) of each query and corpus.

    filters (F01, over the columns of docs) choose candidates before the best max(rerank, limit) go on (L02). Bodies
    join only what is left then. index: an index of docs, from whose files postings and the rows that are left are read.

    semantic: (query_id, corpus, doc_ord, cos) makes the mode hybrid; without it the keyword score is
    scaled by each query's best, and nothing is ever refused.
    """
    rows, stats = candidates(queries, docs, semantic, cfg, filters, prepared, index, most=max(cfg.rerank, limit))
    order = Window.partitionBy("query_id", "corpus").orderBy(F.desc(F.round("base", 9)), "doc_ord")
    rows = rows.withColumn("_pass1", F.row_number().over(order)).where(F.col("_pass1") <= max(cfg.rerank, limit))
    left = ["body"] if "tier" in rows.columns else [*SHOWN, "body"]
    if index is not None:
        rows = shared.written(rows, "rows")
    near = rows.join(index.of(rows, left) if index is not None else docs.select("corpus", "doc_ord", *left), ["corpus", "doc_ord"])
    wanted = queries.select("query_id", F.array_distinct(T.tokenize(F.col("query"))).alias("terms"))
    near = near.join(wanted, "query_id").withColumn("_win", phrase_window(F.col("body"), F.col("terms"))).drop("terms")
    near = near.withColumn("phrase_score", F.col("_win.phrase")).withColumn("snippet", snippet_around(F.col("body"), F.col("_win.first"), F.col("_win.stop"))).drop("_win")
    if semantic is not None:
        near = near.withColumn("base", F.col("base") + cfg.fuse_phrase * S.phrase_part(F.col("phrase_score"), cfg))
    near = near.withColumn("score", F.col("base") * envelope(as_of, cfg)).withColumn("provenance", S.provenance(F.col("keyword_score"), F.col("semantic_score"), F.col("phrase_score")))
    return near.drop("body", "_pass1"), stats


def graph_spread(scored: DataFrame, edges: DataFrame, cfg: EngineConfig = CONFIG) -> DataFrame:
    """The first ``spread_from`` rows of a query lend alpha times their score to linked rows that scored too.

    Only in the corpora that lend (``cfg.spread_corpora``). A row receives only if its own semantic score reaches the
    gate. One hop, from the scores before any lending. scored: (query_id, corpus, doc_ord, score, semantic_score, ...); edges: (corpus, src, dst) over doc_ord.
    """
    edges = edges.where(F.col("corpus").isin(*cfg.spread_corpora))
    both = edges.select("corpus", F.col("src").alias("donor"), F.col("dst").alias("doc_ord")).unionByName(edges.select("corpus", F.col("dst").alias("donor"), F.col("src").alias("doc_ord"))).where("donor <> doc_ord").distinct()
    order = Window.partitionBy("query_id", "corpus").orderBy(F.desc("score"), "doc_ord")
    # a histogram of scores tells from which step on the first rows of a query lie: all others are neither shuffled nor sorted
    step = F.floor(F.col("score") * 1000)
    above = Window.partitionBy("query_id", "corpus").orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = scored.groupBy("query_id", "corpus", step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    least = steps.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).where(F.col("_above") < cfg.spread_from).groupBy("query_id", "corpus").agg(F.min("_step").alias("_least"))
    first = scored.join(keyword._bounded(least), ["query_id", "corpus"]).where(step >= F.col("_least")).drop("_least")
    donors = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cfg.spread_from).select("query_id", "corpus", F.col("doc_ord").alias("donor"), F.col("score").alias("lent"))
    donors = keyword._bounded(shared.written(donors, "donors"))
    gain = both.join(donors, ["corpus", "donor"]).groupBy("query_id", "corpus", "doc_ord").agg((cfg.spread_alpha * F.sum("lent")).alias("gain"))
    gain = keyword._bounded(shared.written(gain, "gain"))
    joined = scored.join(gain, ["query_id", "corpus", "doc_ord"], "left")
    got = F.when(F.col("semantic_score") >= cfg.spread_gate, F.coalesce("gain", F.lit(0.0))).otherwise(0.0)
    return joined.withColumn("graph_spread", F.round(got, 4)).withColumn("score", F.when(got > 0, F.round(F.col("score") + got, 4)).otherwise(F.col("score"))).drop("gain")


def verdict(best: DataFrame, cfg: EngineConfig = CONFIG, floors: DataFrame | None = None) -> DataFrame:
    """Whether each query's answer is refused, and why.

    best: a row a query and corpus: query_id, corpus, mode, top_score (null: no candidate), top_phrase,
    best_raw, ideal_full, orphan_share. floors: (corpus, score_floor, coverage_floor) replaces the
    defaults where it has a row.
    """
    rows = best
    if floors is not None:
        rows = rows.join(F.broadcast(floors.select("corpus", "score_floor", "coverage_floor")), "corpus", "left")
    else:
        rows = rows.withColumn("score_floor", F.lit(None).cast("double")).withColumn("coverage_floor", F.lit(None).cast("double"))
    rows = rows.withColumn("score_floor", F.coalesce("score_floor", F.lit(cfg.absence_score))).withColumn("coverage_floor", F.coalesce("coverage_floor", F.lit(cfg.absence_coverage)))
    rows = rows.withColumn("lexical_coverage", F.when(F.col("ideal_full") > 0, F.col("best_raw") / F.col("ideal_full")).otherwise(0.0))
    rows = rows.withColumn("effective_phrase", F.col("top_phrase") * F.least(F.lit(1.0), F.col("lexical_coverage") / F.col("coverage_floor")))
    weak = F.col("effective_phrase") < cfg.absence_phrase
    vocabulary = (F.col("orphan_share") >= cfg.absence_orphans) & weak
    evidence = (F.col("top_score") < F.col("score_floor")) & weak & (F.col("lexical_coverage") < F.col("coverage_floor"))
    hybrid = F.col("mode") == "hybrid"
    none = F.col("top_score").isNull()
    route = F.when(none | ~hybrid, None).when(vocabulary, "vocabulary").when(evidence, "evidence")
    rows = rows.withColumn("route", route).withColumn("no_strong_match", none | F.col("route").isNotNull())
    high = F.col("top_score") >= F.col("score_floor")
    confidence = F.when(none, "none").when(~hybrid, "unrated").when(F.col("route").isNotNull(), "low").when(high, "high").otherwise("medium")
    return rows.withColumn("confidence", confidence).withColumn("read_this_first", F.coalesce(F.col("route").isNotNull() & high, F.lit(False)))


def search(queries: DataFrame, docs: DataFrame | None, as_of: datetime, semantic: DataFrame | None = None, edges: DataFrame | None = None, floors: DataFrame | None = None, limit: int = CONFIG.limit, filters: Column | None = None, cfg: EngineConfig = CONFIG, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts): each corpus ranks by itself; refused queries give their three nearest as weak rows.

    With an index its documents are searched, and docs may be None.
    """
    docs = index.documents() if docs is None and index is not None else docs
    scored, stats = rank_one(queries, docs, as_of, semantic, cfg, filters, limit, index=index)
    top = scored.groupBy("query_id", "corpus").agg(F.max("score").alias("top_score"), F.max("phrase_score").alias("top_phrase"), F.max("raw").alias("best_raw"))
    best = stats.join(top, ["query_id", "corpus"], "left").withColumn("mode", F.lit("hybrid" if semantic is not None else "bm25-only")).fillna(0.0, ["top_phrase", "best_raw"])
    judged = verdict(best, cfg, floors)
    rows = graph_spread(scored, edges, cfg) if edges is not None else scored
    rows = archive_cap(slot_cap(rows, cfg.slots_per_document), limit, cfg.archive_share)
    rows = rows.join(judged.select("query_id", "corpus", "no_strong_match"), ["query_id", "corpus"])
    rows = rows.where(~F.col("no_strong_match") | (F.col("rank") <= cfg.weak_results)).withColumnRenamed("no_strong_match", "weak")
    return rows.withColumn("score", F.round("score", 4)), judged


def clean_phrasings(queries: DataFrame, phrasings: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, variant, query): other phrasings of each question, numbered from 1 in their order (``pos``).

    Blank ones, those that are the question itself or an earlier one but for letter case and marks, and those beyond ``most`` go.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    rows = phrasings.select("query_id", "pos", F.trim("query").alias("query")).withColumn("_norm", norm(F.col("query"))).where("_norm <> ''")
    rows = rows.join(queries.select("query_id", norm(F.col("query")).alias("_own")), "query_id").where("_norm <> _own")
    rows = rows.withColumn("_again", F.row_number().over(Window.partitionBy("query_id", "_norm").orderBy("pos"))).where("_again = 1")
    return rows.withColumn("variant", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("variant") <= most).select("query_id", "variant", "query")


@dataclass(frozen=True)
class Phrased:
    """rows: the question's own, with matched_via; via: what only other phrasings reached; runs: what became of each phrasing."""

    rows: DataFrame
    verdicts: DataFrame
    via: DataFrame
    runs: DataFrame


def search_phrasings(queries: DataFrame, phrasings: DataFrame, docs: DataFrame | None, as_of: datetime, semantic: DataFrame | None = None, edges: DataFrame | None = None, floors: DataFrame | None = None, limit: int = CONFIG.limit, filters: Column | None = None, cfg: EngineConfig = CONFIG, index: Index | None = None) -> Phrased:
    """A question and up to four other phrasings of it, ranked in one plan, with one verdict: the question's own.

    The question's rows never move: a phrasing can say that it reached one of them, and can add rows of its own under ``via``. A refused phrasing adds nothing; of others
    rows at or above the corpus's score floor count. A row of ``via`` has the best score that a phrasing gave it, the phrasings, what the question itself
    gave it in its whole ranking (``query_score``, 0 if nothing), and whether it stands among a refused question's nearest.
    semantic: (query_id, variant, corpus, doc_ord, cos), the question being variant 0.
    """
    run = F.struct("query_id", "variant")
    every = queries.select("query_id", F.lit(0).alias("variant"), "query").unionByName(clean_phrasings(queries, phrasings)).select(run.alias("query_id"), "query")
    sem = semantic.select(run.alias("query_id"), "corpus", "doc_ord", "cos") if semantic is not None else None
    docs = index.documents() if docs is None and index is not None else docs
    rows, verdicts = search(every, docs, as_of, sem, edges, floors, limit, filters, cfg, index)
    out = [c for c in rows.columns if c != "query_id"]
    rows = shared.written(rows.select("query_id.query_id", "query_id.variant", *out), "phrased")
    verdicts = shared.written(verdicts.select("query_id.query_id", "query_id.variant", *[c for c in verdicts.columns if c != "query_id"]), "verdicts")
    key, doc = ["query_id", "corpus"], ["query_id", "corpus", "doc_ord"]
    tag = F.when(F.col("variant") == 0, "query").otherwise(F.format_string("queries[%d]", F.col("variant") - 1))
    strong = rows.where("variant > 0 and not weak").join(verdicts.select(*key, "variant", F.col("score_floor").alias("_floor")), [*key, "variant"]).where("score >= _floor").drop("_floor")
    own = rows.where("variant = 0")
    said = lambda d: F.transform(F.array_sort(F.collect_set(F.struct("variant", tag.alias("tag")))), lambda x: x["tag"])
    labels = own.where("not weak").select(*doc, "variant").unionByName(strong.select(*doc, "variant")).groupBy(*doc).agg(said(None).alias("matched_via"))
    answered = own.join(labels, doc, "left").withColumn("matched_via", F.when(~F.col("weak"), F.col("matched_via"))).drop("variant")
    extra = strong.join(own.where("not weak").select(*doc), doc, "left_anti")
    best = extra.groupBy(*doc).agg(F.max_by(F.struct("name", "file", "score", "snippet"), F.struct("score", -F.col("variant"))).alias("x"), said(None).alias("matched_via"))
    best = shared.written(best, "via")
    # the question's own score of these documents, and of no others
    whole = candidates(queries, docs, semantic.where("variant = 0").drop("variant") if semantic is not None else None, filters=filters, cfg=cfg, index=index, only=best.select("corpus", "doc_ord").distinct())[0]
    mine = best.select(*doc).join(whole.select(*doc, "base"), doc)
    meta = index.of(best, ["tier", "in_memory_index", "modified"]) if index is not None else docs.select("corpus", "doc_ord", "tier", "in_memory_index", "modified")
    mine = mine.join(meta, ["corpus", "doc_ord"]).select(*doc, F.round(F.col("base") * envelope(as_of, cfg), 4).alias("_plain"))
    reranked = own.select(*doc, F.col("score").alias("_ranked"), F.col("weak").alias("_weak"))
    via = best.join(mine, doc, "left").join(reranked, doc, "left").select(*doc, "x.*", "matched_via", F.coalesce("_ranked", "_plain", F.lit(0.0)).alias("query_score"), F.coalesce("_weak", F.lit(False)).alias("also_best_weak"))
    counts = strong.groupBy(*key, "variant").agg(F.count(F.lit(1)).alias("strong_rows"))
    runs = verdicts.where("variant > 0").join(counts, [*key, "variant"], "left").select(*key, "variant", "no_strong_match", "confidence", F.round("top_score", 4).alias("top_score"), F.coalesce("strong_rows", F.lit(0)).alias("strong_rows"))
    return Phrased(answered, verdicts.where("variant = 0").drop("variant"), via, runs)


#: Words that name no topic: paths, files, hashes, versions, mixed letters and digits. Fixed values.
ID_WORDS = r"[/]|\.(md|json|js|mjs|txt)$|^[0-9a-f]{7,}$|^v\d"


def requery_terms(weak: DataFrame, docs: DataFrame | None, queries: DataFrame, cfg: EngineConfig = CONFIG, keep: int = 6, index: Index | None = None) -> DataFrame:
    """(query_id, corpus, term, weight, pos): words of the weak documents that could make a better question.

    weak: (query_id, corpus, doc_ord, rank). Each word of a name counts three times, of a heading twice, of a description
    once, all by 1 / (1 + (rank - 1) / 2) and by its idf over the corpus. Words of the query, words in over a quarter
    of the files, labels in over max(2, 10 %) of the names and id-like words go. Terms are surface forms, the
    first that was met of each stem. index: read in place of docs; then no text is tokenised, frequencies and the weak documents come out of files.
    """
    whole = docs
    if index is not None:
        weak, docs = shared.written(weak, "weak"), index.documents()
        whole = index.of(weak, ["name", "description", *[c for c in ("headings",) if c in docs.columns]])
    heads = F.col("headings") if "headings" in docs.columns else F.array().cast("array<string>")
    trim = lambda t: F.regexp_replace(t, r"^[.\-/+]+|[.\-/+]+$", "")
    said = lambda c, w: F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z][a-z0-9][a-z0-9.+/-]*)"), F.lit(1)), lambda t: F.struct(trim(t).alias("surface"), F.lit(w).alias("w")))
    label = F.regexp_replace("name", "[-_]", " ")
    parts = F.concat(said(label, 3.0), said(F.array_join(heads, "\n"), 2.0), said(F.col("description"), 1.0))
    near = weak.join(whole.select("corpus", "doc_ord", F.posexplode(parts).alias("at", "x")).select("corpus", "doc_ord", "at", "x.*"), ["corpus", "doc_ord"])
    mixed = F.col("surface").rlike("[0-9]") & (F.length("surface") >= 5)
    near = near.where((F.length("surface") >= 3) & ~F.col("surface").isin(*STOP_WORDS) & ~F.col("surface").rlike(ID_WORDS) & ~mixed).withColumn("term", T.stem(F.col("surface")))
    near = shared.written(near.join(keyword.query_terms(queries), ["query_id", "term"], "left_anti"), "near")
    own = near.select("term").distinct()
    if index is not None:
        stats = index.stats(cfg)
        idf = index.document_frequency(own).join(F.broadcast(stats.select("corpus", "n_docs")), "corpus").select("corpus", "term", S.idf(F.col("n_docs"), F.col("df")).alias("idf"))
    else:
        tokens = keyword.field_tokens(docs)
        stats = keyword.corpus_stats(keyword.lengths(tokens, cfg))
        idf = keyword.document_frequency(keyword.postings(tokens, own, cfg), stats)
    said_names = docs.select("corpus", "doc_ord", F.explode(F.array_distinct(T.tokenize(label))).alias("term")).join(keyword._bounded(own), "term", "left_semi")
    names = said_names.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("labels"))
    known = idf.join(F.broadcast(stats.select("corpus", "n_docs")), "corpus").join(names, ["corpus", "term"], "left")
    known = known.where((F.col("idf") >= S.idf(F.col("n_docs"), F.col("n_docs") / 4)) & (F.coalesce("labels", F.lit(0)) <= F.greatest(F.lit(2), F.ceil(0.1 * F.col("n_docs"))))).select("corpus", "term", "idf")
    rows = near.join(known, ["corpus", "term"]).groupBy("query_id", "corpus", "term").agg(F.sum(F.col("w") * F.col("idf") / (1 + 0.5 * (F.col("rank") - 1))).alias("weight"), F.min_by("surface", F.struct("rank", "at")).alias("surface"))
    w = Window.partitionBy("query_id", "corpus").orderBy(F.desc(F.round("weight", 9)), "surface")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= keep).select("query_id", "corpus", F.col("surface").alias("term"), "weight", "pos")
