"""Curation: corpus profile, exclusion gates, routing, supersession, consolidation queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomery.config import CONFIG, STOP_WORDS, EngineConfig
from loomery.functions import redact as R, text as T

#: What shows that a text is about code, with its weight. Fixed values.
CODE_SIGNALS = (
    ("code_fence", r"```", 0.30),
    ("file_path", r"[\w.\-]+/[\w./\-]+\.(js|ts|py|json|md|sh|yml|yaml|html|css|go|rs|java)(?![A-Za-z0-9_])", 0.25),
    ("const_case", r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]+(_[A-Z0-9]+)+(?![A-Za-z0-9_])", 0.15),
    ("sha_like", r"(?<![A-Za-z0-9_])[0-9a-f]{7,10}(?![A-Za-z0-9_])", 0.15),
    ("flag", r"(^|[\x20\x09-\x0D])--[a-z][a-z0-9\-]{2,}", 0.10),
    ("func_call", r"(?<![A-Za-z0-9_])[a-zA-Z_$][\w$]*\([^)]{0,40}\)", 0.05),
)
CODE_AT, PROSE_AT = 0.08, 0.03


def proseness(text: Column) -> Column:
    """A10: sentence length less symbols, 0 to 1; null below 100 characters."""
    t = F.coalesce(text, F.lit(""))
    sentences = F.filter(F.split(t, r"[.!?]+\s"), lambda s: F.length(F.trim(s)) > 20)
    words = F.aggregate(sentences, F.lit(0), lambda n, s: n + F.size(F.split(s, r"\s+"))) / F.size(sentences)
    symbols = F.length(F.regexp_replace(t, r"[^{}()\[\]<>|=;$#]", "")) / F.length(t)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), words / 25 * (1 - F.least(F.lit(1.0), symbols * 40))))
    return F.when(F.length(t) < 100, None).when(F.size(sentences) == 0, 0.0).otherwise(share)


def corpus_profile(docs: DataFrame) -> DataFrame:
    """A10: share of each code signal over all documents, their weighted sum, mean proseness, the domain that they mean and how sure it is.

    Counted over every document: one aggregate costs no more than a sample does.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(body.rlike(p).cast("double")), 3).alias(name) for name, p, _ in CODE_SIGNALS], F.round(F.coalesce(F.avg(proseness(body)), F.lit(0.0)), 3).alias("prose_score"))
    score = sum((F.col(name) * w for name, _, w in CODE_SIGNALS), F.lit(0.0))
    rows = rows.withColumn("code_score", F.round(score, 3))
    rows = rows.withColumn("domain", F.when(F.col("code_score") >= CODE_AT, "code").when(F.col("code_score") <= PROSE_AT, "prose").otherwise("mixed"))
    sure = F.when(F.col("domain") == "code", F.least(F.lit(1.0), 0.5 + F.col("code_score"))).when(F.col("domain") == "prose", F.least(F.lit(1.0), 0.6 + F.col("prose_score") * 0.4)).otherwise(0.45)
    return rows.withColumn("confidence", F.round(sure, 2))


def gate(docs: DataFrame, denied: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents that may be indexed, excluded ones with why): denied names, marked secret, unreadable, open front matter."""
    reason = F.when(F.lower(F.element_at(F.split("file", "/"), -1)).isin(*[d.lower() for d in denied] or [""]), "denylisted").when(F.coalesce(F.col("secret"), F.lit(False)), "secret").when(F.col("body").isNull(), "unreadable").when(F.col("open_frontmatter"), "unterminated-front-matter")
    rows = docs.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("corpus", "file", "reason")


#: Shapes of code in a question: hash, path, constant, flag, call. Fixed values.
QUERY_CODE_SHAPES = (
    r"\b[0-9a-f]{7,40}\b",
    r"\b[\w.-]+/[\w./-]+\.[a-z]{1,5}\b",
    r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b",
    r"(?:^|\s)--[a-z][a-z0-9-]{2,}\b",
    r"\b[a-z][\w$]*\(\)",
)
#: Phrasings of past events, of standing rules and of handoff documents. Fixed values.
EVENT_MARKERS = r"\b(that night|last night|yesterday|earlier|this morning|when we|what did we|did we ever|we decided|we said|at the time|back then|during (the|that))\b"
RULE_MARKERS = r"\b(what is the rule|how do i|how should|what should i|the rule about|policy|convention|always|never)\b"
HANDOFF_MARKERS = r"\b(hand-?off|handed over|handing over|phase\s*\d|where (did|do) (we|i) leave|picking (this|it) up|next session|state of (the|this) (project|campaign|work|effort))\b"
#: How a question asks to read a document. Fixed value.
READ_VERB = r"^\s*(?:summari[sz]e|(?:give\s+me\s+)?(?:an?\s+)?(?:summary|overview)\s+of)\b[:,]?\s*"


def matches(text: Column, pattern: str, any_case: bool = False) -> Column:
    """Whether an ASCII pattern occurs; null text has nothing."""
    return F.coalesce(F.lower(text) if any_case else text, F.lit("")).rlike(T.edged(pattern))


def looks_technical(query: Column) -> Column:
    """F13"""
    found = F.lit(False)
    for shape in QUERY_CODE_SHAPES:
        found = found | matches(query, shape)
    return found


def route_scope(query: Column, other_projects: bool = False) -> Column:
    """``all`` for handoff and event phrasings, and for every question while another project has memories; else ``curated``."""
    event, rule, handoff = (matches(query, p, any_case=True) for p in (EVENT_MARKERS, RULE_MARKERS, HANDOFF_MARKERS))
    return F.when(handoff | (event & ~rule) | F.lit(other_projects), "all").otherwise("curated")


def read_task(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """questions that ask to read one document: a summary phrase at the start, or the slug of its name (eight letters or more)."""
    ask = F.lower(F.coalesce("query", F.lit("")))
    verb = T.edged(READ_VERB)
    rest = F.regexp_replace(F.regexp_replace(ask, verb, ""), r"^(?:the|an?)\s+", "")
    asks = queries.select("query_id", ask.rlike(verb).alias("has_verb"), T.slug(rest, None).alias("slug"))
    names = docs.select("corpus", "doc_ord", T.slug(F.col("name"), None).alias("slug")).where(F.length("slug") >= 8)
    return asks.join(names, "slug", "left").groupBy("query_id").agg(F.first("has_verb").alias("has_verb"), F.min("doc_ord").alias("doc_ord"))


#: Words with which a speaker withdraws a claim of their own. Fixed value.
CORRECTION = r"\b(i was wrong|i were wrong|i got .{0,20}wrong|that was wrong|(my|the|that|my earlier|my last) [a-z ]{0,24}(claim|comment|answer|statement|note|advice|reading|assumption)[a-z ]{0,12} was wrong|correction:|i owe you a correction|i misread|i misremembered|i was mistaken|no longer (true|the case|accurate)|scratch that)\b"


#: A sentence that says the older document was right, and one that only announces a correction. Fixed values.
CONFIRMS = r"\b(the )?memor(y|ies)( note| file)? (says|said|does record|records|has|is right|was right)\b|\bmemory does record\b"
PREAMBLE = r"\b(let me (check|verify|look|re-?read|confirm)|before I answer|i'll check|going to check)\b"
ASKED = "**Asked:**"


def assistant_half(body: Column) -> Column:
    """What an exchange's body says after the paragraph of the question; all of it where there is none."""
    t = F.coalesce(body, F.lit(""))
    at = F.instr(t, ASKED)
    after = F.substring(t, at, F.length(t))
    stop = F.instr(after, "\n\n")
    return F.when(at == 0, t).when(stop == 0, "").otherwise(F.substring(after, stop + 2, F.length(t)))


def claims(exchanges: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Exchanges whose reply withdraws something, with ``phrase``, ``claim`` (the sentence), ``claim_terms`` and ``query`` to search older documents with.

    exchanges: query_id, name, description, body, modified. The sentence goes from the stop before the first phrase of withdrawal to the next one after it, 400 characters at most. Its terms
    are words of four characters or more without the phrase and stop words. Sentences that confirm the older document or only announce a correction are vetoed.
    """
    # each step is a generated column: a filter on it is not pushed below, where it would compute the text's expressions again
    rows = exchanges.select("*", F.explode(F.array(assistant_half(F.col("body")))).alias("_text"))
    rows = rows.select("*", F.explode(F.filter(F.array(F.regexp_extract("_text", f"(?i){T.edged(CORRECTION)}", 0)), lambda p: p != "")).alias("phrase"))
    rows = rows.select("*", F.explode(F.array(F.instr(F.lower("_text"), F.lower("phrase")))).alias("_at"))
    at, size = F.col("_at"), F.length("phrase")
    before = F.substring("_text", F.lit(1), at - 1)
    start = F.length(before) - F.length(F.substring_index(before, ".", -1))
    stop = F.instr(F.substring("_text", at + size, F.length("_text")), ".")
    rows = rows.select("*", F.explode(F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("_x"))
    first, stop = F.col("_x.start"), F.col("_x.stop")
    end = F.when(stop > 0, at + size + stop - 1).otherwise(F.least(F.length("_text"), at - 1 + 260) + 1)
    vetoed = lambda c: c.rlike(f"(?i){T.edged(CONFIRMS)}") | c.rlike(f"(?i){T.edged(PREAMBLE)}")
    rows = rows.select("*", F.explode(F.filter(F.array(F.substring("_text", first + 1, F.least(end - first, F.lit(400)))), lambda c: ~vetoed(c))).alias("claim"))
    words = F.regexp_extract_all(F.replace(F.lower("claim"), F.lower("phrase"), F.lit(" ")), F.lit(r"([a-z][a-z0-9_.-]{3,})"), F.lit(1))
    terms = F.array_distinct(F.filter(words, lambda t: ~t.isin(*stop_words)))
    ask = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.substring(F.coalesce("body", F.lit("")), 1, 300))
    return rows.withColumn("claim_terms", terms).withColumn("query", ask).drop("_text", "_at", "_x")


def supersessions(claimed: DataFrame, hits: DataFrame, docs: DataFrame, cfg: EngineConfig = CONFIG) -> DataFrame:
    """(corpus, doc_ord, name, by, score, days, share, passes, claim): older documents that corrections are about, the best correction of each.

    claimed: claims(); hits: (query_id, corpus, doc_ord, name, score, rank) of a search with their queries. Of each correction the *first* of its three best hits counts that is another document, scores
    ``supersede_score`` or more and is older: a grouped minimum of ranks over the hits that are left. ``passes``: the target's text holds enough of the claim's terms, as substrings.
    """
    near = hits.where((F.col("rank") <= 3) & (F.col("score") >= cfg.supersede_score)).select("query_id", "corpus", "doc_ord", F.col("name").alias("target"), "score", "rank")
    own = claimed.select("query_id", F.col("name").alias("by"), F.col("modified").alias("at"), "claim", "claim_terms")
    rows = near.join(own, "query_id").where("target <> by").join(docs.select("corpus", "doc_ord", "modified"), ["corpus", "doc_ord"]).where("modified < at")
    first = rows.groupBy("query_id").agg(F.min_by(F.struct("corpus", "doc_ord", "target", "score", "by", "claim", "claim_terms", (F.unix_millis("at") - F.unix_millis("modified")).alias("ms")), F.struct("rank", "corpus")).alias("x"))
    best = first.groupBy("x.corpus", "x.doc_ord").agg(F.max_by("x", F.struct("x.score", -F.col("query_id"))).alias("x"))
    said = best.join(docs.select("corpus", "doc_ord", F.lower(F.coalesce("body", F.lit(""))).alias("_body")), ["corpus", "doc_ord"])
    held = F.size(F.filter("x.claim_terms", lambda t: F.contains(F.col("_body"), t)))
    said = said.withColumn("held", held).withColumn("share", F.when(F.size("x.claim_terms") >= cfg.supersede_terms, F.col("held") / F.size("x.claim_terms")).otherwise(0.0))
    passes = (F.col("held") >= cfg.supersede_terms) & (F.col("share") >= cfg.supersede_share)
    return said.select("corpus", "doc_ord", F.col("x.target").alias("name"), "x.by", "x.score", (F.col("x.ms") / 86_400_000.0).alias("days"), "share", passes.alias("passes"), "x.claim")


def consolidation_queue(docs: DataFrame, superseded: DataFrame, proposals: DataFrame) -> DataFrame:
    """What a curator should look at: (kind, corpus, doc_ord, detail)."""
    from .structure import duplicate_names

    parts = [
        docs.where(R.has_secret(F.col("body"))).select(F.lit("secret-review").alias("kind"), "corpus", "doc_ord", F.lit("").alias("detail")),
        duplicate_names(docs).select(F.lit("name-collision").alias("kind"), "corpus", "doc_ord", F.col("name").alias("detail")),
        superseded.select(F.lit("supersession-candidate").alias("kind"), "corpus", "doc_ord", F.col("by").alias("detail")),
        docs.where(F.coalesce(F.trim("description"), F.lit("")) == "").select(F.lit("write-description").alias("kind"), "corpus", "doc_ord", F.lit("").alias("detail")),
        proposals.join(docs.select("corpus", "doc_ord"), "doc_ord").select(F.lit("probe-proposal").alias("kind"), "corpus", "doc_ord", F.col("probe").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Kinds of statements that age, and what shows them in a line. Fixed values.
CURRENCY_MARKS = (
    ("version-token", r"\b(?:v\d{2,3}|Mac v\d+|Win v\d+)\b"),
    ("status-flag", r"(?m)^.*(?:🟥|✅|⚠️).*$"),
    ("dated-correction", r"(?im)^.*\b(?:corrected|fixed|superseded|updated|changed|ruled|shipped|landed|as of)\b.*\b20\d\d-\d\d(?:-\d\d)?\b.*$"),
    ("count-claim", r"(?im)^.*\b\d{1,6}\s+(?:files?|docs?|documents?|memories|entries|commits?|chunks?|tests?|cases?|rows?|models?|dirs?|directories|roots?|probes?|barges?)\b.*$"),
    ("port-or-flag", r"(?m)^.*\b(?:port\s+\d{4,5}|:\d{4,5}\b|MEMORY_[A-Z_]+|EB_[A-Z_]+|QSB_[A-Z_]+).*$"),
)


def currency_candidates(docs: DataFrame, per_kind: int = 8) -> DataFrame:
    """(corpus, doc_ord, markers, versions, hits): documents with statements that age, the first ``per_kind`` of each kind
    as a report; those with most of them come first for a reader. Only a line feed ends a line."""
    body = F.coalesce("body", F.lit(""))
    mark = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), F.substring(F.trim(m), 1, 160).alias("line"))
    hits = F.flatten(F.array(*[F.transform(F.slice(F.regexp_extract_all(body, F.lit("(?d)" + T.edged(p)), F.lit(0)), 1, per_kind), mark(k)) for k, p in CURRENCY_MARKS]))
    versions = F.slice(F.array_distinct(F.regexp_extract_all(body, F.lit(T.edged(r"\b(v\d{2,3})\b")), F.lit(1))), 1, 10)
    return docs.select("corpus", "doc_ord", F.size(hits).alias("markers"), versions.alias("versions"), hits.alias("hits")).where("markers > 0")


def pick_token(texts: DataFrame) -> DataFrame:
    """(doc_ord, token, n): of each text the token that it says least often: shaped ones before plain ones, then longer
    ones, then by code points. Front matter, stop words, bare numbers, tokens of over 40 letters and secrets are no subjects."""
    hay = F.regexp_replace(F.lower(F.coalesce("body", F.lit(""))), r"^---\n[\s\S]*?\n---\n", "")
    raw = F.transform(F.regexp_extract_all(hay, F.lit(r"([a-z0-9][a-z0-9._-]{5,})"), F.lit(1)), lambda t: F.regexp_replace(t, r"[.\-_]+$", ""))
    good = F.filter(raw, lambda t: (F.length(t) >= 6) & (F.length(t) <= 40) & ~t.isin(*STOP_WORDS) & ~t.rlike(r"^\d[\d.]*$"))
    rows = texts.select("doc_ord", F.explode(good).alias("token")).groupBy("doc_ord", "token").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.where(~R.has_secret(F.col("token"))).withColumn("plain", (~F.col("token").rlike("[-_.0-9]")).cast("int"))
    return rows.groupBy("doc_ord").agg(F.min(F.struct("n", "plain", (-F.length("token")).alias("short"), "token")).alias("b")).select("doc_ord", "b.token", "b.n")
