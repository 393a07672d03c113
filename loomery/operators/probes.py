"""Probes: claims of documents that tables can check, verdicts of a sweep, and drafts of new ones.

files: (path, text); refs: (repo, ref, sha, peeled), ref by its full name, peeled the commit behind a tag;
commits: (repo, sha, at, on_mainline).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomery.functions import text as T

#: Predicates that a probe may name: those that run by default, and those that need the level "all". Fixed values.
CHEAP = ("file_exists", "file_hash_span", "grep_count", "git_tag_exists", "git_rev_count", "git_rev_parse", "date_past")
COSTLY = ("port_listening", "http_status", "sqlite_query_ro", "cmd_output_matches")
#: What no path may hold, and the shapes of a reference to a commit. Fixed values.
REFUSED = r"[;&|\x60$<>(){}\\\n\r\"']"
GIT_REF = r"^(?:[A-Za-z0-9._^~/-]+(?:\.\.\.?[A-Za-z0-9._^~/-]+)?(?:\^\{(?:commit|tag|tree|blob|object)?\})?|--since=[0-9T:.Z+-]+)$"

#: Bytes of texts and literals of one path that meet in a block, bytes that are looked through at a time (whole lines), and most cells of a trie's table.
BLOCK_BYTES, BLOCK_LITERALS, PIECE_BYTES, TABLE_CELLS = 16_000_000, 100_000, 1_000_000, 1 << 24


def parse_probe(probe: Column) -> Column:
    """Predicate and arguments of ``predicate a :: b``."""
    line = F.trim(F.coalesce(probe, F.lit("")))
    rest = F.regexp_extract(line, r"(?s)^\S* (.*)$", 1)
    args = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(rest, " :: "), lambda s: F.trim(s)))
    return F.struct(F.substring_index(line, " ", 1).alias("predicate"), args.alias("args"))


def matches_expected(actual: Column, expected: Column) -> Column:
    """~text is contained in any case, >= <= > < and a number compare numbers (what is none never fits), else equality."""
    e, a = F.trim(F.coalesce(expected, F.lit(""))), F.trim(F.coalesce(actual, F.lit("")))
    shape = r"^(>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)$"
    op, right = F.regexp_extract(e, shape, 1), F.regexp_extract(e, shape, 2).try_cast("double")
    left = F.when(a == "", F.lit(0.0)).otherwise(a.try_cast("double"))
    number = F.when(op == ">=", left >= right).when(op == "<=", left <= right).when(op == ">", left > right).otherwise(left < right)
    return F.when(e.startswith("~"), F.contains(F.lower(a), F.lower(F.trim(F.substring(e, 2, 1 << 30))))).when(op != "", F.coalesce(number, F.lit(False))).otherwise(a == e)


def _above(path: Column) -> Column:
    """A path and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, n), "/"), F.lit("")), F.lit("/")))


class _Trie:
    """The literals of several paths, each path with a root of its own (1 and up; 0 is nowhere), over bytes."""

    def __init__(self, roots: int, literals: list[tuple[int, bytes]], stop: int = 10):
        # a literal with a line break is in no line
        self.rank = np.zeros(256, np.int64)
        used = sorted({b for _, text in literals for b in text} - {stop})
        self.rank[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        edges: dict[int, int] = {}
        self.ends, nodes = {}, roots + 1
        for n, (root, text) in enumerate(literals):
            if stop not in text:
                at = root
                for r in self.rank[list(text)].tolist():
                    step = at * self.width + r
                    if step not in edges:
                        edges[step], nodes = nodes, nodes + 1
                    at = edges[step]
                self.ends[at] = n
        self.end = np.full(nodes, -1)
        self.end[list(self.ends)] = list(self.ends.values())
        self.steps = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.steps.tolist()], np.int64)
        self.table = None
        if nodes * self.width <= TABLE_CELLS:
            self.table = np.zeros(nodes * self.width, np.int32)
            self.table[self.steps] = self.to

    def walk(self, at: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where each of the nodes ``at`` leads by its byte, 0 for nowhere."""
        step = at * self.width + byte
        if self.table is not None:
            return np.where(byte > 0, self.table[step], 0)
        if not len(self.steps):
            return np.zeros(len(at), np.int64)
        near = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        return np.where((byte > 0) & (self.steps[near] == step), self.to[near], 0)


def _count_lines(literals: pa.Table, texts: pa.Table, stop: int = 10) -> pa.Table:
    """(a0, a1, n): how many lines of the path's texts hold each literal (a0, a1); ``stop``: the byte that ends a line.

    All places of all texts walk the trie of their path's literals at once, a byte at a time; places that leave it are dropped.
    """
    names = literals.column("a0").combine_chunks().dictionary_encode() if len(literals) else pa.array([], pa.string()).dictionary_encode()
    trie = _Trie(len(names.dictionary), list(zip((np.asarray(names.indices) + 1).tolist(), literals.column("a1").cast(pa.binary()).to_pylist())), stop)
    counts = np.zeros(len(literals), np.int64)
    own = np.asarray(pc.fill_null(pc.index_in(texts.column("a0"), value_set=names.dictionary), -1)).astype(np.int64) + 1
    if len(texts):
        flat = pc.binary_join_element_wise(texts.column("text").cast(pa.binary()).combine_chunks(), b"", bytes([stop]))
        offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
        data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        last = np.flatnonzero(data == stop) + 1
        size = np.diff(last, prepend=0)
        root = own[np.searchsorted(offsets - offsets[0], last - size, side="right") - 1]
        cuts = [0, *(np.flatnonzero(np.diff(last // PIECE_BYTES)) + 1).tolist(), len(last)]
        for i, j in zip(cuts, cuts[1:]):
            byte = trie.rank[data[last[i] - size[i] : last[j - 1]]]
            at, line, place = np.repeat(root[i:j], size[i:j]), np.repeat(np.arange(j - i), size[i:j]), np.arange(len(byte))
            held = []
            while len(place):  # the line break ends every walk
                at = trie.walk(at, byte[place])
                at, place, line = at[at > 0], place[at > 0] + 1, line[at > 0]
                hit = trie.end[at]
                held.append((hit * (j - i) + line)[hit >= 0])
            counts += np.bincount(np.unique(np.concatenate(held)) // (j - i), minlength=len(counts))
    return pa.table({"a0": literals.column("a0"), "a1": literals.column("a1"), "n": counts})


def _line_counts(greps: DataFrame, below: DataFrame | None, files: DataFrame, stop: int = 10) -> DataFrame:
    """(a0, a1, n): how many lines of the files at or below the path a0 hold the literal a1.

    A path's files are dealt over blocks, and its literals go to each of these: a text is read once for all literals of a path, and no pair of a
    literal and a file is a row. greps: distinct (a0, a1); below: distinct (path, key), None where each row of files has its one a0.
    """
    n, size = files.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    tasks, size = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), size or 0
    blocks = max(1, -(-size // BLOCK_BYTES), min(tasks, size // PIECE_BYTES))
    each = max(1, -(-n // blocks))
    asked = greps.groupBy("a0").agg(F.ceil(F.count(F.lit(1)) / BLOCK_LITERALS).cast("int").alias("parts"))
    of = files.select("path", "a0") if below is None else below.withColumnRenamed("key", "a0")
    dealt = of.join(asked, "a0").groupBy("a0", "parts").agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias("shares"))
    block = lambda share, part: F.pmod(F.xxhash64("a0") + share * F.col("parts") + part, F.lit(blocks)).alias("block")
    literals = greps.join(dealt, "a0").select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    literals = literals.select(block(F.col("share"), F.pmod(F.xxhash64("a1"), F.col("parts"))), "a0", "a1").distinct()
    full = files.join(dealt, "a0") if below is None else of.join(dealt, "a0").join(files, "path")
    texts = full.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    texts = texts.select(block(F.pmod(F.xxhash64("path"), F.col("shares")), F.col("part")), "a0", F.coalesce("text", F.lit("")).alias("text"))
    count = lambda asks, own: _count_lines(asks, own, stop)
    found = literals.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(count, "a0 string, a1 string, n long")
    return found.groupBy("a0", "a1").agg(F.sum("n").alias("n"))


def holding(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(a0, a1) of the terms that a text of their own group holds, letter by letter. terms: distinct (a0, a1); texts: (a0, path, text), path any label."""
    return _line_counts(terms, None, texts, stop=255).where("n > 0").select("a0", "a1")  # no UTF-8 text has this byte


def _of_files(asks: DataFrame, files: DataFrame) -> DataFrame:
    """(predicate, a0, a1, actual, state) of the predicates on files. A folder is there if a file lies below it.

    Files meet only the paths that are asked for; texts meet only the paths that are to be read.
    """
    asks = asks.where(F.col("predicate").isin("file_exists", "file_hash_span", "grep_count"))
    parent = F.when(F.contains("a0", F.lit("/")), F.coalesce(F.nullif(F.regexp_replace("a0", r"/[^/]*$", ""), F.lit("")), F.lit("/")))
    asks = asks.withColumn("parent", parent)
    wanted = asks.select(F.explode(F.array_compact(F.array("a0", "parent"))).alias("key")).distinct()
    below = files.select("path").distinct().select("path", F.explode(_above(F.col("path"))).alias("key")).join(wanted, "key")
    there = below.select("key").distinct()
    asks = asks.join(there.select(F.col("key").alias("a0"), F.lit(True).alias("found")), "a0", "left").join(there.select(F.col("key").alias("parent"), F.lit(True).alias("reachable")), "parent", "left")
    text = F.split(F.coalesce("text", F.lit("")), "\n")
    greps = asks.where("predicate = 'grep_count' and a1 <> ''").select("a0", "a1")
    counted = _line_counts(greps, below, files).select("a0", "a1", F.col("n").cast("string").alias("value"), F.lit("grep_count").alias("predicate"))
    span = lambda g: F.regexp_extract("a1", r"^(\d{1,9})-(\d{1,9})$", g).try_cast("int")
    spans = asks.where("predicate = 'file_hash_span'").select("a0", "a1", span(1).alias("first"), span(2).alias("last")).join(files.withColumnRenamed("path", "a0"), "a0").withColumn("lines", text)
    inside = (F.col("first") >= 1) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.size("lines"))
    hashed = spans.where(inside).select("a0", "a1", F.substring(F.sha2(F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n"), 256), 1, 12).alias("value"), F.lit("file_hash_span").alias("predicate"))
    rows = asks.join(counted.unionByName(hashed), ["predicate", "a0", "a1"], "left")
    found, exists, grep = F.col("found").isNotNull(), F.col("predicate") == "file_exists", F.col("predicate") == "grep_count"
    state = (
        F.when(F.col("a0").rlike(REFUSED), "refused")
        .when(exists, F.when(F.col("parent").isNotNull() & F.col("reachable").isNull() & ~found, "gone").otherwise("ok"))
        .when(~found, "gone")
        .when(grep, F.when(F.col("a1") == "", "refused").otherwise("ok"))
        .when(F.col("a1").rlike(r"^\d{1,9}-\d{1,9}$"), F.when(F.col("value").isNull(), "gone").otherwise("ok"))
        .otherwise("refused")
    )
    return rows.select("predicate", "a0", "a1", F.when(exists, found.cast("string")).otherwise(F.col("value")).alias("actual"), state.alias("state"))


def _of_git(asks: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """The same of the predicates on repositories. A reference is a name (in full, or of a tag or branch, in this
    order), with ^{} for the commit behind it, or a whole hash; counts are of HEAD, or of HEAD since a time.
    Other ranges are errors."""
    asks = asks.where(F.col("predicate").isin("git_tag_exists", "git_rev_count", "git_rev_parse"))
    repos = refs.select(F.col("repo").alias("a0"), F.lit(True).alias("known")).distinct()
    base = F.regexp_replace("a1", r"\^\{[a-z]*\}$", "")
    asks = asks.join(repos, "a0", "left").withColumn("base", base).withColumn("peel", F.col("base") != F.col("a1"))
    tags = F.array(F.concat(F.lit("refs/tags/"), "a1"))
    names = F.when(F.col("predicate") == "git_tag_exists", tags).otherwise(F.array("base", F.concat(F.lit("refs/"), "base"), F.concat(F.lit("refs/tags/"), "base"), F.concat(F.lit("refs/heads/"), "base")))
    tried = asks.where("predicate <> 'git_rev_count'").select("predicate", "a0", "a1", "base", "peel", F.posexplode(names).alias("n", "ref"))
    named = tried.join(refs.select(F.col("repo").alias("a0"), "ref", "sha", "peeled"), ["a0", "ref"])
    named = named.select("predicate", "a0", "a1", "n", F.when(F.col("peel"), F.coalesce("peeled", "sha")).otherwise(F.col("sha")).alias("sha"))
    whole = asks.where("predicate = 'git_rev_parse' and length(base) = 40").join(commits.select(F.col("repo").alias("a0"), F.col("sha").alias("base")).distinct(), ["a0", "base"])
    named = named.unionByName(whole.select("predicate", "a0", "a1", F.lit(-1).alias("n"), F.col("base").alias("sha")))
    hit = named.groupBy("predicate", "a0", "a1").agg(F.min_by("sha", "n").alias("sha"))
    since = F.regexp_extract("a1", r"^--since=(.*)$", 1).try_cast("timestamp")
    counts = asks.where("predicate = 'git_rev_count'").select("predicate", "a0", "a1", since.alias("since")).where("a1 = 'HEAD' or since is not null")
    main = commits.where("on_mainline").select(F.col("repo").alias("a0"), F.col("at").cast("timestamp").alias("at"))
    n = counts.join(main, "a0", "left").groupBy("predicate", "a0", "a1").agg(F.count(F.when(F.col("at") >= F.coalesce("since", "at"), 1)).cast("string").alias("n"))
    rows = asks.join(hit, ["predicate", "a0", "a1"], "left").join(n, ["predicate", "a0", "a1"], "left")
    tag = F.col("predicate") == "git_tag_exists"
    actual = F.when(tag, F.col("sha").isNotNull().cast("string")).otherwise(F.coalesce("sha", "n"))
    shape = F.when(tag, F.col("a1").rlike(REFUSED)).otherwise(~F.col("a1").rlike(GIT_REF))
    state = F.when(F.col("a0").rlike(REFUSED), "refused").when(F.col("known").isNull(), "gone").when(shape, "refused").when(actual.isNull(), "error").otherwise("ok")
    return rows.select("predicate", "a0", "a1", actual.alias("actual"), state.alias("state"))


def sweep(docs: DataFrame, files: DataFrame, refs: DataFrame, commits: DataFrame, as_of: Column, level: str = "cheap") -> DataFrame:
    """(corpus, doc_ord, name, predicate, actual, verdict, reason) of each document with a probe or an expiry; not of sections.

    FRESH and STALE compare; UNPROVABLE: what the claim hangs on is gone; UNKNOWN: everything that could not be
    run, never STALE. A passed ``valid_until`` is STALE before anything else. Equal probes are evaluated once.
    docs: corpus, doc_ord, name, probe, probe_expected, valid_until (any may be null); an empty table gives no rows.
    """
    rows = docs.where("nullif(probe, '') is not null or valid_until is not null")
    if "parent_name" in docs.columns:
        rows = rows.where("parent_name is null")
    p = parse_probe(F.col("probe"))
    rows = rows.select("corpus", "doc_ord", "name", "probe", "probe_expected", (F.col("valid_until").cast("timestamp") < as_of).alias("expired"), F.when(F.col("probe") != "", p["predicate"]).alias("predicate"), *[F.coalesce(F.get(p["args"], F.lit(k)), F.lit("")).alias(f"a{k}") for k in (0, 1)])
    none = F.nullif(F.coalesce("probe", F.lit("")), F.lit("")).isNull()
    early = (
        F.when(F.coalesce("expired", F.lit(False)), "expired").when(none, "no-probe").when(F.lit(level) == "off", "level-off")
        .when(~F.col("predicate").isin(*CHEAP, *COSTLY), "unknown-predicate").when(F.col("predicate").isin(*COSTLY), "not-of-tables" if level == "all" else "needs-level-all")
        .when(F.coalesce("probe_expected", F.lit("")) == "", "no-expected")
    )
    rows = rows.withColumn("early", early)
    asks = rows.where("early is null").select("predicate", "a0", "a1").distinct()
    when = F.col("a0").try_cast("timestamp")
    dates = asks.where("predicate = 'date_past'").select("predicate", "a0", "a1", (when < as_of).cast("string").alias("actual"), F.when(when.isNull(), "refused").otherwise("ok").alias("state"))
    known = dates.unionByName(_of_files(asks, files)).unionByName(_of_git(asks, refs, commits))
    rows = rows.join(known, ["predicate", "a0", "a1"], "left")
    ok = F.col("early").isNull() & (F.col("state") == "ok")
    fits = matches_expected(F.col("actual"), F.col("probe_expected"))
    verdict = F.when(F.col("early") == "expired", "STALE").when(F.col("early").isNotNull(), "UNKNOWN").when(ok, F.when(fits, "FRESH").otherwise("STALE")).when(F.col("state") == "gone", "UNPROVABLE").otherwise("UNKNOWN")
    reason = F.coalesce("early", F.when(ok, F.when(~fits, "mismatch")).otherwise(F.col("state")))
    return rows.select("corpus", "doc_ord", "name", "predicate", F.when(ok, F.col("actual")).alias("actual"), verdict.alias("verdict"), reason.alias("reason"))


#: Families of ship tags; shapes of tags, hashes, addresses and paths in a line; hosts that are local; folders whose files
#: come and go, and those that other machines have. Fixed values.
TAG_FAMILIES = ("macwin", "universal", "windows", "mac")
SHA = r"(?:^|[\s\x60(\[{|,*])([0-9a-f]{7,40})\b"
URL = r"\bhttps?://[A-Za-z0-9.:_-]+(?::\d+)?(?:/[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]*)?"
QUOTED = r"\x60([^\x60]+)\x60"
FILE_PATH = r"^/(?:[^\s\x60]+/)+[^\s\x60/]+\.[A-Za-z0-9]{1,6}$"
LOCAL_HOST = r"^(?:localhost|127\.0\.0\.1|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+)$"
PASSING = r"^/(?:tmp|var|private/tmp|private/var|dev|proc)/"
UNREACHABLE = ("/share/", "/Volumes/")


def veto(probe: Column, expected: Column, evidence: Column) -> Column:
    """why a drafted probe may not be proposed, null if it may."""
    p = parse_probe(probe)
    kind, first, literal = p["predicate"], F.coalesce(F.get(p["args"], F.lit(0)), F.lit("")), F.coalesce(F.get(p["args"], F.lit(1)), F.lit(""))
    far = F.lit(False)
    for root in UNREACHABLE:
        far = far | first.startswith(root)
    exists = (kind == "grep_count") & expected.rlike(r"^\s*(?:>=\s*1|>\s*0)\s*$")
    return (
        F.when(F.contains(probe, F.lit("<repo>")), "unresolved-repo")
        .when((kind == "file_exists") & far, "unreachable-root")
        .when((kind == "http_status") & evidence.rlike(r"(?i)origin\s*:"), "header-value")
        .when(exists & literal.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), "bare-identifier")
    )


def propose(docs: DataFrame, repo: str | None = None, per_doc: int = 3, families: tuple[str, ...] = TAG_FAMILIES) -> DataFrame:
    """(doc_ord, line_no, predicate, level, probe, probe_expected, evidence, veto): drafts from the lines of each body.

    A line outside fences and quotes drafts, in this order: one ship tag beside one hash; local addresses; paths in
    backticks. Equal drafts count once; a document has at most ``per_doc`` without a veto, and the vetoed ones before the
    last of them are reported with their reason. Documents with a probe and sections draft nothing; without ``repo`` a
    tag's draft names no repository and is vetoed. A null or empty body drafts nothing.
    """
    from .structure import lines

    if "probe" in docs.columns:
        docs = docs.where("nullif(probe, '') is null")
    if "parent_name" in docs.columns:
        docs = docs.where("parent_name is null")
    all_of = lambda c, pattern, g: F.regexp_extract_all(c, F.lit(T.edged(pattern)), F.lit(g))
    line = F.col("line")
    draft = lambda kind, level, what, expected: F.struct(F.lit(kind).alias("predicate"), F.lit(level).alias("level"), F.concat(F.lit(kind + " "), what).alias("probe"), expected.alias("probe_expected"))
    rows = lines(docs).where(~F.col("in_fence") & ~line.rlike(r"^\s*(?:>|$)"))
    rows = rows.withColumn("tags", all_of(line, rf"(?:^|[\s\x60(\[{{|,])((?:{'|'.join(families)})-v\d+)\b", 1)).withColumn("shas", F.filter(all_of(line, SHA, 1), lambda s: ~s.rlike(r"^\d+$")))
    pair = F.when((F.size("tags") == 1) & (F.size("shas") == 1), F.array(draft("git_rev_parse", "cheap", F.concat(F.lit((repo or "<repo>") + " :: "), F.get("tags", F.lit(0)), F.lit("^{}")), F.concat(F.lit("~"), F.get("shas", F.lit(0))))))
    urls = F.transform(all_of(line, URL, 0), lambda u: F.regexp_replace(u, r"[.,;:)\]]+$", ""))
    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://([^:/]*)(?::\d{0,5})?(?:/|$)", 1))
    port = lambda u: F.coalesce(F.regexp_extract(u, r"^https?://[^:/]*:(\d{1,5})(?:/|$)", 1).try_cast("int"), F.lit(0))
    local = F.transform(F.filter(urls, lambda u: host(u).rlike(LOCAL_HOST) & (port(u) <= 65535)), lambda u: draft("http_status", "all", u, F.lit("200")))
    inner = F.transform(all_of(line, QUOTED, 1), lambda s: F.trim(s))
    paths = F.transform(F.filter(inner, lambda s: s.rlike(FILE_PATH) & ~s.rlike(PASSING) & ~s.rlike(r"[<>*?]")), lambda s: draft("file_exists", "cheap", s, F.lit("true")))
    empty = F.array().cast("array<struct<predicate:string,level:string,probe:string,probe_expected:string>>")
    found = rows.select("doc_ord", "line_no", F.substring(T.squeeze(line), 1, 180).alias("evidence"), F.posexplode(F.concat(F.coalesce(pair, empty), local, paths)).alias("pos", "d")).select("doc_ord", "line_no", "pos", "evidence", "d.*")
    again = F.row_number().over(Window.partitionBy("doc_ord", "probe", "probe_expected").orderBy("line_no", "pos"))
    found = found.withColumn("again", again).where("again = 1").withColumn("veto", veto(F.col("probe"), F.col("probe_expected"), F.col("evidence")))
    before = F.coalesce(F.sum(F.col("veto").isNull().cast("int")).over(Window.partitionBy("doc_ord").orderBy("line_no", "pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).where(F.col("before") < per_doc).select("doc_ord", F.col("line_no").cast("int").alias("line_no"), "predicate", "level", "probe", "probe_expected", "evidence", "veto")
