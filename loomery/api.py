"""The engine's actions as functions, in two facades: a Reader cannot write (2.15, F02, F17, U01)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomery.config import CONFIG
from loomery.functions import text as T
from loomery.operators import commits, curate, ranking, state, structure, upkeep
from loomery.sources import readers, writers

QUERY_CAP = 8192


def expand_scopes(asked: str | list[str] | None, known: tuple[str, ...] = CONFIG.scopes, library: tuple[str, ...] = ()) -> list[str]:
    """Scopes without repeats in canonical order; all is every work corpus, everything the library too."""
    wanted = [asked] if isinstance(asked, str) else list(asked or [known[0]])
    every = [*known, *library]
    out: set[str] = set()
    for s in wanted:
        if s == "all":
            out |= set(known)
        elif s == "everything":
            out |= set(every)
        elif s in every:
            out.add(s)
        else:
            raise ValueError(unknown("scope", s, [*every, "all", "everything"]))
    return [s for s in every if s in out]


def distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def unknown(what: str, got: str, known: list[str]) -> str:
    """a refusal that names the nearest known value within three edits."""
    near = sorted((distance(got.lower(), k.lower()), k) for k in known)
    hint = f"; did you mean {near[0][1]}?" if near and near[0][0] <= 3 else ""
    return f"unknown {what} {got!r}{hint}"


def as_set(value: str | list[str] | None, mine: str | None = None) -> list[str] | None:
    """a filter value as a list; mine and this stand for the caller's own."""
    if value is None:
        return None
    return sorted({mine if v in ("mine", "this") and mine else v for v in ([value] if isinstance(value, str) else value)})


class Reader:
    """Read actions over documents (and, if given, links, commits and per-corpus floors)."""

    def __init__(self, docs: DataFrame, as_of: datetime, edges: DataFrame | None = None, repo_commits: DataFrame | None = None, floors: DataFrame | None = None):
        self.docs, self.as_of, self.edges, self.commits, self.floors = docs, as_of, edges, repo_commits, floors
        self.spark: SparkSession = docs.sparkSession

    def _scope(self, scope) -> DataFrame:
        known = tuple(r[0] for r in self.docs.select("corpus").distinct().collect())  # corpora, a handful
        return self.docs.where(F.col("corpus").isin(*expand_scopes(scope or "everything", CONFIG.scopes, tuple(k for k in known if k not in CONFIG.scopes))))

    def search(self, queries: list[str] | DataFrame, limit: int = CONFIG.limit, scope=None, account=None, project=None, session_id=None, after=None, before=None, include_archive: bool = True, semantic: DataFrame | None = None, brief: bool = False) -> tuple[DataFrame, DataFrame]:
        if not 1 <= limit <= 50:
            raise ValueError("limit must be 1 to 50")
        if isinstance(queries, list):
            if any(len(q) > QUERY_CAP for q in queries):
                raise ValueError(f"a query has at most {QUERY_CAP} characters")
            queries = self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
        lit = lambda t: None if t is None else F.lit(t)
        filters = ranking.passes(lit(after), lit(before), as_set(account), as_set(project), session_id, include_archive)
        rows, verdicts = ranking.search(queries, self._scope(scope), self.as_of, semantic, self.edges, self.floors, limit, filters)
        return (brief_rows(rows) if brief else rows), verdicts

    def latest(self, queries: list[str] | None = None, limit: int = 5, scope=None) -> tuple[DataFrame, DataFrame | None]:
        docs = self._scope(scope)
        if not queries:
            return state.browse(docs, limit), None
        return state.latest(self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"), docs, limit)

    def sessions(self, limit: int = 20, scope=None) -> DataFrame:
        return state.sessions(self._scope(scope), min(limit, 200))

    def thread(self, name: str, forward: int = 8, back: int = 0, scope=None) -> DataFrame:
        return state.thread(self.spark.createDataFrame([(name,)], "name string"), self._scope(scope), forward, back)

    def get(self, name: str, section: str | None = None, outline: bool = False, offset: int = 0, max_chars: int = 20_000) -> DataFrame:
        """A document, its outline, one section, or a slice."""
        if not 200 <= max_chars <= 200_000:
            raise ValueError("max_chars must be 200 to 200000")
        found = structure.resolve_names(self.spark.createDataFrame([(name,)], "asked string"), self.docs)
        doc = self.docs.join(F.broadcast(found.select("doc_ord")), "doc_ord", "left_semi")
        if outline:
            return structure.outline(doc)
        if section is not None:
            at = structure.find_section(structure.outline(doc), section)
            return doc.join(at.select("doc_ord", "heading", "start", "chars"), "doc_ord").select("doc_ord", "heading", F.expr("substring(body, start + 1, chars)").alias("body"))
        return doc.withColumn("total", F.length("body")).withColumn("body", F.substring("body", offset + 1, max_chars))

    def neighbors(self, name: str) -> DataFrame:
        """Linked documents and unresolved links of a document."""
        found = structure.resolve_names(self.spark.createDataFrame([(name,)], "asked string"), self.docs).select(F.col("doc_ord").alias("me"))
        edges, lost = structure.link_edges(self.docs)
        out = edges.join(F.broadcast(found), F.col("src") == F.col("me")).select(F.lit("outbound").alias("kind"), F.col("dst").cast("string").alias("target"))
        back = edges.join(F.broadcast(found), F.col("dst") == F.col("me")).select(F.lit("inbound").alias("kind"), F.col("src").cast("string").alias("target"))
        return out.unionByName(back).unionByName(lost.join(F.broadcast(found), F.col("src") == F.col("me")).select(F.lit("unresolved").alias("kind"), "target"))

    def verify(self, text: str) -> DataFrame:
        if self.commits is None:
            raise ValueError("no repositories are configured")
        return commits.cited(self.spark.createDataFrame([(0, text)], "doc_ord long, body string"), self.commits)

    def route(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("scope", curate.route_scope(F.col("query")))


class Writer(Reader):
    """Write actions; a Reader has none of them."""

    def index(self, path: str, contract: dict, previous: DataFrame | None = None) -> str:
        return writers.publish(self.docs, path, contract, previous)

    def set_tier(self, names: list[str], tier: str) -> DataFrame:
        """demote, promote: an overlay; read-only and listed documents are refused."""
        if tier not in ("hot", "archive"):
            raise ValueError(unknown("tier", tier, ["hot", "archive"]))
        hit = self.docs.where(F.col("name").isin(*names))
        held = [c for c in ("read_only", "in_memory_index") if c in self.docs.columns]
        for c in held:
            if tier == "archive" and not hit.where(F.coalesce(F.col(c), F.lit(False))).isEmpty():
                raise ValueError(f"a document is {c.replace('_', ' ')}")
        return writers.overlay(self.docs, self.spark.createDataFrame([(n, tier) for n in names], "name string, tier string"))

    def import_path(self, path: str) -> tuple[DataFrame, DataFrame]:
        items, skipped = readers.read_imports(self.spark, path)
        admitted, refused = readers.admit_imports(items, self.docs)
        return admitted, refused.select("path", "reason").unionByName(skipped)

    def uncaptured(self, transcripts: DataFrame, stamps: DataFrame) -> DataFrame:
        return upkeep.uncaptured(transcripts, stamps)


def brief_rows(rows: DataFrame) -> DataFrame:
    """F16: the columns of a brief answer, snippets cut to 160 characters."""
    return rows.select("query_id", "corpus", "rank", "name", "score", T.trim_snippet(F.col("snippet"), 160).alias("snippet"), "weak")
