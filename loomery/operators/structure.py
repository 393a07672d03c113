"""Document-shaping operators: descriptions, sections, outlines, links, PDF pages, chapters."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from loomery.config import CONFIG, EngineConfig
from loomery.functions import text as T


def lines(docs: DataFrame, key: str = "doc_ord", body: str = "body") -> DataFrame:
    """(key, line_no, line, start, in_fence): lines with their offsets; a fence line counts as inside."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("line").rlike(r"^[ \t]*(```|~~~)").cast("int")
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))
    odd = F.coalesce(F.sum(fence).over(before), F.lit(0)) % 2 == 1
    return rows.withColumn("in_fence", odd | (fence == 1))


def synth_description(body: Column, limit: int = 400) -> Column:
    """First heading and first paragraph (at most six lines), or what there is of the two."""
    heads = T.headings(body)
    plain = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(body, F.lit("")), "(?m)^#{1,6}[ \t].*$", ""), r"\n[ \t]*\n"), lambda s: F.trim(s)), lambda p: F.regexp_replace(p, BLANKS, "") != "")
    para = F.when(F.size(plain) > 0, T.squeeze(F.array_join(F.slice(F.split(F.get(plain, F.lit(0)), "\n"), 1, 6), " ")))
    return F.substring(F.concat_ws(" — ", F.get(heads, F.lit(0)), para), 1, limit)


BLANKS = r"[\x20\x09-\x0D]+"


#: A fence line, or a line that could head a section. Fixed value.
FENCE_OR_HEAD = re.compile(r"^(?:[ \t]*(?:```|~~~)|##[ \t]+\S)", re.MULTILINE | re.ASCII)


CUT = ArrayType(StructType().add("ix", IntegerType()).add("line", StringType()).add("first", IntegerType()).add("stop", IntegerType()).add("text", StringType()))
NUMBERS = ArrayType(StructType().add("again", IntegerType()).add("newest", IntegerType()))


@F.arrow_udf(CUT)
def _cut(body: pa.Array, least: pa.Array) -> pa.Array:
    """The ## sections of each text that have at least so many characters."""
    out = []
    for text, n in zip(body.to_pylist(), least.to_pylist()):
        heads, inside = [], False
        for m in FENCE_OR_HEAD.finditer(text or ""):
            if m.group().startswith("##"):
                heads += [] if inside else [m.start()]
            else:
                inside = not inside
        ends = [h - 1 for h in heads[1:]] + [len(text or "")]
        out.append([{"ix": k, "line": text[i:j].split("\n", 1)[0], "first": i, "stop": j, "text": text[i:j]} for k, (i, j) in enumerate(zip(heads, ends)) if j - i >= n])
    return pa.array(out, pa.list_(pa.struct([("ix", pa.int32()), ("line", pa.string()), ("first", pa.int32()), ("stop", pa.int32()), ("text", pa.string())])))


@F.arrow_udf(NUMBERS)
def _numbered(slugs: pa.Array, versions: pa.Array) -> pa.Array:
    """For each section of a document how often its slug came up to it, and the place of its version from the newest, the first of equals before."""
    out = []
    for names, numbers in zip(slugs.to_pylist(), versions.to_pylist()):
        seen: Counter = Counter()
        order = sorted((k for k, v in enumerate(numbers or []) if v is not None), key=lambda k: -numbers[k])
        place = {k: n for n, k in enumerate(order, 1)}
        rows = []
        for k, name in enumerate(names or []):
            seen[name] += 1
            rows.append({"again": seen[name], "newest": place.get(k)})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("again", pa.int32()), ("newest", pa.int32())])))


def _heading(line: Column) -> Column:
    return T.squeeze(F.regexp_replace(line, r"^##[ \t]+", ""))


def split_sections(docs: DataFrame, min_chars: int = CONFIG.section_min_chars, key: str = "doc_ord", body: str = "body") -> DataFrame:
    """(key, ix, heading, first, stop, text) of each ## section of min_chars or more, fences respected. A text is cut where its row is."""
    rows = docs.select(key, F.explode(_cut(F.col(body), F.lit(min_chars))).alias("x"))
    return rows.select(key, "x.ix", _heading(F.col("x.line")).alias("heading"), "x.first", "x.stop", "x.text")


#: How an author marks a section as stale. Fixed value.
STALE_MARK = "(?i)\u26a0\ufe0f[\\x20\\x09-\\x0D]*STALE|STALE,[\\x20\\x09-\\x0D]*do not trust"
#: Sections of a document that keep their numbers apart from the next document's.
SECTION_ROOM = 1 << 20


def section_docs(docs: DataFrame, cfg: EngineConfig = CONFIG) -> DataFrame:
    """Long documents with enough sections become a stub and a document a section.

    A section keeps its parent's columns but for those that say what it is: name parent#slug (repeated slugs numbered from 2), description,
    headings (its own), hash (of name, heading and text), size, links and backlinks (none), body. Of sections that carry a version
    number the newest keep their tier; older ones and those that their author marked stale go to the archive. The stub has the parent's description (or
    name) and the number of sections for a body, and of its headings those that no section has, four at most. So that every row has a number of
    its own, doc_ord becomes doc_ord * SECTION_ROOM, and a section's follows its parent's; a document has fewer sections than that.
    A document is cut where its row is: nothing is shuffled.
    """
    own = ["doc_ord", "name", "description", "tier", "headings", "hash", "size", "links", "backlinks", "body", "parent_name", "heading", "char_range", "is_section", "is_section_parent", "section_count"]
    kind = F.coalesce(F.col("type"), F.lit("")) if "type" in docs.columns else F.lit("")
    heads = F.col("headings") if "headings" in docs.columns else T.headings(F.col("body"))
    docs = docs.withColumn("headings", heads)
    able = (F.length("body") >= cfg.section_min_doc) & (kind != "exchange") & (F.col("name") != "MEMORY")
    docs = docs.withColumn("_cut", _cut(F.when(able, F.col("body")), F.lit(cfg.section_min_chars)))
    docs = docs.withColumn("_cut", F.when(F.size("_cut") >= cfg.section_min_count, F.col("_cut"))).withColumn("_heads", F.transform("_cut", lambda x: _heading(x["line"])))
    docs = docs.withColumn("section_count", F.when(F.col("_cut").isNotNull(), F.size("_cut")))
    docs = docs.withColumn("_no", _numbered(F.transform("_heads", lambda h: T.slug(h)), F.transform("_heads", lambda h: T.version_token(h))))
    rest = [c for c in docs.columns if c not in own and c not in ("_cut", "_heads", "_no")]
    none, text = F.array().cast("array<string>"), lambda v, t: F.lit(v).cast(t)
    also = [c for c in ("links", "backlinks") if c in docs.columns]
    kinds = {c: docs.schema[c].dataType for c in also}

    def child(x: Column) -> Column:
        heading, body, again, newest = x["_heads"], x["_cut"]["text"], x["_no"]["again"], x["_no"]["newest"]
        slug = T.slug(heading)
        stale = heading.rlike(STALE_MARK) | F.coalesce(newest > cfg.section_keep, F.lit(False))
        return F.struct(
            (F.col("doc_ord") * SECTION_ROOM + x["_cut"]["ix"] + 1).alias("doc_ord"),
            F.concat("name", F.lit("#"), slug, F.when(again > 1, F.concat(F.lit("-"), again)).otherwise("")).alias("name"),
            F.concat("name", F.lit(" — "), heading).alias("description"), F.when(stale, "archive").otherwise(F.col("tier")).alias("tier"), F.array(heading).alias("headings"),
            F.sha2(F.concat("name", F.lit("#"), heading, F.lit("\n"), body), 256).alias("hash"), F.length(body).cast("long").alias("size"), *[none.cast(kinds[c]).alias(c) for c in also],
            F.col("name").alias("parent_name"), heading.alias("heading"), F.array(x["_cut"]["first"], x["_cut"]["stop"]).alias("char_range"), F.lit(True).alias("is_section"), F.lit(False).alias("is_section_parent"), text(None, "int").alias("section_count"), body.alias("body"),
        )

    said = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("name"))
    stub = F.concat(said, F.lit("\n\n("), F.col("section_count").cast("string"), F.lit(" sections, indexed individually.)"))
    split = F.col("section_count").isNotNull()
    kept = F.slice(F.filter("headings", lambda h: ~F.exists("_heads", lambda x: F.contains(h, x))), 1, 4)
    old = lambda c, t: (F.col(c) if c in docs.columns else text(None, t)).alias(c)
    parent = F.struct(
        (F.col("doc_ord") * SECTION_ROOM).alias("doc_ord"), "name", "description", "tier", F.when(split, kept).otherwise(F.col("headings")).alias("headings"), old("hash", "string"), old("size", "long"), *also,
        text(None, "string").alias("parent_name"), text(None, "string").alias("heading"), text(None, "array<int>").alias("char_range"),
        F.lit(False).alias("is_section"), split.alias("is_section_parent"), F.col("section_count").cast("int").alias("section_count"), F.when(split, stub).otherwise(F.col("body")).alias("body"),
    )
    rows = F.when(split, F.concat(F.array(parent), F.transform(F.arrays_zip("_cut", "_heads", "_no"), child))).otherwise(F.array(parent))
    return docs.select(*rest, F.explode(rows).alias("_x")).select("_x.doc_ord", *rest, *[f"_x.{c}" for c in ("name", "description", "tier", "headings", "hash", "size", *also, "parent_name", "heading", "char_range", "is_section", "is_section_parent", "section_count", "body")])


def outline(docs: DataFrame, key: str = "doc_ord", body: str = "body") -> DataFrame:
    """(key, ix, level, heading, start, chars): chars reach to the next heading of the same or a higher level.

    The end of a heading is the least start among later headings of each level up to its own: one running
    minimum a level, no pair of headings.
    """
    rows = lines(docs, key, body)
    heads = rows.where(~F.col("in_fence") & F.col("line").rlike(r"^#{1,6}[ \t]+\S")).withColumn("level", F.length(F.regexp_extract("line", "^(#{1,6})", 1)))
    after = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    for n in range(1, 7):
        heads = heads.withColumn(f"n{n}", F.min(F.when(F.col("level") <= n, F.col("start"))).over(after))
    end = F.lit(None).cast("int")
    for n in range(1, 7):
        end = F.when(F.col("level") == n, F.col(f"n{n}")).otherwise(end)
    size = docs.select(key, F.length(F.coalesce(F.col(body), F.lit(""))).alias("size"))
    text = F.regexp_replace(F.regexp_replace("line", r"^#{1,6}[ \t]+", ""), r"[ \t\r]+$", "")
    ix = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1
    return heads.join(size, key).select(key, ix.alias("ix"), "level", text.alias("heading"), "start", (F.coalesce(end, F.col("size")) - F.col("start")).alias("chars"))


def find_section(outlines: DataFrame, wanted: str, key: str = "doc_ord") -> DataFrame:
    """The outline row whose heading equals, else begins with, else holds ``wanted``; the first of equals."""
    norm = T.squeeze(F.lower(F.col("heading")))
    ask = " ".join(wanted.lower().split())
    level = F.when(norm == ask, 0).when(norm.startswith(ask), 1).when(F.contains(norm, F.lit(ask)), 2)
    w = Window.partitionBy(key).orderBy("_p", "ix")
    return outlines.withColumn("_p", level).where("_p is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def pdf_pages(docs: DataFrame, key: str = "doc_ord", body: str = "body") -> DataFrame:
    """(key, text): page breaks become ## p.N headings; running headers and footers go.

    A running line is one of the two first or last lines of a page that have text, at most 80 characters, on more than half of the
    pages that have text, where there are at least four of those; it goes wherever it stands. Blank pages have no
    heading but keep their number. A text without page breaks stays as it is, null becomes empty, and every row
    stays. A row is worked on by itself: no shuffle. A line is on over half of n pages if in the sorted edges it
    equals the one n div 2 places on.
    """
    whole = F.coalesce(F.col(body), F.lit(""))

    def edges(page: Column) -> Column:
        full = F.filter(F.transform(F.split(page, "\n"), strip), lambda s: s != "")
        return let(full, lambda f: F.array_union(F.slice(f, 1, 2), F.slice(f, F.greatest(F.size(f) - 1, F.lit(1)), 2)))

    def running(pages: Column) -> Column:
        every = F.filter(F.transform(pages, edges), lambda e: F.size(e) > 0)
        able = lambda e: F.array_sort(F.filter(F.flatten(e), lambda s: F.length(s) <= 80))
        often = lambda s, half: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + half) == x))
        return let(every, lambda e: F.when(F.size(e) >= 4, let(able(e), lambda s: often(s, (F.size(e) / 2).cast("int")))).otherwise(F.array().cast("array<string>")))

    def headed(pages: Column) -> Column:
        bare = lambda r: F.transform(pages, lambda p: strip(F.array_join(F.filter(F.split(p, "\n"), lambda s: ~F.array_contains(r, strip(s))), "\n")))
        texts = let(running(pages), bare)
        return F.array_join(F.filter(F.transform(texts, lambda t, i: F.when(t != "", F.concat(F.lit("## p."), (i + 1).cast("string"), F.lit("\n\n"), t))), lambda t: t.isNotNull()), "\n\n")

    return docs.select(key, F.when(F.contains(whole, F.lit("\f")), let(F.split(whole, "\f"), headed)).otherwise(whole).alias("text"))


#: A line that begins a chapter: designator, number or word, and a short title. Fixed value.
CHAPTER_LINE = r"^\s{0,3}((?:CHAPTER|Chapter|BOOK|Book|PART|Part|VOLUME|Volume|ACT|Canto)\s+(?:[0-9]+|[IVXLCDM]+|[A-Z][a-z]+)(?![A-Za-z0-9_])\.?[^\n]{0,60})\s*$"


def promote_chapters(docs: DataFrame, key: str = "doc_ord", body: str = "body", least: int = 3) -> DataFrame:
    """(key, text): chapter lines become ## headings, the last of each designator (its two first words, in any
    case), where a text without headings of the levels 1 to 3 has at least ``least`` of them; other texts stay as they
    are and are not taken apart. Null becomes empty. ``key`` tells the rows apart."""
    whole = F.coalesce(F.col(body), F.lit(""))
    docs = docs.select(key, whole.alias("text")).withColumn("able", ~F.col("text").rlike(r"(?m)^##?#?\s+\S") & F.col("text").rlike("(?m)" + CHAPTER_LINE))
    rows = lines(docs.where("able"), key, "text")
    title = F.regexp_extract("line", CHAPTER_LINE, 1)
    mark = F.upper(F.regexp_replace(F.regexp_extract("title", r"^\S+\s+\S+", 0), r"\.$", ""))
    rows = rows.withColumn("title", title).withColumn("mark", mark)
    last = F.max("line_no").over(Window.partitionBy(key, "mark"))
    rows = rows.withColumn("hit", (F.col("mark") != "") & (F.col("line_no") == last))
    line = F.when(F.col("hit"), F.concat(F.lit("## "), strip(F.col("title")))).otherwise(F.col("line"))
    said = F.array_sort(F.collect_list(F.struct("line_no", "line", line.alias("new"))))
    text = rows.groupBy(key).agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), said.alias("said"))
    joined = lambda c: F.array_join(F.transform("said", lambda x: x[c]), "\n")
    return docs.where("not able").select(key, "text").unionByName(text.select(key, F.when(F.col("hits") >= least, joined("new")).otherwise(joined("line")).alias("text")))


def link_edges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): links by name, else by file; none to itself; (corpus, src, dst) over doc_ord."""
    links = docs.select("corpus", F.col("doc_ord").alias("src"), F.explode(T.wiki_links(F.col("body"))).alias("target"))
    by_name = docs.groupBy("corpus", F.col("name").alias("target")).agg(F.min("doc_ord").alias("by_name"))
    by_file = docs.groupBy("corpus", F.regexp_replace("file", r"\.md$", "").alias("target")).agg(F.min("doc_ord").alias("by_file"))
    found = links.join(by_name, ["corpus", "target"], "left").join(by_file, ["corpus", "target"], "left").withColumn("dst", F.coalesce("by_name", "by_file"))
    return found.where("dst is not null and dst <> src").select("corpus", "src", "dst").distinct(), found.where("dst is null").select("corpus", "src", "target").distinct()


def backlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy("corpus", F.col("dst").alias("doc_ord")).agg(F.array_sort(F.collect_set("src")).alias("backlinks"))


def index_membership(docs: DataFrame) -> DataFrame:
    """in_memory_index and tier of documents that their root's MEMORY document lists; listed ones are hot."""
    index = docs.where("name = 'MEMORY'")
    md = F.regexp_extract_all("body", F.lit(r"\]\(([^)]+)\.md\)"), F.lit(1))
    listed = index.select("root", F.explode(F.array_union(T.wiki_links(F.col("body")), md)).alias("name")).distinct().withColumn("_in", F.lit(True))
    out = docs.join(listed, ["root", "name"], "left").withColumn("in_memory_index", F.coalesce("_in", F.lit(False))).drop("_in")
    return out.withColumn("tier", F.when(F.col("in_memory_index"), "hot").otherwise(F.col("tier")))


def attach_key_facts(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Key facts by name."""
    return docs.drop("key_facts").join(facts.select("corpus", "name", F.col("facts").alias("key_facts")), ["corpus", "name"], "left")


def resolve_names(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(asked, doc_ord) by name in any case, then file, then its last part, then letters and digits alone."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    base = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.md$", "")
    keys = docs.select("doc_ord", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.lower("name").alias("k")), F.struct(F.lit(2).alias("p"), F.lower("file").alias("k")), F.struct(F.lit(3).alias("p"), F.lower(base).alias("k")), F.struct(F.lit(4).alias("p"), squeeze(F.col("name")).alias("k")))).alias("x")).select("doc_ord", "x.p", "x.k")
    wants = asked.select("asked", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), (squeeze(F.col("asked")) if p == 4 else F.lower("asked")).alias("k")) for p in (1, 2, 3, 4)])).alias("x")).select("asked", "x.p", "x.k")
    return wants.join(keys, ["p", "k"]).groupBy("asked").agg(F.min_by("doc_ord", F.struct("p", "doc_ord")).alias("doc_ord"))


def duplicate_names(docs: DataFrame) -> DataFrame:
    """All but the first document of each name."""
    w = Window.partitionBy("corpus", "name").orderBy("doc_ord")
    return docs.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def demote_versions(docs: DataFrame, least: int = 3, keep: int = CONFIG.section_keep) -> DataFrame:
    """Of files whose names differ only in their one version number, in groups of at least three, all but the newest go to the archive.

    Rows that are not the corpus' own stay as they are: read-only ones, sections (parent_name), those with a root, and
    those whose author set the tier (tier_explicit), as far as docs has these columns. Names with no version or with
    several belong to no group.
    """
    token = r"(?<![A-Za-z0-9_])([vV]\d{1,4})(?![A-Za-z0-9_])"
    own = F.size(F.regexp_extract_all("name", F.lit(token), F.lit(1))) == 1
    for c in ("root", "parent_name"):
        own = own & F.col(c).isNull() if c in docs.columns else own
    for c in ("read_only", "tier_explicit"):
        own = own & ~F.coalesce(F.col(c), F.lit(False)) if c in docs.columns else own
    rows = docs.withColumn("_stem", F.when(own, F.regexp_replace("name", token, "v*"))).withColumn("_v", T.version_token(F.col("name")))
    able = rows.where("_stem is not null")
    w = Window.partitionBy("corpus", "_stem")
    able = able.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_v"), "doc_ord")))
    old = (F.col("_n") >= least) & (F.col("_r") > keep)
    able = able.withColumn("tier", F.when(old, "archive").otherwise(F.col("tier"))).drop("_n", "_r")
    return able.unionByName(rows.where("_stem is null")).drop("_stem", "_v")
