"""A postings index in files, kept up by deltas (K01, K02, K04, D7, D8, J14, ST11).

Every build adds a *segment*, and a one-row manifest says which segments count. A segment holds

* ``documents``: its documents as they came, with ``own_chunks``, token counts by field and a content hash,
  partitioned by a hash of the document;
* ``tokens``: the same documents' distinct terms with their counts by field, partitioned by a hash of the file, which
  tells an update what a replaced file had counted;
* ``postings``: (corpus, term, doc_ord, file) with term counts and lengths by field, partitioned by a hash of
  the term and sorted by term, ``lead`` on one document of each file that has the term;
* ``terms`` and ``stats``: signed changes of document frequencies and of a corpus's files, documents and token counts;
* ``gone``: files that it replaces or removes. Rows of earlier segments are dead where a later segment has their file here.

All counts are whole numbers, so the sum of the changes of any series of updates equals a count of the
documents that are left, and scores are those of an index built at once. A document is tokenised when it is
new or changed, never when it is searched, and its terms are counted where it is tokenised: postings are dealt out
once, by term. Search reads the partitions of the terms that are asked for,
and of these the row groups that hold them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomery.config import CONFIG, STOP_WORDS, EngineConfig
from loomery.functions import scoring as S, text as T
from loomery.sources import shared

from . import keyword, upkeep

FIELDS = ("name", "description", "headings", "facts", "body")
#: What makes indexes of different code incompatible: such an index is built anew.
FORMAT = 4
#: Most terms or ids that are written into a scan as literals, and most dead files that are broadcast.
LITERALS, BROADCAST_FILES = 256, 200_000
#: Bytes of bodies from which a first build writes documents where they are, each task into all partitions.
DIRECT_BYTES = 64_000_000


@dataclass(frozen=True)
class Layout:
    """How many partitions postings, documents and tokens have in each segment."""

    term_parts: int = 64
    doc_parts: int = 32
    file_parts: int = 32


def _part(n: int, *columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def contract(layout: Layout) -> str:
    return f"format {FORMAT}, {layout.term_parts}/{layout.doc_parts}/{layout.file_parts} parts, {len(STOP_WORDS)} stop words, chunks {CONFIG.chunk_words}/{CONFIG.chunk_overlap}/{CONFIG.chunk_cap}"


def _content(docs: DataFrame):
    """A hash of everything of a document that search can show or count."""
    columns = [F.col(f"`{c}`") for c in sorted(docs.columns)]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


class Index:
    """One version of an index: a reader of the segments that its manifest lists."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict, corpora: tuple[str, ...] | None = None):
        self.spark, self.path, self.manifest, self.corpora = spark, path.rstrip("/"), manifest, corpora
        self.segments: list[str] = list(manifest["segments"])
        self.layout = Layout(manifest["term_parts"], manifest["doc_parts"], manifest["file_parts"])

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index | None:
        """The newest version under path; None if nothing was built there."""
        found = shared.latest_version(spark, path)
        return Index(spark, path, found) if found else None

    def _read(self, table: str) -> DataFrame:
        """All segments' rows of a table, each with ``seq``, the place of its segment in the series."""
        parts = None
        for k, s in enumerate(self.segments):
            # each segment is a folder of its own: what others hold is not even listed
            one = self.spark.read.schema(self.manifest["schemas"][f"{s}/{table}"]).parquet(f"{self.path}/{table}/segment={s}").withColumn("seq", F.lit(k))
            parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
        return parts if self.corpora is None else parts.where(F.col("corpus").isin(*self.corpora))

    def scoped(self, corpora: list[str]) -> Index:
        """The same index, of these corpora alone. No statistic crosses corpora, so all others may be left out."""
        return Index(self.spark, self.path, self.manifest, tuple(corpora))

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Without the rows of files that a later segment replaces or removes."""
        if not self.manifest["dead_files"]:
            return rows.drop("seq")
        last = self._read("gone").groupBy("corpus", "file").agg(F.max("seq").alias("_gone"))
        if self.manifest["dead_files"] <= BROADCAST_FILES:
            last = F.broadcast(last)
        return rows.join(last, ["corpus", "file"], "left").where("_gone is null or _gone <= seq").drop("_gone", "seq")

    def documents(self) -> DataFrame:
        """The documents as they were given, with own_chunks."""
        return self._alive(self._read("documents")).drop("part", "content", *[f"n_{f}" for f in FIELDS])

    def of(self, wanted: DataFrame, columns: list[str]) -> DataFrame:
        """Columns of the documents that ``wanted`` (corpus, doc_ord) names, read from their partitions alone."""
        ids = wanted.select("corpus", "doc_ord").distinct()
        rows = self._read("documents")
        few = ids.limit(LITERALS + 1).collect()
        if len(few) <= LITERALS:
            parts = self.spark.createDataFrame(few, ids.schema).select(_part(self.layout.doc_parts, "corpus", "doc_ord").alias("p")).distinct().collect() if few else []
            rows = rows.where(F.col("part").isin([r["p"] for r in parts]) & F.col("doc_ord").isin([r["doc_ord"] for r in few]))
        rows = self._alive(rows.select("corpus", "doc_ord", "file", "seq", *[c for c in columns if c not in ("corpus", "doc_ord", "file")]))
        return rows.join(F.broadcast(ids) if len(few) <= LITERALS else ids, ["corpus", "doc_ord"], "left_semi").select("corpus", "doc_ord", *[c for c in columns if c not in ("corpus", "doc_ord")])

    def stats(self, cfg: EngineConfig = CONFIG) -> DataFrame:
        """One row a corpus: n_docs (distinct files) and average weighted lengths, an average of 0 counting as 1."""
        s = self._read("stats").groupBy("corpus").agg(*[F.sum(c).alias(c) for c in ("files", "docs", *[f"n_{f}" for f in FIELDS])]).where("docs > 0")
        group = lambda *fw: sum(F.col(f"n_{f}") * w for f, w in fw) / F.col("docs")
        avg = {"avg_title": group(("name", cfg.weight_name), ("description", cfg.weight_description)), "avg_head": group(("headings", cfg.weight_headings), ("facts", cfg.weight_key_facts)), "avg_body": group(("body", cfg.weight_body))}
        return s.select("corpus", F.col("files").alias("n_docs"), *[F.when(c == 0, 1.0).otherwise(c).alias(n) for n, c in avg.items()])

    def _of_terms(self, table: str, terms: DataFrame | None) -> DataFrame:
        rows = self._read(table)
        if terms is None:
            return rows.drop("part")
        own = terms.select("term").distinct()
        few = own.limit(LITERALS + 1).collect()
        if len(few) <= LITERALS:
            parts = self.spark.createDataFrame(few, own.schema).select(_part(self.layout.term_parts, "term").alias("p")).distinct().collect() if few else []
            return rows.where(F.col("part").isin([r["p"] for r in parts]) & F.col("term").isin([r["term"] for r in few])).drop("part")
        own = own.withColumn("part", _part(self.layout.term_parts, "term"))
        return rows.join(keyword._bounded(own), ["part", "term"], "left_semi").drop("part")

    def postings(self, terms: DataFrame | None = None, cfg: EngineConfig = CONFIG) -> DataFrame:
        """(corpus, term, doc_ord, file, tf_title, tf_head, tf_body, len_title, len_head, len_body), weighted; of ``terms`` only, if given."""
        rows = self._alive(self._of_terms("postings", terms))
        group = lambda p, *fw: sum(F.col(f"{p}_{f}") * w for f, w in fw)
        t, h, b = [("name", cfg.weight_name), ("description", cfg.weight_description)], [("headings", cfg.weight_headings), ("facts", cfg.weight_key_facts)], [("body", cfg.weight_body)]
        return rows.select("corpus", "term", "doc_ord", "file", *[group(p, *fw).alias(f"{o}_{g}") for p, o in (("tf", "tf"), ("n", "len")) for g, fw in (("title", t), ("head", h), ("body", b))])

    def document_frequency(self, terms: DataFrame | None = None) -> DataFrame:
        """(corpus, term, df): distinct files of each term."""
        return self._of_terms("terms", terms).groupBy("corpus", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def prepare(self, queries: DataFrame, cfg: EngineConfig = CONFIG) -> keyword.Prepared:
        """What keyword scoring needs, out of files: nothing is tokenised but the questions."""
        terms = keyword.query_terms(queries)
        stats = self.stats(cfg)
        df = self.document_frequency(terms).join(F.broadcast(stats.select("corpus", "n_docs")), "corpus").select("corpus", "term", "df", S.idf(F.col("n_docs"), F.col("df")).alias("idf"))
        return keyword.Prepared(terms, stats, self.postings(terms, cfg), df)

    def listing(self) -> DataFrame:
        """(corpus, file, digest) of what is indexed."""
        return _digests(self._alive(self._read("documents").select("corpus", "file", "doc_ord", "content", "seq")))


def _digests(docs: DataFrame) -> DataFrame:
    return docs.groupBy("corpus", "file").agg(F.sum(F.xxhash64("doc_ord", "content").cast("decimal(38,0)")).alias("digest"))


def _write(rows: DataFrame, path: str, table: str, segment: str, parts: int, order: list[str], ranged: bool = False) -> str:
    """A segment's rows of a table, partitioned by ``part`` and sorted in it; without ``order`` each task writes what it has.

    ``ranged``: tasks take ranges of (part, order), so a value with very many rows is cut; else hashes of the first of order spread a part. Gives the schema, which a
    table without rows would not tell a reader.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts and ranged:
        rows = rows.repartitionByRange(n, "part", *order).sortWithinPartitions("part", *order)
    elif parts and order:
        rows = rows.repartition(n, "part", _part(-(-n // parts), order[0])).sortWithinPartitions("part", *order)
    w = rows.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy("part") if parts else w).parquet(f"{path}/{table}/segment={segment}")
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _add(spark: SparkSession, path: str, fresh: DataFrame, gone: DataFrame | None, previous: Index | None, layout: Layout, segments: list[str], note: dict, size: int = 0) -> Index:
    """Writes one segment and the manifest that makes it count. fresh: whole documents, with ``size`` bytes of bodies (0: unknown); gone: (corpus, file)."""
    segment = uuid.uuid4().hex
    kept = {k: v for k, v in (previous.manifest["schemas"] if previous is not None else {}).items() if k.split("/")[0] in segments}

    def write(rows: DataFrame, table: str, parts: int, order: list[str], ranged: bool = False) -> DataFrame:
        kept[f"{segment}/{table}"] = _write(rows, path, table, segment, parts, order, ranged)
        return spark.read.schema(rows.schema).parquet(f"{path}/{table}/segment={segment}")

    # the input is read once; a file's documents come together to be tokenised, so a term's files are counted without another shuffle
    own = fresh.withColumn("content", _content(fresh)).withColumn("own_chunks", F.least(T.chunk_total(T.word_count(F.col("body"))), F.lit(CONFIG.chunk_cap)))
    own = own.withColumn("part", _part(layout.doc_parts, "corpus", "doc_ord"))
    direct = size >= DIRECT_BYTES
    own = write(own.sortWithinPartitions("part", "doc_ord") if direct else own, "documents", layout.doc_parts, [] if direct else ["doc_ord"])
    counted = [c for c in ("corpus", "doc_ord", "file", "name", "description", "headings", "key_facts", "body", "content") if c in own.columns]
    part, n = _part(layout.file_parts, "corpus", "file"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = own.select(*counted, part.alias("part")).repartition(n, "part", _part(-(-n // layout.file_parts), "file")).sortWithinPartitions("part", "corpus", "file", "doc_ord")
    sized = write(keyword.term_counts(near, ["content", "part"]), "tokens", layout.file_parts, [])
    lens = [f"n_{f}" for f in FIELDS]
    each = sized.select("corpus", "doc_ord", "file", *lens, F.explode("hits").alias("x")).select("corpus", "doc_ord", "file", *lens, "x.*")
    total = lambda d, sign: d.groupBy("corpus").agg((sign * F.countDistinct("file")).alias("files"), (sign * F.count(F.lit(1))).alias("docs"), *[(sign * F.sum(c)).alias(c) for c in lens])
    stats = total(sized, 1)
    ids, docs = sized.agg(F.countDistinct("corpus", "doc_ord", "file"), F.count(F.lit(1))).first()
    if ids < docs:  # a document that came twice is counted as one
        each = each.groupBy("corpus", "doc_ord", "file", *lens, "term").agg(*[F.sum(f"tf_{f}").cast("int").alias(f"tf_{f}") for f in FIELDS], F.max("lead").alias("lead"))
    posts = write(each.withColumn("part", _part(layout.term_parts, "term")), "postings", layout.term_parts, ["term", "doc_ord"], ranged=True)
    plus = posts.where("lead").groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))
    if gone is not None and previous is not None:
        # what replaced and removed files had counted, out of their own partitions
        parts = [r[0] for r in gone.select(_part(layout.file_parts, "corpus", "file")).distinct().collect()]
        old = previous._alive(previous._read("tokens").where(F.col("part").isin(parts)).drop("part")).join(gone, ["corpus", "file"], "left_semi")
        minus = old.select("corpus", "file", F.explode("hits.term").alias("term")).groupBy("corpus", "term").agg((-F.countDistinct("file")).alias("df"))
        plus, stats = plus.unionByName(minus), stats.unionByName(total(old, -1))
        stats = stats.groupBy("corpus").agg(*[F.sum(c).alias(c) for c in ("files", "docs", *lens)])
    change = plus.groupBy("corpus", "term").agg(F.sum("df").alias("df")).where("df <> 0")
    write(change.withColumn("part", _part(layout.term_parts, "term")), "terms", layout.term_parts, ["term"])
    write(stats, "stats", 0, [])
    write(gone if gone is not None else fresh.select("corpus", "file").limit(0), "gone", 0, [])
    dead = (previous.manifest["dead_files"] if previous is not None and len(segments) else 0) + (gone.count() if gone is not None else 0)
    row = note | {"segments": [*segments, segment], "contract": contract(layout), "term_parts": layout.term_parts, "doc_parts": layout.doc_parts, "file_parts": layout.file_parts, "dead_files": dead, "schemas": kept}
    schema = "segments array<string>, contract string, term_parts int, doc_parts int, file_parts int, dead_files long, schemas map<string,string>, docs long, failed long, vanished long, added long, changed long, removed long"
    version = previous.manifest["version"] + 1 if previous is not None else 0
    shared.commit_version(spark.createDataFrame([row], schema), path, version)
    return Index(spark, path, row | {"version": version})


def build(docs: DataFrame, path: str, layout: Layout | None = None, allow_shrink: bool = False) -> Index:
    """Builds or brings up to date the index under ``path``, so that it holds ``docs``, and returns it.

    docs: corpus, doc_ord, file, name, description, body, may have headings and key_facts, and whatever else search shows. Only
    documents of new and changed files are tokenised; an index of another contract is built anew. Documents without
    corpus, file or doc_ord fail: they are left out and counted, and beyond max(3, 1 %) of all they fail the build. A build with
    no documents is refused, and so is one that finds none where there were some, unless ``allow_shrink``. What was there before stays the newest
    version until the new one is written whole. Nothing to do gives the index as it is.
    """
    spark, path = docs.sparkSession, path.rstrip("/")
    previous = Index.open(spark, path)
    layout = layout or (previous.layout if previous is not None else Layout())
    whole = F.col("corpus").isNotNull() & F.col("file").isNotNull() & F.col("doc_ord").isNotNull()
    n, failed, size, files = docs.agg(F.count(F.when(whole, 1)), F.count(F.when(~whole, 1)), F.sum(F.octet_length("body")), F.countDistinct(F.when(whole, F.struct("corpus", "file")))).first()
    before = previous.manifest["docs"] if previous is not None else 0
    if not (n == 0 and before and allow_shrink):
        why = upkeep.refusal(n, before, failed)
        if why:
            raise ValueError(why)
    docs = docs.where(whole)
    note = {"docs": n, "failed": failed, "vanished": 0, "added": 0, "changed": 0, "removed": 0}
    if previous is None or previous.manifest["contract"] != contract(layout):
        return _add(spark, path, docs, None, previous, layout, [], note | {"added": files}, size or 0)
    now = _digests(docs.select("corpus", "file", "doc_ord", _content(docs).alias("content")))
    diff = now.withColumnRenamed("digest", "now").join(previous.listing().withColumnRenamed("digest", "then"), ["corpus", "file"], "full_outer")
    kind = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    diff = shared.written(diff.select("corpus", "file", kind.alias("kind")).where("kind is not null"), "diff")
    found = {r["kind"]: r["n"] for r in diff.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return previous
    fresh = docs.join(diff.where("kind <> 'removed'").select("corpus", "file"), ["corpus", "file"], "left_semi")
    gone = diff.where("kind <> 'added'").select("corpus", "file")
    return _add(spark, path, fresh, gone, previous, layout, previous.segments, note | found | {"vanished": found.get("removed", 0)})


def compact(index: Index) -> Index:
    """One segment in place of all; older ones stay for readers of older versions."""
    note = {k: index.manifest[k] for k in ("docs", "failed", "vanished", "added", "changed", "removed")}
    return _add(index.spark, index.path, index.documents().drop("own_chunks"), None, index, index.layout, [], note)
