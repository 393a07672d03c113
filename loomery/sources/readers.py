"""Sources: Markdown folders, imports, chat exports, transcripts, zips, the index manifest, logs."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as ST

from loomery.functions import redact as R, text as T
from loomery.operators import structure

TEXT_KINDS = ("md", "markdown", "txt", "text", "log", "csv", "tsv")
TEXT_CAP, BINARY_CAP = 5_000_000, 64_000_000
FRONT = r"\A---\n([\s\S]*?)\n---[ \t]*(?:\n|\z)"


def within(root: str, path: str) -> bool:
    """Whether path, links resolved, lies in root; what cannot be resolved does not."""
    try:
        return Path(path).resolve(strict=True).is_relative_to(Path(root).resolve(strict=True))
    except OSError:
        return False


def scan(spark: SparkSession, root: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """(path, file, mtime_ms, size, content) of files; a missing root is empty, not an error."""
    schema = "path string, file string, mtime_ms long, size long, content binary"
    local = root.removeprefix("file://")
    if "://" not in root and not Path(local).exists():
        return spark.createDataFrame([], schema)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    rows = reader.load(root)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), "content")


def front_matter(body: Column) -> Column:
    """struct(meta, rest, unterminated): a two-level map of scalars; nested keys as outer.inner, quotes off.

    A byte-order mark goes and CRLF becomes LF first; a block that only CR ends is none.
    """
    t = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), "^﻿", ""), "\r\n", "\n")
    block = F.regexp_extract(t, FRONT, 1)
    start = F.struct(F.lit("").alias("outer"), F.array().cast("array<struct<k:string,v:string>>").alias("kv"))

    def fold(acc: Column, line: Column) -> Column:
        key = F.trim(F.regexp_extract(line, r"^[ \t]*([A-Za-z0-9_\-]+):", 1))
        value = F.regexp_replace(F.trim(F.regexp_extract(line, r"^[ \t]*[A-Za-z0-9_\-]+:(.*)$", 1)), "^([\"'])(.*)\\1$", "$2")
        inner = line.rlike(r"^[ \t]+\S")
        name = F.when(inner & (acc["outer"] != ""), F.concat(acc["outer"], F.lit("."), key)).otherwise(key)
        outer = F.when(inner, acc["outer"]).when(value == "", key).otherwise(F.lit(""))
        kv = F.when((key != "") & (value != ""), F.array_append(acc["kv"], F.struct(name.alias("k"), value.alias("v")))).otherwise(acc["kv"])
        return F.struct(F.when(key == "", acc["outer"]).otherwise(outer).alias("outer"), kv.alias("kv"))

    pairs = F.aggregate(F.split(block, "\n"), start, fold)["kv"]
    meta = F.map_from_entries(F.filter(pairs, lambda p: F.element_at(F.filter(pairs, lambda o: o["k"] == p["k"]), 1) == p))
    opened, closed = t.rlike(r"\A---\n"), t.rlike(FRONT)
    return F.struct(meta.alias("meta"), F.regexp_replace(t, FRONT, "").alias("rest"), (opened & ~closed).alias("unterminated"), closed.alias("has"))


def read_markdown(files: DataFrame, corpus: str, default_tier: str = "hot", doc_type: str = "memory") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, excluded, skipped) of scanned files."""
    rows = files.withColumn("text", F.decode("content", "UTF-8")).withColumn("fm", front_matter(F.col("text")))
    m = lambda *keys: F.coalesce(*[F.try_element_at("fm.meta", F.lit(k)) for k in keys])
    base = F.regexp_replace("file", r"\.[^.]*$", "")
    name = F.coalesce(m("name"), base)
    tier = F.when(m("metadata.tier", "tier").isin("hot", "archive"), m("metadata.tier", "tier")).otherwise(default_tier)
    body = F.col("fm.rest")
    given = F.nullif(F.trim(m("description")), F.lit(""))
    docs = rows.select(
        F.lit(corpus).alias("corpus"), F.xxhash64("path").alias("doc_ord"), name.alias("name"), "file", F.col("path").alias("source_path"), F.col("fm.has").alias("has_frontmatter"),
        F.coalesce(given, structure.synth_description(body)).alias("description"), given.isNull().alias("description_synthesised"), F.coalesce(m("metadata.type", "type", "metadata.node_type"), F.lit(doc_type)).alias("type"),
        m("metadata.sessionId", "metadata.originSessionId").alias("session_id"), m("metadata.originTask").alias("origin_task"), m("metadata.account").alias("account"), m("metadata.project").alias("project"), m("metadata.sessionTitle").alias("session_title"),
        (F.lower(m("metadata.inFlight")) == "true").alias("in_flight"), (F.lower(m("metadata.secret")) == "true").alias("secret"), m("metadata.ts").try_cast("timestamp").alias("ts"), tier.alias("tier"), m("metadata.tier", "tier").isin("hot", "archive").alias("tier_explicit"),
        m("metadata.probe").alias("probe"), m("metadata.probe_expected").alias("probe_expected"), m("metadata.asOf").try_cast("timestamp").alias("as_of"), m("metadata.validUntil").try_cast("timestamp").alias("valid_until"),
        F.coalesce(m("metadata.modified").try_cast("timestamp"), F.timestamp_millis("mtime_ms")).alias("modified"), m("metadata.modifiedSource").alias("modified_source"), "mtime_ms", "size", F.sha2("content", 256).alias("hash"),
        T.headings(body).alias("headings"), T.wiki_links(body).alias("links"), body.alias("body"), F.col("fm.unterminated").alias("open_frontmatter"), (F.trim(F.regexp_replace(F.col("text"), r"[\x09-\x0D]", " ")) == "").alias("blank"),
    )
    reason = F.when(F.col("body").isNull(), "unreadable").when(F.col("open_frontmatter"), "unterminated-front-matter").when(F.col("secret"), "secret")
    marked = docs.withColumn("reason", reason)
    return marked.where("reason is null and not blank").drop("reason", "blank"), marked.where("reason is not null").select("corpus", "file", "reason"), marked.where("reason is null and blank").select("corpus", "file")


def read_imports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, skipped) of a file or folder; sizes capped, office formats named as refused, HTML and CSV as text."""
    files = scan(spark, path, "*", recursive=True)
    kind = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    rows = files.withColumn("kind", kind)
    reason = F.when(F.col("file").startswith("."), "dotfile").when(F.col("kind").isin("docx", "rtf", "odt"), "needs a converter").when(~F.col("kind").isin(*TEXT_KINDS, "html", "htm", "pdftext"), "unknown kind").when(F.col("size") > TEXT_CAP, "too large")
    rows = rows.withColumn("reason", reason)
    text = F.decode("content", "UTF-8")
    body = F.when(F.col("kind").isin("html", "htm"), T.html_to_text(text)).otherwise(text)
    items = rows.where("reason is null").select("path", "file", body.alias("body"))
    title = F.coalesce(F.get(T.headings(F.col("body")), F.lit(0)), F.regexp_replace("file", r"\.[^.]*$", ""))
    return items.withColumn("title", title).withColumn("slug", T.slug(title, 48)), rows.where("reason is not null").select("path", "reason")


def admit_imports(items: DataFrame, store: DataFrame, least: int = 40, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(rows to append, refusals): too short, too large, with a secret, or of a name that is taken."""
    taken = store.select(F.col("name").alias("slug")).distinct().withColumn("_taken", F.lit(True))
    rows = items.join(taken, "slug", "left")
    why = F.when(F.length("body") < least, "too short").when(F.length("body") > most, "too large").when(R.has_secret(F.col("body")), "credential").when(F.col("_taken"), "name taken")
    marked = rows.withColumn("reason", why).drop("_taken")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("path", "slug", "reason")


EXPORT = "array<struct<title:string,create_time:double,mapping:map<string,struct<message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>>>>>>"


def read_chat_export(texts: DataFrame, column: str = "text") -> DataFrame:
    """(title, at, body) of each conversation of a chat export: turns by time, without system and empty ones."""
    c = texts.select(F.explode(F.from_json(column, EXPORT)).alias("c")).select("c.title", "c.create_time", F.transform(F.map_values("c.mapping"), lambda x: x["message"]).alias("m"))
    said = F.filter("m", lambda x: x.isNotNull() & (x["author"]["role"] != "system") & (F.trim(F.array_join(x["content"]["parts"], "")) != ""))
    order = F.array_sort(F.transform(said, lambda x: F.struct(F.coalesce(x["create_time"], F.lit(0.0)).alias("t"), x["author"]["role"].alias("r"), F.array_join(x["content"]["parts"], "\n").alias("s"))))
    return c.select("title", F.timestamp_seconds(F.col("create_time")).alias("at"), F.array_join(F.transform(order, lambda x: F.concat(F.lit("**"), x["r"], F.lit(":** "), x["s"])), "\n\n").alias("body"))


#: One line of a transcript.
LINE = ST.StructType([ST.StructField("type", ST.StringType()), ST.StructField("timestamp", ST.TimestampType()), ST.StructField("isSidechain", ST.BooleanType()), ST.StructField("operation", ST.StringType()), ST.StructField("reason", ST.StringType()), ST.StructField("content", ST.StringType()), ST.StructField("message", ST.StructType([ST.StructField("role", ST.StringType()), ST.StructField("stop_reason", ST.StringType()), ST.StructField("content", ST.StringType())]))])


def transcript_turns(lines: DataFrame, session: Column, ix: Column) -> DataFrame:
    """Turns of JSON lines; bad lines and side chains go, only text blocks stay."""
    j = lines.select(session.alias("session_id"), ix.alias("ix"), F.from_json("value", LINE).alias("j")).where("j is not null and j.type is not null and not coalesce(j.isSidechain, false)")
    blocks = F.from_json("j.message.content", "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.when(F.col("j.message.content").startswith("["), F.coalesce(listed, F.col("j.message.content"))).otherwise(F.coalesce("j.message.content", "j.content"))
    rows = j.select("session_id", "ix", F.coalesce("j.message.role", "j.type").alias("role"), text.alias("text"), F.col("j.timestamp").alias("ts"), (F.coalesce("j.operation", F.lit("")) == "remove").alias("interjection"), F.col("j.message.stop_reason").alias("stop_reason"))
    return rows.where("role in ('user', 'assistant', 'system', 'queue-operation')")


def read_zip(files: DataFrame) -> DataFrame:
    """(path, member, content, error) of the members of zip files: checked by CRC, none outside, none too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[tuple] = []
                try:
                    with zipfile.ZipFile(BytesIO(content)) as z:
                        for info in z.infolist():
                            parts = PurePosixPath(info.filename.replace("\\", "/"))
                            if info.is_dir():
                                continue
                            if parts.is_absolute() or ".." in parts.parts:
                                out.append((path, info.filename, None, "outside the archive"))
                            elif info.file_size > BINARY_CAP:
                                out.append((path, info.filename, None, "too large"))
                            else:
                                try:
                                    out.append((path, info.filename, z.read(info), None))
                                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as x:
                                    out.append((path, info.filename, None, str(x)))
                except zipfile.BadZipFile as x:
                    out.append((path, None, None, str(x)))
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.string()))], names=["path", "member", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary, error string")


#: What an index must agree on with the engine that reads it.
CONTRACT = ("format_version", "model", "query_prefix", "pooling", "normalize", "dim", "chunk_words", "chunk_overlap_words")


def read_index(spark: SparkSession, path: str, contract: dict) -> DataFrame:
    """An index's documents; a manifest that disagrees with the contract on any of its fields is refused."""
    head = spark.read.parquet(f"{path}/manifest").select(*CONTRACT, "build_id").first()
    wrong = [k for k in CONTRACT if head[k] != contract[k]]
    if wrong:
        raise ValueError(f"the index was built otherwise: {', '.join(wrong)}")
    return spark.read.parquet(f"{path}/build-{head['build_id']}")


def log_tail(spark: SparkSession, path: str, schema: str, n: int = 100) -> DataFrame:
    """The last rows of a JSON log by ``at``; torn lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("at is not null").orderBy(F.desc("at")).limit(n)


def commits_from_log(texts: DataFrame, repo: str, column: str = "value") -> DataFrame:
    """Commits of lines ``sha<TAB>seconds<TAB>author<TAB>subject``, as a log prints them."""
    f = F.split(column, "\t", 4)
    return texts.select(F.lit(repo).alias("repo"), F.get(f, F.lit(0)).alias("sha"), F.timestamp_seconds(F.get(f, F.lit(1)).try_cast("long")).alias("at"), F.get(f, F.lit(2)).alias("author"), F.get(f, F.lit(3)).alias("subject")).where("sha rlike '^[0-9a-f]{40}$' and at is not null")
