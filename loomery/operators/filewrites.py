"""Files that a session's tools wrote, against the prose that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import probes
from .capture import is_machine

#: What an agent's content blocks hold, the tools that write files, and where files do not last. Fixed values.
BLOCKS = "array<struct<type:string,text:string,name:string,input:struct<file_path:string,notebook_path:string>>>"
TOOLS = ("Write", "Edit", "NotebookEdit")
FLEETING = r"^(/private)?/tmp(/|$)|(?i:(^|/)scratchpad(/|$))|(^|/)node_modules(/|$)|(^|/)\.git(/|$)|(?i:\.zip$)"
DOCS = r"(?i)\.(md|txt|rst)$"
CODE = r"(?i)\.(js|mjs|cjs|ts|tsx|jsx|py|sh|bash|zsh|rb|go|rs|c|h|cpp|java|swift|html|css|scss|json|yml|yaml|toml|xml|sql|ipynb)$"
SHORT_REPLY, SHORT_BASE = 200, 12


def kind(path: Column) -> Column:
    """What a written file is: the folder decides before the ending."""
    return F.when(path.rlike("(?i)/knowledge-base/"), "kb").when(path.rlike("/memory/|/MEMORY[.]md$"), "memory").when(path.rlike(DOCS), "doc").when(path.rlike(CODE), "code").otherwise("other")


def blocks(turns: DataFrame) -> DataFrame:
    """turns (session_id, ix, role, content) with ``prose``, the text of content that is plain or an array of JSON blocks, and ``tools``."""
    parsed = F.when(F.col("content").rlike(r"^[\x20\x09-\x0D]*\["), F.from_json("content", BLOCKS))
    prose = F.trim(F.array_join(F.transform(F.filter(parsed, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"))
    tools = F.filter(parsed, lambda b: (b["type"] == "tool_use") & b["name"].isin(*TOOLS))
    return turns.withColumn("prose", F.when(parsed.isNull(), F.coalesce("content", F.lit(""))).otherwise(prose)).withColumn("tools", F.coalesce(tools, F.array().cast(BLOCKS)))


def written(turns: DataFrame) -> DataFrame:
    """(session_id, path, kind): the durable files that each session's tools wrote, once each."""
    calls = blocks(turns).where("role = 'assistant'").select("session_id", F.explode("tools").alias("t")).select("session_id", F.coalesce("t.input.file_path", "t.input.notebook_path").alias("path"))
    return calls.where((F.col("path") != "") & ~F.col("path").rlike(FLEETING)).distinct().withColumn("kind", kind(F.col("path")))


def named(turns: DataFrame, files: DataFrame) -> DataFrame:
    """(session_id, path) of files that their session's prose names, by path or by a base name of 12 letters or more that no other of its files has.

    A session's prose is read once for all its names, in blocks: no pair of a name and a turn is a row.
    """
    base = F.element_at(F.split("path", "/"), -1)
    owners = files.withColumn("base", base).groupBy("session_id", "base").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where((F.col("n") == 1) & (F.length("base") >= SHORT_BASE))
    terms = files.select("session_id", "path", F.col("path").alias("term")).unionByName(owners.select("session_id", "path", F.col("base").alias("term")))
    prose = blocks(turns).where("role in ('user', 'assistant') and prose <> ''")
    own = F.col("session_id").cast("string").alias("a0")
    texts = prose.select(own, F.concat_ws(" ", "session_id", "ix").alias("path"), F.col("prose").alias("text"))
    held = probes.holding(terms.select(own, F.col("term").alias("a1")).distinct(), texts)
    return terms.withColumn("a0", own).join(held.withColumnRenamed("a1", "term"), ["a0", "term"]).select("session_id", "path").distinct()


def measure(turns: DataFrame) -> DataFrame:
    """A row a session: exchanges (a human turn with 200 characters of replies or more), tool_writes, files, named, and files by kind."""
    rows = blocks(turns).where("role in ('user', 'assistant')")
    files = written(turns)
    counts = rows.groupBy("session_id").agg(F.sum(F.when(F.col("role") == "assistant", F.size("tools")).otherwise(0)).alias("tool_writes"))
    said = rows.where("prose <> ''").withColumn("_turn", F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("session_id").orderBy("ix")))
    turn = said.groupBy("session_id", "_turn").agg(F.max(F.when(F.col("role") == "user", ~is_machine(F.col("prose")))).alias("human"), F.sum(F.when(F.col("role") == "assistant", F.length("prose")).otherwise(0)).alias("reply"))
    exchanges = turn.where(F.col("human") & (F.col("reply") >= SHORT_REPLY)).groupBy("session_id").agg(F.count(F.lit(1)).alias("exchanges"))
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    kinds = files.groupBy("session_id").agg(F.count(F.lit(1)).alias("files"), *[of(k) for k in ("kb", "memory", "doc", "code", "other")])
    seen = named(turns, files).groupBy("session_id").agg(F.count(F.lit(1)).alias("named"))
    out = counts.join(exchanges, "session_id", "left").join(kinds, "session_id", "left").join(seen, "session_id", "left")
    return out.fillna(0)
