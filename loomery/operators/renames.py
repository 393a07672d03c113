"""Names of exchanges that hang on their time instead of their place, checked before anything is renamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: A name by place, and the line that names the exchange before. Fixed values.
BY_PLACE = "^x-([0-9a-f]{8})-([0-9]{4})$"
PREVIOUS = r"(?m)^Previous: \[\[([^\]]+)\]\]$"
LAST_PREVIOUS = r"(?sm)\A(.*)^Previous: \[\[[^\]]+\]\]$"


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping, problems): (name, new_name) of every exchange that is named by place, and (name, problem) of what forbids renaming.

    docs: name, session_id, ts. Problems: no session; no time (a name cannot be made up for it); a new name that a document has, or that two documents would
    have, whatever their sessions; a session whose order by new names is not the old one. The mapping is one to one wherever
    there is no problem: each is found by a grouped count or a join, none by looking at pairs.
    """
    rows = docs.where(F.col("name").rlike(BY_PLACE)).select("name", "session_id", "ts", F.regexp_extract("name", BY_PLACE, 1).alias("sid8"), F.regexp_extract("name", BY_PLACE, 2).cast("int").alias("place"))
    stamp = F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmssSSS"), F.lit("Z"))
    rows = rows.withColumn("new_name", F.when(F.col("session_id").isNotNull() & F.col("ts").isNotNull(), F.concat(F.lit("x-"), "sid8", F.lit("-"), stamp)))
    problem = lambda d, text: d.select("name", F.lit(text).alias("problem"))
    found = problem(rows.where("session_id is null"), "no session").unionByName(problem(rows.where("session_id is not null and ts is null"), "no time"))
    planned = rows.where("new_name is not null")
    held = docs.where(~F.col("name").rlike(BY_PLACE)).select(F.col("name").alias("new_name")).distinct()
    twice = planned.groupBy("new_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("new_name")
    found = found.unionByName(problem(planned.join(held, "new_name", "left_semi"), "name is taken")).unionByName(problem(planned.join(twice, "new_name", "left_semi"), "name for several"))
    w = Window.partitionBy("sid8", "session_id")
    moved = planned.withColumn("_old", F.row_number().over(w.orderBy("place", "name"))).withColumn("_new", F.row_number().over(w.orderBy("new_name", "place", "name"))).where("_old <> _new")
    first = moved.groupBy("sid8", "session_id").agg(F.min_by("name", F.struct("_old", "name")).alias("name"))
    return planned.select("name", "new_name"), found.unionByName(problem(first, "order changes"))


def apply(docs: DataFrame, mapping: DataFrame, problems: DataFrame) -> DataFrame:
    """docs renamed, and the last Previous line of each body with them; raises, before anything is read further, if there is a problem.

    Only the last such line links to the exchange before: others are quoted. A link whose target keeps its name stays.
    """
    if not problems.isEmpty():
        raise ValueError("renaming has problems: " + "; ".join(f"{r['name']}: {r['problem']}" for r in problems.orderBy("name").limit(20).collect()))
    links = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(PREVIOUS), F.lit(1))
    rows = docs.withColumn("_link", F.try_element_at(links, F.lit(-1)))
    rows = rows.join(mapping.select(F.col("name"), F.col("new_name").alias("_name")), "name", "left").join(mapping.select(F.col("name").alias("_link"), F.col("new_name").alias("_to")), "_link", "left")
    body = F.when(F.col("_to").isNotNull(), F.regexp_replace("body", F.lit(LAST_PREVIOUS), F.concat(F.lit("$1Previous: [["), "_to", F.lit("]]")))).otherwise(F.col("body"))
    return rows.withColumn("body", body).withColumn("name", F.coalesce("_name", "name")).select(*docs.columns)


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: documents before and after, names still by place, links to nothing."""
    names = after.select(F.col("name").alias("_link")).distinct()
    links = after.select(F.explode(F.slice(F.reverse(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(PREVIOUS), F.lit(1))), 1, 1)).alias("_link"))
    lost = links.join(names, "_link", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    n = after.agg(F.count(F.lit(1)).alias("after"), F.count_if(F.col("name").rlike(BY_PLACE)).alias("by_place"))
    return before.agg(F.count(F.lit(1)).alias("before")).join(n).join(lost)  # three tables of one row
