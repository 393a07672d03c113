"""Connected components of a table of links, without collecting any of it.

Rounds of large-star and small-star (Kiveris and others, 2014): every node's neighbours are hung on the
smallest of them, first the larger ones, then the smaller ones, until nothing changes. Rounds grow with
the logarithm of a component's length. Each round is a grouped minimum, which is summed up before it is
shuffled, and a join that Spark may split where one node has very many links. Each round is written to
the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .sparkutil import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): hangs the neighbours above u (or, of small-star, those below) on u's smallest neighbour."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(flipped) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component."""
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, seen = written(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        edges = written(_star(_star(edges, large=True), large=False), "links")
