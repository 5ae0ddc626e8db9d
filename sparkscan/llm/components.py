"""Connected components of a table of links, by alternating large and small stars.

Every step is a grouped minimum, combined before its shuffle, and a join on the vertex. The links of a vertex that many link to meet in one
partition of that join unless adaptive execution splits it; they stream and may spill, so they take time but no memory. Each
round is cut from its lineage by a written table; the table before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut_at, remove, shared_dir


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Links (low, high): each vertex's larger (both) or all not larger neighbours are linked to the least of all."""
    down = edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
    near = down.unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v"))) if both else down
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = near.join(least, "u")
    if both:
        out = out.where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high"))
    else:
        out = out.select(F.col("m").alias("low"), F.col("v").alias("high")).unionByName(least.select(F.col("m").alias("low"), F.col("u").alias("high")))
    return out.where("low < high").distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) of each vertex with a link to another; component is its least vertex. links: (a, b)."""
    spark, path, mark = links.sparkSession, shared_dir(links.sparkSession), None
    edges = cut_at(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), path)
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
        if not now.n:
            break
        before, path = path, shared_dir(spark)
        edges = cut_at(_stars(_stars(edges, True), False), path)
        remove(spark, before)
    return edges.select(F.col("high").alias("vertex"), F.col("low").alias("component")).unionByName(edges.select(F.col("low").alias("vertex"), F.col("low").alias("component")).distinct())
