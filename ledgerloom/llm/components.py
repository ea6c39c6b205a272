"""Union-find grouping on Spark: connected components by alternating large and small stars.

Every round hangs each node's larger neighbours, then its smaller ones, on the smallest id it knows.  Rounds are stored
in the shared folder, so a lost executor costs a re-read; only two numbers per round reach the driver.  Hubs are
pre-aggregated (a minimum) and their edges sit on the side of a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = both.join(least, "u")
    if large:
        hung = hung.where(F.col("v") > F.col("u"))
    out = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) for each node that has an edge to another.  Nulls in an edge drop it."""
    now = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = stored(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
