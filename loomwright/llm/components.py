"""Connected components of an edge table by alternating large and small stars.

Every round replaces edges by edges to smaller ids, with aggregates and joins only; nothing is collected,
and the lineage is cut by a table in the shared folder. Stars, paths and trees end in a few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, towards the smallest neighbour of each node: large moves larger neighbours, small the others."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("x", "m").alias("m"))
    met = both.join(least, both["u"] == least["x"])
    moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("x", "m"))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """From pairs of ids: (node, component), the smallest id reachable, for each node that has an edge to another."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    state = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before = state(now)
    for _ in range(most_rounds):
        if not before["n"]:
            break
        last, now = now, written(_star(_star(now, True), False), "edges")
        discard(last)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
