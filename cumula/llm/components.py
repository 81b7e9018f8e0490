"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Tie every neighbour of u to the least of u and its neighbours; the result has u above v.

    ``larger``: only neighbours above u move; else ``links`` has u above v, all
    neighbours move, and u itself.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    joined = links.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the least neighbour stands for u
        out = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u above v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    mixed = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
    return mixed.agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.

    ``edges`` has two comparable columns u and v. Each round contracts stars
    (large, then small) and is a table in the shared folder; the edge count
    never grows, and the rounds are logarithmic in the longest path. They end
    when only stars are left, so links that are stars already take none. Self
    loops and repeated edges are ignored, an empty table gives an empty result.
    """
    current = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(current):
            break
        current = written(_star(_star(_both(current), larger=True), larger=False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
