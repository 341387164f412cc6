"""Connected components of an edge table, with DataFrame steps only.

Alternates large-star and small-star: in a large-star step every node points its larger
neighbours at the smallest node it knows; in a small-star step it points its smaller
neighbours and itself there.  Paths shrink geometrically and every round is two aggregations
and two joins over the edges, whatever the shape of the components; the rounds end when all edges are stars.  Hot nodes are
pre-aggregated before the shuffle by the minimum, and the join that follows has plain
exchanges on both sides, so adaptive execution can split a hot node's edges.

Each round is written to the shared folder: lineage stays one round long and a lost
executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    sides = _both(edges)
    near = sides.groupBy("u").agg(F.min("v").alias("m")) if large else sides.where("v < u").groupBy("u").agg(F.min("v").alias("m"))
    near = near.withColumn("m", F.least("u", "m"))
    joined = sides.join(near, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    moved = joined.where("v < u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (``u`` the larger) are stars around their smallest nodes: no node is at two stars or at both ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("outer"), F.lit(0).alias("inner")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("outer"), F.lit(1).alias("inner")))
    open_nodes = ends.groupBy("node").agg(F.sum("outer").alias("outer"), F.max("inner").alias("inner")).where("outer + inner > 1")
    return not open_nodes.agg(F.count("*")).first()[0]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of ``edges``
    (columns u, v; order, repeats and self-links do not matter)."""
    now = common.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        if _settled(now):
            break
        # Two stars in one job; only their result is kept.
        nxt = common.written(_star(_star(now, True), False).distinct(), "edges")
        common.dropped(now)
        now = nxt
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
