"""Connected components by alternating large and small stars, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), both bigint: root is the smallest
    node reachable.  Nodes without edges between different nodes do not appear.

    A round links all larger neighbours of a node to its smallest one, then all smaller
    ones, which at least halves path lengths.  Neighbourhoods are never gathered: a round
    is a minimum per node (combined before the shuffle) and a join that the adaptive plan
    splits at hubs.  Each round is a checkpoint, so a lost executor costs one round."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                                                F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.*").where("a <> b").distinct())
        state = now.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))").alias("h")).first()
        if state == before:
            roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
            tops = now.select(F.col("b").alias("node")).distinct()
            return roots.unionByName(tops.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
        before = state
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
