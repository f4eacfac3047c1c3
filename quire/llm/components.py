"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import spread, written
from quire.staging import discard


def _star(links: DataFrame, larger: bool, total: int) -> DataFrame:
    """One round: each node's neighbours (the larger or the smaller ones) are linked with the node's least neighbour."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    sided = both if larger else both.where("other < node")
    least = sided.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"), F.count(F.lit(1)).alias("n"))
    joined = spread(sided, least, "node", total)
    moved = joined.where(F.col("other") > F.col("node")) if larger else joined
    pairs = moved.select(F.col("other").alias("a"), F.col("least").alias("b"))
    if not larger:
        pairs = pairs.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """`node`, `component` (its least reachable node) for the ends of `links` (columns a, b of one ordered type).

    Every round is written to the shared folder, so lineage stays short and a lost executor costs one round;
    the round before it goes then. Ends when a round changes nothing: then each node is linked with its
    component's least node alone. The number of rounds grows with the logarithm of the longest chain. Nodes
    with many neighbours are joined on the map side (`spread`), so no task gets a whole component.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    total = 2 * now.count()
    for _ in range(rounds):
        half = written(_star(now, True, total), "links")
        after = written(_star(half, False, total), "links")
        discard(now, half)
        now = after
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if mark == before:
            break
        before = mark
        total = 2 * mark["n"]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
