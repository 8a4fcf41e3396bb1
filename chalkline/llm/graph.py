"""Connected components by alternating large-star and small-star rounds, all on joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import drop_folder, stage_path


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star round over pairs (a, b): the neighbours of each node are hung on the smallest of them."""
    both = pairs if not large else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ordered = both if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = ordered.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = ordered.join(smallest, "a")
    if large:
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of the nodes of `edges` (columns a, b); the component is its smallest node.

    Rounds stop when the pairs no longer change, which a count and an order-free sum of hashes tell. The stars of a hub are spread
    by the skew handling of the sort-merge join; no node's neighbours are gathered in one place. No edges: no rows.
    """
    spark = edges.sparkSession
    pairs, path = stage_path(edges.where("a <> b").select("a", "b").distinct(), "pairs")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = state(pairs)
    for _ in range(rounds):
        if not last[0]:
            break
        nxt, next_path = stage_path(_star(_star(pairs, True), False), "pairs")
        drop_folder(spark, path)
        pairs, path = nxt, next_path
        now = state(pairs)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    members = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
