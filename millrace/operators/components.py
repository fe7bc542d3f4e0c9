"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.session import release, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours, and itself, on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """``node, component`` for every node with an edge to another; the component is its smallest node.

    Edges are undirected. Loops, null ends and repeated edges are ignored; an empty edge table
    gives an empty result. Every round is a fixed number of shuffle joins whose size is at most the
    number of edges, and the number of rounds grows with the logarithm of the largest component, not
    with its diameter. Each round is written to the shared folder, so a lost executor costs one
    round and the plan never grows.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    now = saved(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components", sweep=True)
    before: tuple = ()
    for _ in range(rounds):
        # The set of edges no longer changes once every edge joins a node with its root; its count and sum come with the write.
        seen = Observation()
        turn = _small_star(_large_star(now)).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        last, now = now, saved(turn, "components", sweep=True)
        release(last)
        state = (seen.get["n"], seen.get["s"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
