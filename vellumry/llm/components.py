"""Connected components of a graph by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stash


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the least of its neighbourhood to its larger neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root, the least node of its component, for each node of edges (a, b).

    Each round is aggregated before it is joined, so a node with very many neighbours costs one
    partial aggregate per task, and its join is split by AQE.  Each half of a round is stored in the
    shared folder, which cuts the lineage (the second half reads the first three times, and the driver
    would plan it as often), and the rounds end when one changes no edge.  An edge table without rows
    gives no rows.
    """
    now = stash(edges.select("a", "b").where("a != b").distinct(), "components")
    before, size = None, 0
    for _ in range(rounds):
        last, size = size, now.count()
        # distinct edges: as many as before, and none of those gone, is no change
        settled = not size or before is not None and size == last and before.exceptAll(now).isEmpty()
        if before is not None:
            release(before)
        if settled:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        half = stash(_large_star(now), "components")
        before, now = now, stash(_small_star(half).distinct(), "components")
        release(half)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
