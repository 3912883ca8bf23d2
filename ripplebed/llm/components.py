"""Connected components of a graph of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplebed.llm.base import new_path, remove, write_table


def _least(edges: DataFrame) -> DataFrame:
    """For each node u of (u, v) its least neighbour or itself; partial minima are taken before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")).where("u <> v"))


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for the nodes of links (u, v), both long.

    Each round is two joins and two aggregations over the links; rounds go on
    until the links no longer change, when every node links to its least.
    """
    spark = links.sparkSession

    def written(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
        path = new_path(spark, "links")
        return write_table(df, path, rows), path

    edges, path = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or state["n"] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, last = state, path
        # A round makes no more links than there were, and one for each node at most.
        edges, path = written(_small_star(_large_star(edges).distinct()).distinct(), 2 * state["n"])
        remove(spark, last)
