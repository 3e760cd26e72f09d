"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """``(id, component)`` of every node of ``edges(u, v)``; a component is named by its smallest node.

    Each round is written to the shared folder, so lineage stays short and a lost executor repeats one
    round at most. A node with very many neighbours only meets one row, its smallest neighbour, in a join.
    An empty edge table gives an empty result.
    """
    now, seen = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                            .where("u <> v").distinct(), label), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        if state == seen:
            break
        seen = state
        now = materialize(_small_star(_large_star(now)), label)
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")) \
        .union(roots.select("id", F.col("id").alias("component")))
