"""Connected components by alternating large-star and small-star, on DataFrames of integer node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweir.llm.common import checkpointed, hot_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    lowest = checkpointed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n_")))
    return hot_join(both.where("v > u"), lowest, "u", "n_", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = checkpointed(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_")))
    moved = hot_join(down, lowest, "u", "n_", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node on an edge (u, v).

    Both steps only ever group by a node and keep a minimum, so a hub with very many neighbours is aggregated on the map side,
    and its one minimum is joined by broadcast. Each step is held in the shared folder, so that the driver's plans stay small; the loop ends when
    the edges are stars. Null ends, loops and repeated edges are ignored; without edges the result is empty.
    """
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, stars = _state(now)
    while not stars:
        now = checkpointed(_small_star(checkpointed(_large_star(now, n)), n))
        n, stars = _state(now)
    root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges (u, v) with v < u, and whether they are stars: no u has two v, and none is a v too."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    row = each.agg(F.sum("up").alias("n"), F.max(F.expr("up > 1 OR (up > 0 AND down > 0)")).alias("more")).first()
    return row["n"] or 0, not row["more"]
