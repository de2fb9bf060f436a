"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps only ever point a node at a smaller one, so labels end as the least node of each component. Edges are
stored in the shared folder after each round; the driver sees two sums a round, no links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` has two columns of one ordered type. Gives ``node`` and ``root`` (the least node of its component)
    for every node that has an edge to another one. Nulls and loops in the edges are ignored."""
    a, b = edges.columns
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND u <> v").select("u", "v").distinct(), "edges",
    )
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = now.agg(F.count(F.lit(1)), total).first()
    for _ in range(rounds):
        now = stored(_small_star(_large_star(now)), "edges")
        after = now.agg(F.count(F.lit(1)), total).first()
        if after == before:
            roots = now.select("v").distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
