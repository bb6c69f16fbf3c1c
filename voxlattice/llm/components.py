"""Connected components of a link table, without the driver: alternating large-star and small-star steps.

Each round rewires every node to smaller neighbours (Kiveris et al., "Connected Components in MapReduce and Beyond").
A round is two aggregations by min, which combine before the shuffle, and two joins; hubs are only joined, never
gathered, so a component of any size passes through as rows. The links are written to the shared folder after each
round, which cuts the lineage; the driver sees only the two numbers that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, root for every node of a link: root is the smallest node id of its component. Self links and nulls go."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(most_rounds):
        # large star: neighbours above u go to the least of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below go to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
