"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a partial aggregation and a join; a node with very many links is split by adaptive execution, and no
group is gathered. Every round is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.runtime import materialize, release


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` of longs to ``(node, component)``: the smallest node that each linked node reaches."""
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        # stars: no leaf has two centres, and no centre is a leaf itself
        n, leaves = links.agg(F.count("*"), F.count_distinct("u")).first()
        if n == leaves and links.join(links.select(F.col("u").alias("leaf")), F.col("v") == F.col("leaf"), "left_semi").isEmpty():
            break
        # large star: every larger neighbour of u is linked with the smallest node around u
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        release(least)
        # small star: every smaller neighbour of u, and u, are linked with the smallest of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        release(least, large, links)
        links = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
