"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm.common import stored


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, root (the smallest node it can be reached from) of all nodes that have links.

    Each round joins every node to the smallest of its neighbours, first those
    above it, then those below; the rounds grow with the logarithm of the longest
    chain.  Each round is a table in the shared folder; the driver sees two sums
    a round.
    """
    a, b = F.greatest(left, right).alias("v"), F.least(left, right).alias("u")
    stars = stored(links.where(F.col(left) != F.col(right)).select(a, b).distinct(), "links")
    mark = None
    while True:
        both = stars.select("v", "u").unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        up = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = up.where("v != u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        down = large.join(low, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        stars = stored(down.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "links")
        row = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        mark = (row["n"], row["h"])
