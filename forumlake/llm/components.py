"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import discard
from forumlake.session import durable


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node it can reach) of every node that is in a link.

    ``links`` has columns a and b. Each round hangs every node's larger neighbours, and then
    its smaller ones, under the smallest; the number of rounds grows with the logarithm
    of the longest path. Rounds are stored tables. A node with many links is
    aggregated in the map tasks, and its rows can be split in the joins.
    """
    edges = durable(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct())
        mark = tuple(state)
        both = edges.union(edges.select("v", "u"))
        first = least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u <> v").distinct())
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, durable(small.union(least).where("u <> v").distinct())
        for stage in (before, first, large, least):
            discard(stage)
