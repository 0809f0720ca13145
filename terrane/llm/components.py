"""Connected components of a link table, without bringing links or members together in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.tables import dropped, written


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of ``links`` (a, b).

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then its
    smaller neighbours to its smallest one. Both are grouped minima with partial sums before the shuffle and a join on
    the node; the number of rounds grows with the logarithm of a component's size.
    """
    spark = links.sparkSession
    pairs, at = written(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct())
    size = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("low", "node").alias("low"))
        large = both.filter("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("low").alias("other")).distinct()
        least = large.groupBy("node").agg(F.min("other").alias("low"))
        small = large.join(least, "node").select(F.when(F.col("other") == F.col("low"), F.col("node")).otherwise(F.col("other")).alias("node"), F.col("low").alias("other")).distinct()
        following, there = written(small)
        dropped(spark, at)
        pairs, at = following, there
        # The links stay the same once each node has one, to its root.
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if state == size:
            return pairs.select("node", F.col("other").alias("root"))
        size = state
