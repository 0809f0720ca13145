"""Exact quantiles of groups of any size.

Values are counted first. A group with few distinct values takes the built-in percentile over its counts, which holds them in
one buffer; a group with very many is narrowed down instead: its values are counted in buckets between bounds, by parts before
any exchange, the bucket that holds the wanted rank gives the next bounds, and the bounds are values that occur, so
they meet at the answer. No task ever gets all values of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.stored import stored

#: Distinct values of a group that one buffer holds, buckets of a round, and parts that a large group's values are dealt to.
HELD, BUCKETS, PARTS = 65_536, 256, 16


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """``keys``, q0, q1 ..: each group's quantiles, between two values in proportion. Rows with a null key or a value that is
    null or not a number are left out, and so are groups without any other."""
    number = F.col(value).cast("double")
    counts = stored(rows.dropna(subset=keys).filter(number.isNotNull() & ~F.isnan(number)).groupBy(*keys, number.alias("v")).agg(F.count("*").alias("n")))
    groups = stored(counts.groupBy(*keys).agg(F.count("*").alias("distinct"), F.sum("n").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")))
    names = [f"q{i}" for i in range(len(quantiles))]
    few = counts.join(groups.filter(F.col("distinct") <= HELD).select(*keys), keys, "left_semi")
    small = few.groupBy(*keys).agg(*[F.percentile("v", F.lit(float(q)), F.col("n")).alias(c) for q, c in zip(quantiles, names, strict=True)])
    large = groups.filter(F.col("distinct") > HELD)
    return small if large.isEmpty() else small.unionByName(_narrowed(counts, large, keys, quantiles, names))


def _narrowed(counts: DataFrame, large: DataFrame, keys: list[str], quantiles: list[float], names: list[str]) -> DataFrame:
    place = lambda q: (F.col("total") - 1) * float(q)
    wanted = F.array(*[F.struct(F.lit(2 * i + side).alias("t"), (F.ceil if side else F.floor)(place(q)).cast("long").alias("rank")) for i, q in enumerate(quantiles) for side in (0, 1)])
    open_ = stored(large.select(*keys, "total", F.explode(wanted).alias("w"), "low", "high").select(*keys, "total", "w.t", "w.rank", "low", "high"))
    done = open_.filter("low = high")
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")
    while not (open_ := open_.filter("low < high")).isEmpty():
        copies = open_.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = counts.withColumn("part", part).join(copies, [*keys, "part"]).filter("v BETWEEN low AND high")
        # Halved, for the span of two large numbers may be none.
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")
        held = met.groupBy(*keys, "total", "t", "rank", bucket).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "t").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = held.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        open_ = stored(chosen.select(*keys, "total", "t", (F.col("rank") - F.col("before")).alias("rank"), "low", "high"))
        done = done.unionByName(open_.filter("low = high"))
    value = lambda t: F.max(F.when(F.col("t") == t, F.col("low")))
    found = done.groupBy(*keys).agg(F.max("total").alias("total"), *[value(t).alias(f"_{t}") for t in range(2 * len(quantiles))])
    between = lambda i, q: F.when(F.ceil(place(q)) == F.floor(place(q)), F.col(f"_{2 * i}")).otherwise((F.ceil(place(q)) - place(q)) * F.col(f"_{2 * i}") + (place(q) - F.floor(place(q))) * F.col(f"_{2 * i + 1}"))
    return found.select(*keys, *[between(i, q).alias(c) for i, (q, c) in enumerate(zip(quantiles, names, strict=True))])
