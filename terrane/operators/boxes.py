"""Boxes of very unequal size that meet, by buckets of many sizes.

A box is at the level whose buckets are just large enough for it, so it touches four of them at most, there and at every
coarser level. Two boxes are looked for at the coarser of their two levels only: one side by its own level, the other by
that level too. So a country and a cell of a kilometre cost a few rows each, whatever the ratio of their sizes, and pairs of
small boxes never meet in a large bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The finest level: a box of no size is there.
FINEST = 40


def level_of(wide: Column, high: Column, largest: float) -> Column:
    """The level of a box: buckets of level 0 are ``largest`` wide and high, and half as much at each further one."""
    size = F.greatest(wide, high)
    return F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(largest) / size)).cast("int")))).otherwise(F.lit(FINEST))


def step_of(level: Column, largest: float) -> Column:
    """The width of a level's buckets: a trifle more than the boxes', so rounding cannot carry one over two borders."""
    return F.lit(largest * (1 + 1e-9)) / F.pow(F.lit(2.0), level)


def meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows whose closed boxes meet, each pair once: all columns of both. The left box is in lx0, ly0, lx1, ly1, the
    right one in rx0, ry0, rx1, ry1; other names must differ. The levels that occur, forty at most, are what the driver sees."""
    size = lambda f, s: f.agg(F.max(F.greatest(F.col(f"{s}x1") - F.col(f"{s}x0"), F.col(f"{s}y1") - F.col(f"{s}y0")))).first()[0] or 0.0
    largest = float(max(size(left, "l"), size(right, "r"))) or 1.0

    def levelled(frame: DataFrame, s: str) -> DataFrame:
        return frame.withColumn(f"{s}level", level_of(F.col(f"{s}x1") - F.col(f"{s}x0"), F.col(f"{s}y1") - F.col(f"{s}y0"), largest))

    left, right = levelled(left, "l"), levelled(right, "r")
    levels = lambda f, s: sorted(r[0] for r in f.select(f"{s}level").distinct().collect() if r[0] is not None)
    at_left, at_right = levels(left, "l"), levels(right, "r")

    def placed(frame: DataFrame, s: str, at: Column) -> DataFrame:
        out = frame.withColumn("at", at)
        for k, axis in (("bi", "x"), ("bj", "y")):
            number = lambda c: F.floor(F.col(c) / step_of(F.col("at"), largest)).cast("long")
            out = out.withColumn(k, F.explode(F.sequence(number(f"{s}{axis}0"), number(f"{s}{axis}1"))))
        return out

    def coarser(frame: DataFrame, s: str, others: list[int], same: bool) -> DataFrame:
        chosen = F.filter(F.array(*[F.lit(o) for o in others]).cast("array<int>"), lambda o: (o <= F.col(f"{s}level")) if same else (o < F.col(f"{s}level")))
        return placed(frame.withColumn("looked", F.explode(chosen)), s, F.col("looked")).drop("looked")

    # Of equal levels the left side's own counts; the home of a pair is the bucket of the lower left corner of what they share.
    one = placed(left, "l", F.col("llevel")).join(coarser(right, "r", at_left, True), ["at", "bi", "bj"])
    two = coarser(left, "l", at_right, False).join(placed(right, "r", F.col("rlevel")), ["at", "bi", "bj"])
    meets = (F.col("lx0") <= F.col("rx1")) & (F.col("rx0") <= F.col("lx1")) & (F.col("ly0") <= F.col("ry1")) & (F.col("ry0") <= F.col("ly1"))
    step = step_of(F.col("at"), largest)
    home = (F.col("bi") == F.floor(F.greatest("lx0", "rx0") / step)) & (F.col("bj") == F.floor(F.greatest("ly0", "ry0") / step))
    return one.unionByName(two).filter(meets & home).drop("at", "bi", "bj", "llevel", "rlevel")
