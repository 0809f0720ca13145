"""Data behind map layers: what is drawn, its range and its ticks. Drawing itself is not part of this engine."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import clamped
from terrane.operators.normalise import logarithm

#: Labels of a legend.
MOST_LABELS = 10_000


def rounded(x: float | None, digits: int = 3, direction: str = "nearest") -> float:
    """A number to its significant digits; ValueError for none and for an unknown direction."""
    ways = {"nearest": round, "up": math.ceil, "down": math.floor}
    if x is None or direction not in ways:
        raise ValueError("a number and a direction of nearest, up or down are needed")
    if x == 0:
        return 0.0
    factor = 10.0 ** (digits - math.floor(math.log10(abs(x))) - 1)
    return ways[direction](x * factor) / factor


def continuous_layer(rows: DataFrame, grid: DataFrame, value: str = "n_obs", log: bool = False, low: float | None = None, high: float | None = None, quantiles: tuple[float, float] = (0.0, 1.0), cell: str = "cell") -> tuple[DataFrame, dict]:
    """The grid with each cell's value (0 as null, within bounds), and range and ticks; ValueError if no value is left."""
    sums = rows.filter(F.col(cell).isNotNull()).groupBy(cell).agg(F.sum(value).alias(value))
    if log:
        sums = logarithm(sums, value).select(cell, F.col(f"{value}_log").alias(value))
    shown = sums.select(cell, clamped(F.nullif(F.col(value).cast("double"), F.lit(0.0)), low, high).alias(value))
    layer = grid.join(shown, cell, "left")
    a, b = layer.agg(*[F.percentile(value, F.lit(q)) for q in quantiles]).first()
    if a is None:
        raise ValueError("no cell has a value")
    least, most = rounded(a, 3, "down"), rounded(b, 3, "up")
    return layer, {"min": least, "max": most, "ticks": [rounded(least + (most - least) * k / 4) for k in range(5)]}


def discrete_layer(labels: DataFrame, grid: DataFrame, column: str = "cluster", cell: str = "cell") -> tuple[DataFrame, dict]:
    """The grid with labels, and their range and distinct values: a legend, so ValueError beyond MOST_LABELS of them."""
    values = [r[0] for r in labels.select(column).distinct().dropna().orderBy(column).limit(MOST_LABELS + 1).collect()]
    if len(values) > MOST_LABELS:
        raise ValueError(f"a legend holds at most {MOST_LABELS} labels")
    return grid.join(labels.select(cell, column), cell, "left"), {"min": values[0] if values else None, "max": values[-1] if values else None, "labels": values}


def point_layer(rows: DataFrame, grid: DataFrame, value: str = "n_obs", cell: str = "cell") -> DataFrame:
    """cell, value, x, y for each observed cell; the centre is null where the grid lacks the cell."""
    sums = rows.filter(F.col(cell).isNotNull()).groupBy(cell).agg(F.sum(value).alias(value))
    centres = grid.select(cell, ((F.col("min_lon") + F.col("max_lon")) / 2).alias("x"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("y"))
    return centres.join(sums, cell, "right").select(cell, value, "x", "y")


def status_layer(status: DataFrame, grid: DataFrame, colours: dict[str, str], cell: str = "cell") -> DataFrame:
    """The cells with a status, their boxes and colours; ValueError for a status without a colour."""
    unknown = [r[0] for r in status.select("status").distinct().filter(F.col("status").isNotNull() & ~F.col("status").isin(list(colours))).limit(20).collect()]
    if unknown:
        raise ValueError(f"no colour for {', '.join(sorted(unknown))}")
    colour = F.lit(None).cast("string")
    for name, value in colours.items():
        colour = F.when(F.col("status") == name, F.lit(value)).otherwise(colour)
    return grid.join(status, cell, "right").withColumn("colour", colour)


def site_labels(sites: DataFrame, site: str = "site") -> DataFrame:
    """Names and places (means of corners) of sites to write on a map, buffer zones left out."""
    points = F.flatten("rings")
    mean = lambda k: F.aggregate(F.transform(points, lambda p: p[k]), F.lit(0.0), lambda s, v: s + v) / F.size(points)
    return sites.filter(~F.col(site).contains("adhésion")).select(site, mean("x").alias("x"), mean("y").alias("y"))


def viewport(settings: dict) -> tuple[float, float, float, float]:
    """x0, x1, y0, y1 of a view given by centre, height and size of the picture."""
    half = settings["height"] / 2
    wide = half * settings["size_x"] / settings["size_y"]
    return settings["center_x"] - wide, settings["center_x"] + wide, settings["center_y"] - half, settings["center_y"] + half
