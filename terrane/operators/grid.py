"""Grids of cells a given number of kilometres wide, and points assigned to them.

The assignment is an equi-join on bucket numbers: a point looks at the nine boxes around it, keeps those whose closed
bounds hold it, and takes the first in grid order. No join on inequalities is planned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.columns import degrees_per_km
from terrane.operators.boxes import level_of, step_of


def cell_name(lon: Column, lat: Column, km: int, scale: int = 100, digits: int = 3) -> Column:
    """Such as ``10kmE012N4385``: the centre's degrees times ``scale``, cut to whole numbers."""
    part = lambda v: F.lpad(F.floor(F.abs(v) * scale).cast("string"), digits, "0")
    whole = lambda v: F.when(F.length(F.floor(F.abs(v) * scale).cast("string")) >= digits, F.floor(F.abs(v) * scale).cast("string")).otherwise(part(v))
    return F.concat(F.lit(f"{km}km"), F.when(lon >= 0, "E").otherwise("W"), whole(lon), F.when(lat >= 0, "N").otherwise("S"), whole(lat))


def zone_bounds(zones: DataFrame, rings: str = "rings") -> DataFrame:
    """One row: the box around all rings, and its middle latitude."""
    points = zones.select(F.explode(F.flatten(rings)).alias("p"))
    return points.agg(F.min("p.x").alias("min_lon"), F.min("p.y").alias("min_lat"), F.max("p.x").alias("max_lon"), F.max("p.y").alias("max_lat")).withColumn("mid_lat", (F.col("min_lat") + F.col("max_lat")) / 2)


def build_grid(spark: SparkSession, min_lon: float, min_lat: float, max_lon: float, max_lat: float, km: int = 10, mid_lat: float | None = None, scale: int = 100, digits: int = 3, country: str | None = None) -> DataFrame:
    """cell, bounds, column i, row j and order of every box of a grid aligned to (0, 0) that covers the bounds.

    Boxes are made on the executors from two ranges; nothing but four numbers is on the driver.
    """
    middle = (min_lat + max_lat) / 2 if mid_lat is None else mid_lat
    dy = km / 111.32
    dx = km / 111.32 / math.cos(math.radians(middle))
    x0, y0 = math.floor(min_lon / dx) * dx, math.floor(min_lat / dy) * dy
    nx, ny = max(1, math.ceil((max_lon - x0) / dx - 1e-12)), max(1, math.ceil((max_lat - y0) / dy - 1e-12))
    boxes = spark.range(nx).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ny - 1).cast("long"))).alias("j"))
    left, low = F.lit(x0) + F.col("i") * dx, F.lit(y0) + F.col("j") * dy
    out = boxes.select("i", "j", left.alias("min_lon"), low.alias("min_lat"), (left + dx).alias("max_lon"), (low + dy).alias("max_lat"))
    lon, lat = (F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2
    named = out.withColumns({"cell": cell_name(lon, lat, km, scale, digits), "ord": F.col("i") * ny + F.col("j")})
    return named.withColumn("country_code", F.lit(country)) if country else named


def zone_grid(zones: DataFrame, km: int = 10, mid_lat: float | None = None, codes: list[str] | None = None, code_col: str = "code", **names) -> DataFrame:
    """The boxes of a grid over the zones that meet any of them. ValueError if no zone is left."""
    from terrane.operators.spatial import meets_zone

    chosen = zones.filter(F.col(code_col).isin(codes)) if codes else zones
    box = zone_bounds(chosen).first()
    if box["min_lon"] is None:
        raise ValueError("no zone with these codes")
    grid = build_grid(zones.sparkSession, box["min_lon"], box["min_lat"], box["max_lon"], box["max_lat"], km, mid_lat, **names)
    return meets_zone(grid, chosen)


def merged_grids(land: DataFrame, sea: DataFrame, cell: str = "cell") -> DataFrame:
    """Both grids, each name once, the maritime box first."""
    both = sea.withColumn("source", F.lit(0)).unionByName(land.withColumn("source", F.lit(1)), allowMissingColumns=True)
    best = F.min(F.struct("source", *[c for c in both.columns if c not in (cell, "source")]))
    found = both.groupBy(cell).agg(best.alias("b"))
    return found.select(cell, *[F.col(f"b.{c}").alias(c) for c in both.columns if c not in (cell, "source")])


def to_cells(points: DataFrame, grid: DataFrame, lon: str = "decimalLongitude", lat: str = "decimalLatitude", cell: str = "cell") -> DataFrame:
    """The points with the first cell, in grid order, whose closed bounds hold them, null if there is none.

    Boxes of a size have buckets just large enough for them, so at each level of size a point's boxes start in its own
    bucket or in one before; each box is in the one bucket of its lower left corner. A country and cells of a kilometre can
    be in one grid: a point looks at a few buckets for each level of size that occurs (``boxes.FINEST`` at most).
    """
    wide, high = F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat")
    largest = float(grid.agg(F.max(F.greatest(wide, high))).first()[0] or 1.0)
    order = F.col("ord") if "ord" in grid.columns else F.struct("min_lon", "min_lat", cell)
    level = level_of(wide, high, largest)
    bucket = lambda c, at: F.floor(F.col(c) / step_of(at, largest)).cast("long")
    boxes = grid.select(level.alias("level"), bucket("min_lon", level).alias("bi"), bucket("min_lat", level).alias("bj"), F.struct(order.alias("o"), F.col(cell).alias("name"), "min_lon", "min_lat", "max_lon", "max_lat").alias("box"))
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect() if r[0] is not None) or [0]
    packed = boxes.groupBy("level", "bi", "bj").agg(F.collect_list("box").alias("boxes"))
    # Each distinct place is looked up once; rows of one place get the answer back by an equi-join.
    places = points.select(F.col(lon).alias("px"), F.col(lat).alias("py")).dropna().distinct()
    near = lambda c: F.array(bucket(c, F.col("level")), bucket(c, F.col("level")) - 1)
    looked = places.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("bi", F.explode(near("px"))).withColumn("bj", F.explode(near("py"))).join(packed, ["level", "bi", "bj"])
    inside = F.filter("boxes", lambda b: (b["min_lon"] <= F.col("px")) & (F.col("px") <= b["max_lon"]) & (b["min_lat"] <= F.col("py")) & (F.col("py") <= b["max_lat"]))
    first = looked.select("px", "py", F.array_min(F.transform(inside, lambda b: F.struct(b["o"].alias("o"), b["name"].alias("name")))).alias("hit")).groupBy("px", "py").agg(F.min("hit").getField("name").alias(cell))
    out = points.drop(cell) if cell in points.columns else points
    return out.join(first, (F.col(lon) == F.col("px")) & (F.col(lat) == F.col("py")), "left").drop("px", "py")


def km_spans(latitude: str) -> list[Column]:
    lat, lon = degrees_per_km(latitude)
    return [lat.alias("lat_per_km"), lon.alias("lon_per_km")]
