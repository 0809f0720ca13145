"""Polygons and boxes: areas, clipping, cells of a site, centroids, projections, overlaps.

A polygon is an array of rings of (x, y); outlines and holes turn opposite ways, so signed areas add up. Areas of a
polygon inside a box come from clipping each ring against the four sides; sites cover what the union of their rings holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import site_name
from terrane.operators.boxes import meeting
from terrane.operators.cover import RINGS, cover, resolve_polygons
from terrane.operators.stored import stored

#: Radius of the sphere of web maps, in metres (fixed value).
EARTH = 6378137.0


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace formula; the last corner joins the first."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, following, lambda p, q: p.x * q.y - q.x * p.y), F.lit(0.0), lambda s, v: s + v) / 2


def polygon_area(rings: Column) -> Column:
    return F.abs(F.aggregate(F.transform(rings, ring_area), F.lit(0.0), lambda s, v: s + v))


def box_area() -> Column:
    return (F.col("max_lon") - F.col("min_lon")) * (F.col("max_lat") - F.col("min_lat"))


def clip_ring(ring: np.ndarray, low: tuple[float, float], high: tuple[float, float]) -> np.ndarray:
    """The part of a ring inside a box, one side after the other (Sutherland-Hodgman)."""
    for axis in (0, 1):
        for bound, sign in ((low[axis], 1.0), (high[axis], -1.0)):
            if not len(ring):
                return ring
            inside = sign * (ring[:, axis] - bound) >= 0
            out = []
            for k in range(len(ring)):
                a, b = ring[k - 1], ring[k]
                if inside[k - 1] != inside[k]:
                    t = (bound - a[axis]) / (b[axis] - a[axis])
                    cut = a + t * (b - a)
                    cut[axis] = bound
                    out.append(cut)
                if inside[k]:
                    out.append(b)
            ring = np.array(out).reshape(-1, 2)
    return ring


def signed_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clipped_area(rings: list, low: tuple[float, float], high: tuple[float, float]) -> float:
    return abs(sum(signed_area(clip_ring(np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2), low, high)) for ring in rings))


def _bounded(zones: DataFrame, rings: str = "rings") -> DataFrame:
    points = F.flatten(rings)
    x, y = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return zones.withColumns({"zx0": F.array_min(x), "zx1": F.array_max(x), "zy0": F.array_min(y), "zy1": F.array_max(y)})


def overlaps(grid: DataFrame, zones: DataFrame) -> DataFrame:
    """Cells and zones whose boxes meet, with ``overlap``: the zone's area inside the cell.

    Boxes of any sizes find each other by buckets of the coarser one's size (see ``boxes``); rings are joined by the zone's
    number only once pairs are known, and areas run in Arrow batches.
    """
    numbered = stored(_bounded(zones).filter("zx0 IS NOT NULL").withColumn("_zone", F.monotonically_increasing_id()))
    cells = grid.withColumns({"lx0": F.col("min_lon"), "ly0": F.col("min_lat"), "lx1": F.col("max_lon"), "ly1": F.col("max_lat")})
    outlines = numbered.select("_zone", F.col("zx0").alias("rx0"), F.col("zy0").alias("ry0"), F.col("zx1").alias("rx1"), F.col("zy1").alias("ry1"))
    pairs = meeting(cells, outlines).select("_zone", *[F.col(f"`{c}`") for c in grid.columns])
    both = pairs.join(numbered.drop("zx0", "zx1", "zy0", "zy1"), "_zone").drop("_zone")
    names = both.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["overlap"] = [clipped_area(r, (x0, y0), (x1, y1)) for r, x0, y0, x1, y1 in zip(b["rings"], b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"], strict=True)]
            yield b.drop(columns=["rings"])

    kept = [c for c in names if c != "rings"]
    schema = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in kept) + ", overlap double"
    return both.mapInPandas(run, schema)


def meets_zone(grid: DataFrame, zones: DataFrame) -> DataFrame:
    """Grid cells that a zone covers in part."""
    names = grid.columns
    hit = overlaps(grid, zones.select("rings")).filter("overlap > 0").select("min_lon", "min_lat").distinct()
    return grid.join(hit, ["min_lon", "min_lat"], "left_semi").select(*names)


def cells_of_site(grid: DataFrame, sites: DataFrame, name: str, least: float = 0.5, how: str = "contains", site: str = "site") -> DataFrame:
    """Distinct cells of which the sites of a name cover at least a share of ``least``.

    contains looks for the name anywhere in the site's, upper and lower case alike; anything else for the same name.
    """
    wanted = F.contains(F.lower(site), F.lit(name.lower())) if how == "contains" else F.col(site) == name
    found = cover(grid, sites.filter(wanted).select("rings"), [])
    return found.join(grid.select("cell", box_area().alias("area")), "cell").filter(F.col("covered") >= least * F.col("area")).select("cell")


def name_sites(rows: DataFrame, grid: DataFrame, sites: DataFrame, least: float = 0.5, site: str = "site", cell: str = "cell") -> DataFrame:
    """The rows with the site of their cell; of several the last in name order. All sites are placed by one join."""
    cleaned = sites.select(site_name(site).alias("site_name"), "rings")
    found = cover(grid, cleaned, ["site_name"]).join(grid.select("cell", box_area().alias("area")), "cell")
    named = found.filter(F.col("covered") >= least * F.col("area")).groupBy(F.col("cell").alias(cell)).agg(F.max("site_name").alias("site_name"))
    return rows.join(named, cell, "left")


def dissolve(zones: DataFrame, by: str) -> DataFrame:
    """One multipolygon a name; a zone's rings are a bounded description of its outline."""
    return zones.filter(F.col(by).isNotNull()).groupBy(by).agg(F.flatten(F.collect_list("rings")).alias("rings"))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres of web maps."""
    return F.radians(lon) * EARTH, F.ln(F.tan(F.lit(np.pi / 4) + F.radians(lat) / 2)) * EARTH


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - F.lit(np.pi / 2))


@dataclass(frozen=True)
class Conic:
    """A conformal conic projection with two standard parallels, in degrees, and its ellipsoid."""

    first: float
    second: float
    lat: float
    lon: float
    false_x: float = 0.0
    false_y: float = 0.0
    radius: float = 6378137.0
    flattening: float = 1 / 298.257222101

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def shape(self) -> tuple[float, float, float]:
        """The cone's constant, its scale, and the distance of the origin from its tip."""
        e = self.eccentricity

        def narrow(degrees: float) -> float:
            s = math.sin(math.radians(degrees))
            return math.tan(math.pi / 4 - math.radians(degrees) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

        def wide(degrees: float) -> float:
            return math.cos(math.radians(degrees)) / math.sqrt(1 - (e * math.sin(math.radians(degrees))) ** 2)

        if self.first == self.second:
            n = math.sin(math.radians(self.first))
        else:
            n = math.log(wide(self.first) / wide(self.second)) / math.log(narrow(self.first) / narrow(self.second))
        scale = wide(self.first) / (n * narrow(self.first) ** n)
        return n, scale, self.radius * scale * narrow(self.lat) ** n


#: The projection of national maps of France, in which the outlines of parks are given (fixed values).
NATIONAL = Conic(44.0, 49.0, 46.5, 3.0, 700000.0, 6600000.0)


def to_conic(lon: Column, lat: Column, conic: Conic = NATIONAL) -> tuple[Column, Column]:
    """Degrees to metres of a conformal conic projection."""
    n, scale, tip = conic.shape()
    e = conic.eccentricity
    s = F.sin(F.radians(lat)) * e
    far = conic.radius * scale * F.pow(F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2)), F.lit(n))
    turn = n * F.radians(lon - conic.lon)
    return conic.false_x + far * F.sin(turn), conic.false_y + tip - far * F.cos(turn)


def from_conic(x: Column, y: Column, conic: Conic = NATIONAL) -> tuple[Column, Column]:
    """Metres of a conformal conic projection to degrees. The latitude comes from the conformal one by its series in the
    eccentricity, to its tenth power: the rest is far below a millimetre."""
    n, scale, tip = conic.shape()
    across, down = x - conic.false_x, tip - (y - conic.false_y)
    sign = 1.0 if n > 0 else -1.0
    far = sign * F.sqrt(across * across + down * down)
    turn = F.atan2(sign * across, sign * down)
    round_ = math.pi / 2 - 2 * F.atan(F.pow(far / (conic.radius * scale), F.lit(1 / n)))
    q = conic.eccentricity**2
    # Coefficients of the sines of even multiples of the conformal latitude.
    series = (q / 2 + 5 * q**2 / 24 + q**3 / 12 + 13 * q**4 / 360 + 3 * q**5 / 160, 7 * q**2 / 48 + 29 * q**3 / 240 + 811 * q**4 / 11520 + 81 * q**5 / 2240, 7 * q**3 / 120 + 81 * q**4 / 1120 + 3029 * q**5 / 53760, 4279 * q**4 / 161280 + 883 * q**5 / 20160, 2087 * q**5 / 161280)
    lat = sum((c * F.sin(2 * (k + 1) * round_) for k, c in enumerate(series)), round_)
    return F.degrees(turn / n) + conic.lon, F.degrees(lat)


def cluster_centroids(grid: DataFrame, labels: DataFrame, cell: str = "cell", cluster: str = "cluster") -> DataFrame:
    """cluster, x, y: centroids of the clusters' cells, weighted by area."""
    x, y, w = (F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2, box_area()
    return grid.join(labels, cell).groupBy(cluster).agg((F.sum(x * w) / F.sum(w)).alias("x"), (F.sum(y * w) / F.sum(w)).alias("y"))


def nearest_cluster(grid: DataFrame, labels: DataFrame, squared: bool = False, cell: str = "cell", cluster: str = "cluster") -> DataFrame:
    """cell, cluster of every grid cell: its label, or that of the nearest centroid (ties to the smaller label).

    Centroids are one row a cluster, so they go to every task.
    """
    centres = F.broadcast(cluster_centroids(grid, labels, cell, cluster))
    free = grid.join(labels, cell, "left_anti").select(cell, ((F.col("min_lon") + F.col("max_lon")) / 2).alias("px"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("py"))
    d = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    near = free.join(centres).groupBy(cell).agg(F.min(F.struct((d if squared else F.sqrt(d)).alias("d"), F.col(cluster).alias("c"))).getField("c").alias(cluster))
    return labels.select(cell, cluster).unionByName(near)


#: Comparisons of one part of a bucket and of one task on average, and tasks at most.
COMPARED, BY_TASK, MOST_TASKS = 4_000_000, 20_000_000, 20_000


def intersecting_pairs(boxes: DataFrame, step: float, key: str = "zone") -> DataFrame:
    """a, b (a < b): boxes (zone, zx0, zy0, zx1, zy1) that meet, each pair once, found through buckets of ``step``.

    Boxes of a crowded bucket are dealt to parts, each of which meets the whole bucket; tasks go by comparisons, as pairs
    may be far more than boxes.
    """
    span = lambda c0, c1: F.explode(F.sequence(F.floor(F.col(c0) / step), F.floor(F.col(c1) / step)))
    dealt = boxes.withColumn("bi", span("zx0", "zx1")).withColumn("bj", span("zy0", "zy1"))
    size = F.count("*").cast("double")
    counts = stored(dealt.groupBy("bi", "bj").agg((size * size).alias("work")))
    tasks = int(min(MOST_TASKS, max(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), (counts.agg(F.sum("work")).first()[0] or 0) // BY_TASK)))
    dealt = dealt.join(counts.select("bi", "bj", F.ceil(F.col("work") / COMPARED).cast("int").alias("parts")), ["bi", "bj"])
    cols, place = ("zx0", "zy0", "zx1", "zy1"), ["bi", "bj", "part"]
    one = dealt.select("bi", "bj", F.pmod(F.xxhash64(key), "parts").cast("int").alias("part"), F.col(key).alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    two = dealt.select("bi", "bj", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    # A pair is counted in the bucket that holds the lower left corner of what both share.
    home = (F.col("bi") == F.floor(F.greatest("a_zx0", "b_zx0") / step)) & (F.col("bj") == F.floor(F.greatest("a_zy0", "b_zy0") / step))
    meets = "a < b AND a_zx0 < b_zx1 AND b_zx0 < a_zx1 AND a_zy0 < b_zy1 AND b_zy0 < a_zy1"
    met = one.repartition(tasks, *place).join(two.repartition(tasks, *place).hint("merge"), place)
    return met.filter(meets).filter(home).select("a", "b", *[f"a_{c}" for c in cols], *[f"b_{c}" for c in cols])


def resolve_overlaps(boxes: DataFrame, step: float, key: str = "zone") -> DataFrame:
    """zone, x0, y0, x1, y1: ``resolve_polygons`` of boxes (zone, zx0, zy0, zx1, zy1), whose parts are boxes again."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(corner("zx0", "zy0"), corner("zx1", "zy0"), corner("zx1", "zy1"), corner("zx0", "zy1"))
    parts = resolve_polygons(boxes.select(key, F.array(ring).cast(RINGS).alias("rings")), step, key).select(key, F.explode("rings").alias("r"))
    ends = lambda f, c: f(F.transform("r", lambda p: p[c]))
    return parts.select(key, ends(F.array_min, "x").alias("x0"), ends(F.array_min, "y").alias("y0"), ends(F.array_max, "x").alias("x1"), ends(F.array_max, "y").alias("y1"))
