"""Queries on grids, places, sites and map layers, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrane.operators import cover, filters, grid, layers, spatial
from terrane.plans import fixtures as X
from terrane.plans.queries_facts import FACTS, rounded
from terrane.sources.writers import geojson_features

GRID = "grid AS (SELECT s_suppkey AS cell, CAST(s_suppkey % 50 AS DOUBLE) AS min_lon, CAST(floor(s_suppkey / 50) AS DOUBLE) AS min_lat, CAST(s_suppkey % 50 + 1 AS DOUBLE) AS max_lon, CAST(floor(s_suppkey / 50) + 1 AS DOUBLE) AS max_lat FROM supplier)"
LABELS = "labels AS (SELECT s_suppkey AS cell, CAST(s_nationkey % 5 AS INTEGER) AS cluster FROM supplier)"


def _zones(s, d):
    """A rectangle for each nation, whose corners are its number's digits."""
    n = X.table(s, d, "nation")
    x, y = (F.col("n_nationkey") * 1.7) % 40, (F.col("n_nationkey") * 0.13) % 2
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return n.select(F.col("n_name").alias("site"), F.array(F.array(p(x, y), p(x + 3.3, y), p(x + 3.3, y + 1.4), p(x, y + 1.4))).alias("rings"))


ZONES = "zones AS (SELECT n_name AS site, (n_nationkey * 1.7) % 40 AS x0, (n_nationkey * 0.13) % 2 AS y0 FROM nation)"
COVER = f"{GRID}, {ZONES}, cover AS (SELECT cell, site, greatest(0, least(max_lon, x0 + 3.3) - greatest(min_lon, x0)) * greatest(0, least(max_lat, y0 + 1.4) - greatest(min_lat, y0)) AS a FROM grid, zones)"


#: The union of the clipped boxes of the sites with an n in their name, by the small rectangles between all their sides.
UNION = f"{COVER}, parts AS (SELECT cell, greatest(min_lon, x0) AS lx, least(max_lon, x0 + 3.3) AS hx, greatest(min_lat, y0) AS ly, least(max_lat, y0 + 1.4) AS hy FROM grid JOIN zones ON min_lon < x0 + 3.3 AND x0 < max_lon AND min_lat < y0 + 1.4 AND y0 < max_lat WHERE contains(lower(site), 'n')), xs AS (SELECT cell, x AS a, lead(x) OVER (PARTITION BY cell ORDER BY x) AS b FROM (SELECT cell, lx AS x FROM parts UNION SELECT cell, hx FROM parts)), ys AS (SELECT cell, y AS c, lead(y) OVER (PARTITION BY cell ORDER BY y) AS e FROM (SELECT cell, ly AS y FROM parts UNION SELECT cell, hy FROM parts)), covered AS (SELECT cell, sum((b - a) * (e - c)) AS covered FROM (SELECT DISTINCT xs.cell, a, b, c, e FROM xs JOIN ys ON ys.cell = xs.cell JOIN parts p ON p.cell = xs.cell AND p.lx <= a AND b <= p.hx AND p.ly <= c AND e <= p.hy) GROUP BY cell)"


def _stars(s, d):
    """A concave outline with a hole for each part, at a place and of a size that its numbers give."""
    k, size = F.col("p_partkey"), 1 + F.col("p_size") / 25
    x, y = (k * k % 997) * 0.3, (k * k * k % 991) * 0.2
    far = [1.0, 0.45, 1.2, 0.5, 0.9, 0.4, 1.1, 0.6]
    corner = lambda i, f: F.struct((x + size * f * math.cos(i * math.pi / 4)).alias("x"), (y + size * f * math.sin(i * math.pi / 4)).alias("y"))
    outline = F.array(*[corner(i, f) for i, f in enumerate(far)])
    hole = F.array(*[corner(i, 0.3 * f) for i, f in reversed(list(enumerate(far)))])
    return X.table(s, d, "part").select(k.alias("zone"), F.array(outline, hole).alias("rings"))


def _boxes(s, d):
    return X.table(s, d, "part").select(F.col("p_partkey").alias("zone"), ((F.col("p_partkey") * 37) % 500).cast("double").alias("zx0"), ((F.col("p_partkey") * 91) % 300).cast("double").alias("zy0")).withColumns({"zx1": F.col("zx0") + 4, "zy1": F.col("zy0") + 3})


def _nearest(s, d):
    labels = X.cell_labels(s, d).filter("cell % 3 <> 0")
    return spatial.nearest_cluster(X.supplier_grid(s, d), labels)


def _status(s, d):
    from terrane.operators.temporal import STATUS, status_map

    colours = {v: f"#{i:06d}" for i, v in enumerate(sorted(set(STATUS.values())))}
    rows = status_map(X.facts_by_period(s, d), "cell", "species_id").select("cell", "species_id", "status")
    return layers.status_layer(rows, X.supplier_grid(s, d), colours).select("cell", "species_id", "min_lon", "colour")


QUERIES = {
    "points_to_cells": (lambda s, d: grid.to_cells(X.points(s, d), X.supplier_grid(s, d), "lon", "lat").select("l_orderkey", "l_linenumber", "lon", "lat", F.col("cell").cast("string").alias("cell")), f"WITH {GRID}, p AS (SELECT l_orderkey, l_linenumber, l_quantity AS lon, round(l_tax * 100, 4) + 0.0 AS lat FROM lineitem), u AS (SELECT DISTINCT lon, lat FROM p), hit AS (SELECT lon, lat, arg_min(cell, (min_lon, min_lat, cell)) AS cell FROM u JOIN grid ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat GROUP BY lon, lat) SELECT p.*, CAST(cell AS VARCHAR) AS cell FROM p LEFT JOIN hit USING (lon, lat)"),
    "build_grid": (lambda s, d: rounded(grid.build_grid(s, -2.0, 42.0, 3.0, 45.0, 10).select("cell", "i", "j", "ord", "min_lon", "min_lat"), "min_lon", "min_lat"), "WITH g AS (SELECT 10 / 111.32 AS dy, 10 / 111.32 / cos(radians(43.5)) AS dx), o AS (SELECT *, floor(-2.0 / dx) * dx AS x0, floor(42.0 / dy) * dy AS y0 FROM g), n AS (SELECT *, CAST(ceil((3.0 - x0) / dx - 1e-12) AS BIGINT) AS nx, CAST(ceil((45.0 - y0) / dy - 1e-12) AS BIGINT) AS ny FROM o), b AS (SELECT i, j, i * ny + j AS ord, x0 + i * dx AS min_lon, y0 + j * dy AS min_lat, dx, dy FROM n, range(0, 200) r1(i), range(0, 200) r2(j) WHERE i < nx AND j < ny) SELECT '10km' || CASE WHEN min_lon + dx / 2 >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(CAST(floor(abs((min_lon + min_lon + dx) / 2) * 100) AS BIGINT) AS VARCHAR), 3, '0') || CASE WHEN min_lat >= 0 THEN 'N' ELSE 'S' END || CAST(CAST(floor(abs((min_lat + min_lat + dy) / 2) * 100) AS BIGINT) AS VARCHAR) AS cell, i, j, ord, round(min_lon, 6) AS min_lon, round(min_lat, 6) AS min_lat FROM b"),
    "centred_in": (lambda s, d: filters.centred_in(X.supplier_grid(s, d), 0, 1.5, 5.5, 20.5).select("cell"), f"WITH {GRID} SELECT cell FROM grid WHERE (min_lat + max_lat) / 2 BETWEEN 0 AND 1.5 AND (min_lon + max_lon) / 2 BETWEEN 5.5 AND 20.5"),
    "in_area": (lambda s, d: filters.in_area(X.facts(s, d), X.supplier_grid(s, d), 5, 20, 0, 1), f"WITH {FACTS}, {GRID} SELECT facts.* FROM facts WHERE cell IN (SELECT cell FROM grid WHERE (min_lat + max_lat) / 2 BETWEEN 0 AND 1 AND (min_lon + max_lon) / 2 BETWEEN 5 AND 20)"),
    "zone_overlaps": (lambda s, d: rounded(spatial.overlaps(X.supplier_grid(s, d), _zones(s, d)).filter("overlap > 1e-9").select("cell", "site", "overlap"), "overlap"), f"WITH {COVER} SELECT cell, site, round(a, 6) AS overlap FROM cover WHERE a > 1e-9"),
    "cells_of_site": (lambda s, d: spatial.cells_of_site(X.supplier_grid(s, d), _zones(s, d), "n", 0.6), f"WITH {UNION} SELECT cell FROM covered WHERE covered >= 0.6"),
    "cover_of_sites": (lambda s, d: rounded(cover.cover(X.supplier_grid(s, d), _zones(s, d).filter("contains(lower(site), 'n')"), []), "covered"), f"WITH {UNION} SELECT cell, round(covered, 6) AS covered FROM covered"),
    "name_sites": (lambda s, d: spatial.name_sites(X.facts(s, d), X.supplier_grid(s, d), _zones(s, d), 0.55), f"WITH {FACTS}, {COVER}, m AS (SELECT cell, max(site) AS site_name FROM cover WHERE a >= 0.55 GROUP BY cell) SELECT facts.*, site_name FROM facts LEFT JOIN m USING (cell)"),
    "zone_bounds": (lambda s, d: rounded(grid.zone_bounds(_zones(s, d)), "min_lon", "min_lat", "max_lon", "max_lat", "mid_lat"), f"WITH {ZONES} SELECT round(min(x0), 6) AS min_lon, round(min(y0), 6) AS min_lat, round(max(x0 + 3.3), 6) AS max_lon, round(max(y0 + 1.4), 6) AS max_lat, round((min(y0) + max(y0 + 1.4)) / 2, 6) AS mid_lat FROM zones"),
    "polygon_area": (lambda s, d: rounded(_zones(s, d).select("site", spatial.polygon_area(F.col("rings")).alias("area")), "area"), "SELECT n_name AS site, round(CAST(3.3 * 1.4 AS DOUBLE), 6) AS area FROM nation"),
    "to_mercator": (lambda s, d: rounded(X.supplier_grid(s, d).select("cell", *[c.alias(k) for c, k in zip(spatial.to_mercator(F.col("min_lon"), F.col("min_lat")), ("x", "y"), strict=True)]), "x", "y", digits=3).withColumn("y", F.col("y") + 0.0), f"WITH {GRID} SELECT cell, round(radians(min_lon) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(min_lat) / 2)) * 6378137.0, 3) + 0.0 AS y FROM grid"),
    "cluster_centroids": (lambda s, d: rounded(spatial.cluster_centroids(X.supplier_grid(s, d), X.cell_labels(s, d)), "x", "y"), f"WITH {GRID}, {LABELS} SELECT cluster, round(avg(min_lon + 0.5), 6) AS x, round(avg(min_lat + 0.5), 6) AS y FROM grid JOIN labels USING (cell) GROUP BY cluster"),
    "nearest_cluster": (_nearest, f"WITH {GRID}, l AS (SELECT s_suppkey AS cell, CAST(s_nationkey % 5 AS INTEGER) AS cluster FROM supplier WHERE s_suppkey % 3 <> 0), c AS (SELECT cluster, avg(min_lon + 0.5) AS x, avg(min_lat + 0.5) AS y FROM grid JOIN l USING (cell) GROUP BY cluster), n AS (SELECT cell, cluster, row_number() OVER (PARTITION BY cell ORDER BY sqrt(pow(min_lon + 0.5 - x, 2) + pow(min_lat + 0.5 - y, 2)), cluster) AS r FROM grid, c WHERE cell % 3 = 0) SELECT cell, cluster FROM l UNION ALL SELECT cell, cluster FROM n WHERE r = 1"),
    "intersecting_pairs": (lambda s, d: spatial.intersecting_pairs(_boxes(s, d), 5.0).select("a", "b"), "WITH z AS (SELECT p_partkey AS k, (p_partkey * 37) % 500 AS x, (p_partkey * 91) % 300 AS y FROM part) SELECT a.k AS a, b.k AS b FROM z a JOIN z b ON a.k < b.k AND a.x < b.x + 4 AND b.x < a.x + 4 AND a.y < b.y + 3 AND b.y < a.y + 3"),
    "resolve_polygons": (lambda s, d: cover.resolve_polygons(_stars(s, d), 20.0), None),
    "resolve_overlaps": (lambda s, d: spatial.resolve_overlaps(_boxes(s, d), 5.0), None),
    "continuous_layer": (lambda s, d: layers.continuous_layer(X.facts(s, d), X.supplier_grid(s, d), low=50, high=650)[0], f"WITH {FACTS}, {GRID}, t AS (SELECT cell, CAST(sum(n_obs) AS DOUBLE) AS v FROM facts GROUP BY cell) SELECT grid.*, CAST(CASE WHEN v < 50 THEN 50 WHEN v > 650 THEN 650 ELSE v END AS DOUBLE) AS n_obs FROM grid LEFT JOIN t USING (cell)"),
    "discrete_layer": (lambda s, d: layers.discrete_layer(X.cell_labels(s, d), X.supplier_grid(s, d))[0].select("cell", "min_lon", F.col("cluster").cast("string").alias("cluster")), f"WITH {GRID}, {LABELS} SELECT cell, min_lon, CAST(cluster AS VARCHAR) AS cluster FROM grid LEFT JOIN labels USING (cell)"),
    "point_layer": (lambda s, d: layers.point_layer(X.facts(s, d), X.supplier_grid(s, d)), f"WITH {FACTS}, {GRID} SELECT cell, CAST(sum(n_obs) AS BIGINT) AS n_obs, any_value(min_lon) + 0.5 AS x, any_value(min_lat) + 0.5 AS y FROM facts LEFT JOIN grid USING (cell) GROUP BY cell"),
    "status_layer": (_status, None),
    "geojson_features": (lambda s, d: geojson_features(X.supplier_grid(s, d), ["cell"]), None),
}
