"""Boxes of unequal size against all pairs, and points in grids of them."""

from __future__ import annotations

import numpy as np
import pytest

from terrane.operators import boxes, grid, spatial


def mixed(rng, n, countries=2):
    size = 10.0 ** rng.uniform(-3, 0, n)
    size[:countries], size[countries : countries + 2] = 60.0, 0.0
    low = rng.uniform(-20, 20, (n, 2)).round(3)
    low[:countries] = -30
    high = low + np.stack([size, size * rng.uniform(0.2, 1, n)], 1)
    return [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(low, high, strict=True))]


@pytest.mark.parametrize("seed", [0, 1])
def test_pairs_of_unequal_boxes(spark, seed):
    rng = np.random.default_rng(seed)
    left, right = mixed(rng, 150), mixed(rng, 90, 1)
    right += [(90, *left[5][1:]), (91, left[7][3], left[7][4], left[7][3] + 1, left[7][4] + 1)]  # the same box, and one that touches
    schema = lambda s: ", ".join([f"{s}id int", *[f"{s}{c} double" for c in ("x0", "y0", "x1", "y1")]])
    found = boxes.meeting(spark.createDataFrame(left, schema("l")), spark.createDataFrame(right, schema("r")))
    got = sorted((r["lid"], r["rid"]) for r in found.collect())
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert got == want and len(want) > 100
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_points_in_a_country_and_its_cells(spark):
    rng = np.random.default_rng(4)
    cells = [(f"c{i}_{j}", i / 100, j / 100, (i + 1) / 100, (j + 1) / 100) for i in range(20) for j in range(20)]
    cells += [("country", -50.0, -50.0, 50.0, 50.0), ("county", 0.05, 0.05, 3.0, 2.0), ("spot", 0.111, 0.111, 0.111, 0.111)]
    table = spark.createDataFrame(cells, "cell string, min_lon double, min_lat double, max_lon double, max_lat double")
    points = [*map(tuple, rng.uniform(-0.1, 0.4, (300, 2)).round(2).tolist()), (0.111, 0.111), (60.0, 0.0), (-50.0, 50.0), (2.5, 1.5)]
    got = {(r["lon"], r["lat"]): r["cell"] for r in grid.to_cells(spark.createDataFrame(points, "lon double, lat double"), table, "lon", "lat").collect()}
    for p in points:
        holding = [c for c in cells if c[1] <= p[0] <= c[3] and c[2] <= p[1] <= c[4]]
        want = min(holding, key=lambda c: (c[1], c[2], c[0]))[0] if holding else None
        assert got[p] == want


def test_overlaps_of_a_country_and_small_cells(spark):
    rings = "array<array<struct<x:double,y:double>>>"
    square = lambda x, s: [[(x, x), (x + s, x), (x + s, x + s), (x, x + s)]]
    zones = spark.createDataFrame([("country", square(-40.0, 80.0)), ("spot", square(0.105, 0.01))], f"site string, rings {rings}")
    table = spark.createDataFrame([("a", 0.1, 0.1, 0.11, 0.11), ("b", 45.0, 45.0, 45.01, 45.01), ("whole", -90.0, -90.0, 90.0, 90.0)], "cell string, min_lon double, min_lat double, max_lon double, max_lat double")
    got = {(r["cell"], r["site"]): round(r["overlap"], 9) for r in spatial.overlaps(table, zones).filter("overlap > 0").collect()}
    assert got == {("a", "country"): 0.0001, ("a", "spot"): 0.000025, ("whole", "country"): 6400.0, ("whole", "spot"): 0.0001}
