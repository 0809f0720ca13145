"""Neighbours against all distances, vectors against numpy's, and shapes that only their links tell apart."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from terrane.operators import bioregion, spectral


def frame(spark, points):
    return spark.createDataFrame([(f"p{i:04d}", [float(v) for v in p]) for i, p in enumerate(points)], "id string, f array<double>").repartition(4)


def rings(n, seed):
    rng = np.random.default_rng(seed)
    angle, far = rng.uniform(0, 2 * np.pi, n), np.where(np.arange(n) % 2 == 0, 1.0, 4.0)
    return np.stack([far * np.cos(angle), far * np.sin(angle)], 1) + rng.normal(0, 0.05, (n, 2))


def test_graph_holds_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(spectral, "DIRECTIONS", 1)
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(size=(380, 6)), np.repeat(rng.normal(size=(2, 6)), 10, 0)])  # and repeated points
    links, recall = spectral.neighbour_graph(frame(spark, points), 8)
    found = {}
    for r in links.collect():
        found.setdefault(int(r["src"][1:]), {})[int(r["dst"][1:])] = r["d"]
    far = ((points[:, None] - points[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    hits = 0
    for i, own in found.items():
        assert len(own) == 8 and i not in own and all(np.isclose(far[i, j], d) for j, d in own.items())
        hits += sum(d <= np.sort(far[i])[7] + 1e-9 for d in own.values())
    assert recall >= 0.9 and hits / (8 * len(points)) >= 0.9 and len(found) == len(points)


def test_vectors_of_the_laplacian(spark):
    rng = np.random.default_rng(1)
    weight = np.triu((rng.random((40, 40)) < 0.15) * rng.random((40, 40)), 1)
    weight[np.arange(39), np.arange(1, 40)] += 0.3
    weight += weight.T
    links = spark.createDataFrame([(int(i), int(j), float(weight[i, j])) for i, j in zip(*np.nonzero(weight), strict=True)], "src int, dst int, w double")
    got, values = spectral.laplacian_vectors(links, 4)
    degree = weight.sum(1)
    whole = np.eye(40) - weight / np.sqrt(np.outer(degree, degree))
    found, vectors = np.linalg.eigh(whole)
    assert np.allclose(values, found[:4], atol=1e-4)
    own = np.array([r[1:] for r in got.orderBy("id").collect()]) * np.sqrt(degree)[:, None]
    assert np.allclose(np.abs((own * vectors[:, :4]).sum(0)), 1, atol=1e-2)


def test_rings_are_told_apart_and_every_cell_is_clustered(spark):
    points = rings(240, 3)
    vectors = frame(spark, points).select(F.col("id").alias("cell"), array_to_vector("f").alias("features"))
    got = {r["cell"]: r["cluster"] for r in bioregion.cluster_cells(vectors, "spectral", 2, seeds=2).collect()}
    assert len(got) == 240
    inner, outer = ({got[f"p{i:04d}"] for i in range(240) if i % 2 == side} for side in (0, 1))
    assert len(inner) == len(outer) == 1 and inner != outer


def test_a_graph_that_cannot_be_found_raises(spark, monkeypatch):
    monkeypatch.setattr(spectral, "TRIES", 1)
    with pytest.raises(ArithmeticError):
        spectral.neighbour_graph(frame(spark, rings(60, 1)), 5, least=1.01)


def test_parts_without_links_between_them_settle(spark, monkeypatch):
    """Sixty parts of six tight groups each: the largest value comes more often than the subspace is wide, the next are near it."""
    monkeypatch.setattr(spectral, "FILTERS", 8)
    points = spark.range(60 * 36).selectExpr("id", "id div 36 AS part", "id div 6 AS tight")
    two = points.selectExpr("id AS other", "part", "tight AS beside")
    links = points.join(two, "part").filter("id <> other").selectExpr("id AS src", "other AS dst", "if(tight = beside, 1.0D, 0.01D) AS w")
    got, values = spectral.laplacian_vectors(spectral.stored(links), 4)
    assert got.count() == 60 * 36 and np.allclose(values, 0, atol=1e-3)
