"""Small hand-made tables with the edges that the driver's tables lack: nulls, zeros, ties, constant columns."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import bioregion, cleaning, correlate, explore, facts, filters, fit, grid, indices, layers, linkage, names, normalise, outliers, spatial, species_clusters, temporal


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def observed(spark):
    rows = [("a", 1, 3), ("a", 2, 1), ("b", 1, 2), ("b", 3, 0), ("c", 4, 0), ("c", 4, 0), (None, 1, 5), ("a", None, 7)]
    return spark.createDataFrame(rows, "cell string, species_id int, n_obs long")


def test_counts_drop_unknown_keys(spark):
    rows = spark.createDataFrame([("a", "1", "1995"), ("a", "1", "abc"), (None, "1", "1995"), ("a", None, "1995"), ("a", "2", None)], "cell string, species_id string, year string")
    assert rows_of(facts.count_cells(rows, with_taxonomy=False)) == [("a", 1, 2), ("a", 2, 1)]
    assert rows_of(facts.count_cells(rows, first_year=1990, bounds=[1990, 2000], with_taxonomy=False)) == [("a", 1, "Période 1: 1991 à 2000", 1)]


def test_taxonomy_takes_the_fullest_row(spark):
    rows = spark.createDataFrame([(1, "P", None, "x"), (1, "P", "C", "y"), (1, "P", "C", "x"), (2, None, None, None)], "species_id int, kingdom string, class string, species string")
    assert facts.taxonomy(rows).columns == ["species_id", "species", "class", "kingdom"]
    assert rows_of(facts.taxonomy(rows)) == [(1, "x", "C", "P"), (2, None, None, None)]


def test_indices_of_zero_cells(observed):
    got = {r["cell"]: r for r in indices.diversity_indices(observed).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["c"]["shannon"] == 0 and got["c"]["simpson"] == 1 and got["c"]["n_species"] == 0
    assert math.isclose(got["a"]["shannon"], -(0.75 * math.log10(0.75) + 0.25 * math.log10(0.25)))
    assert math.isclose(got["a"]["simpson"], 1 - (9 + 1) / 16)
    assert math.isclose(got["a"]["endemism"], 0.5 + 1)


def test_indices_of_nothing(observed):
    assert indices.diversity_indices(observed.filter("false")).collect() == []


def test_normalised_cells_share_one_total(observed):
    got = normalise.per_cell(observed.filter("cell <> 'c'"))
    sums = {r[0]: r[1] for r in got.groupBy("cell").agg(F.sum("n_obs_per_cell")).collect() if r[0]}
    assert math.isclose(sums["a"], sums["b"])


def test_null_keys_have_no_share(observed):
    got = [r for r in normalise.per_species(observed).collect() if r["species_id"] is None]
    assert [r["n_obs_per_species"] for r in got] == [None]


def test_logarithm_threshold(spark):
    rows = spark.createDataFrame([(0.0,), (2.0,), (20.0,), (None,)], "n_obs double")
    assert sorted(r["n_obs_log"] for r in normalise.logarithm(rows).collect()) == [0.0, 0.0, 0.0, 1.0]


def test_status_of_all_eight(spark):
    got = {}
    for key in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]:
        labels = [f"Période {k + 1}: x" for k in range(3) if key[k]]
        got[key] = spark.createDataFrame([(labels,)], "p array<string>").select(temporal.status_of(F.col("p"))).first()[0]
    assert got == temporal.STATUS | {(0, 0, 0): None}


def test_turnover(spark):
    p = [f"Période {k}: x" for k in (1, 2, 3)]
    rows = spark.createDataFrame([("a", 1, p[0]), ("a", 1, p[1]), ("a", 2, p[0]), ("a", 3, p[2]), ("b", 1, p[1]), ("c", 1, p[2])], "cell string, species_id int, period string")
    got = {r["cell"]: r for r in temporal.turnover(rows).collect()}
    assert (got["a"]["n_total"], got["a"]["n_p1"], got["a"]["n_p1_and_p2"], got["a"]["rate_lost"], got["a"]["rate_new"]) == (4, 2, 1, 50.0, 0.0)
    assert got["b"]["rate_lost"] is None and got["b"]["rate_new"] == 100.0
    assert got["c"]["n_p2"] == 0


def test_filters(spark, observed):
    with pytest.raises(ValueError):
        filters.in_category(observed, "dragons")
    assert filters.well_observed(observed, 5).select("species_id").distinct().collect()[0][0] == 1
    named = observed.withColumn("name", F.when(F.col("cell") == "a", "Red Fox"))
    assert filters.in_cells(named, ["a"]).count() == 3
    assert named.filter(filters.matches_text(named, "FOX")).count() == 3
    assert filters.shown(observed, ["cell", "n_obs", "cell"]).columns == ["cell", "n_obs"]


def test_ranks():
    assert explore.next_rank("kingdom") == "class" and explore.next_rank("famille") == "genre" and explore.next_rank("planet") == "kingdom"
    for narrowest in ("species", "nomVernaculaire"):
        with pytest.raises(ValueError):
            explore.next_rank(narrowest)


def dense_of(rng, cells=12, kinds=5):
    v = rng.integers(0, 4, (cells, kinds)) * rng.integers(0, 2, (cells, kinds))
    v[:, -1] = 2
    return v


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlations_against_dense_tables(spark, method):
    v = dense_of(np.random.default_rng(4))
    rows = spark.createDataFrame([(int(c), int(k), int(v[c, k])) for c in range(len(v)) for k in range(v.shape[1]) if v[c, k] or k == 0], "cell int, species_id int, n_obs int")

    def rank(x):
        return np.array([(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x])

    def want(x, y):
        if x.min() == x.max() or y.min() == y.max():
            return None
        if method == "kendall":
            a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
            return float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))
        if method == "spearman":
            x, y = rank(x), rank(y)
        return float(np.corrcoef(x, y)[0, 1])

    matrix = {(r[0], r[1]): r[2] for r in correlate.correlation_matrix(rows, method=method).collect()}
    subject = {r[0]: r[1] for r in correlate.subject_correlation(rows, 0, method=method).collect()}
    for i in range(v.shape[1]):
        for j in range(v.shape[1]):
            if v[:, i].any() and v[:, j].any():
                w = want(v[:, i].astype(float), v[:, j].astype(float))
                assert matrix[i, j] is w or math.isclose(matrix[i, j], w, abs_tol=1e-9)
        w = want(v[:, i].astype(float), v[:, 0].astype(float))
        assert subject[i] is w or math.isclose(subject[i], w, abs_tol=1e-9)


def test_unknown_correlation(observed):
    with pytest.raises(ValueError):
        correlate.correlation_matrix(observed, method="cosine")


def test_prediction_is_a_matrix_product(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, 0), ("a", 9, 5)], "cell string, species_id int, n_obs int")
    matrix = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.5), (1, 2, 0.5), (2, 2, None)], "species_i int, species_j int, r double")
    got = {r["species_id"]: r["n_obs_predicted"] for r in correlate.predict(rows, matrix).collect()}
    assert got == {1: 2.0, 2: 1.0, 9: 0.0}
    absent = correlate.missing_species(correlate.predict(rows, matrix), "n_obs_predicted")
    assert [r["species_id"] for r in absent.collect()] == [2]


@pytest.mark.parametrize(("law", "coefficients"), [("linear", [0.5, 2.0]), ("power", [0.8, 0.6]), ("exp", [0.2, -1.0])])
def test_fits(spark, law, coefficients):
    from terrane.functions.laws import LAWS

    x = np.arange(1, 12, dtype=float)
    points = spark.createDataFrame(list(zip(x.tolist(), LAWS[law](x, *coefficients).tolist(), strict=True)), "x double, y double")
    assert np.allclose(fit.fit_law(points, law), coefficients, atol=1e-4)


def test_winsorised_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(1, v) for v in (0, 1, 2, 3)] + [(None, 9)], "species_id int, n_obs int")
    got = [r["n_obs_corrected"] for r in outliers.winsorised(rows, 0.5).orderBy("n_obs").collect()]
    assert got == [0.0, 1.0, 2.0, 2.0, 9.0]


def test_forest_finds_a_far_value(spark):
    rows = spark.createDataFrame([(k % 3, float(k % 7)) for k in range(400)] + [(1, 900.0)], "species_id int, n_obs double")
    got = outliers.forest_vote(rows, rounds=10, contamination=0.01, trees=20)
    assert got.filter("outlier AND n_obs = 900").count() == 1 and got.filter("outlier").count() < 12


def test_points_on_edges_take_the_first_cell(spark):
    boxes = grid.build_grid(spark, 0.0, 0.0, 0.5, 0.5, 10, 0.0)
    b = boxes.filter("i = 1 AND j = 1").first()
    corner = (b["min_lon"], b["min_lat"])
    points = spark.createDataFrame([corner, (b["min_lon"] + 0.01, b["min_lat"]), (50.0, 50.0), (None, 1.0)], "decimalLongitude double, decimalLatitude double")
    got = {(r["decimalLongitude"], r["decimalLatitude"]): r["cell"] for r in grid.to_cells(points, boxes).collect()}
    name = {(r["i"], r["j"]): r["cell"] for r in boxes.collect()}
    for (x, y), cell in got.items():
        inside = [r for r in boxes.collect() if x is not None and r["min_lon"] <= x <= r["max_lon"] and r["min_lat"] <= y <= r["max_lat"]]
        assert cell == (min(inside, key=lambda r: r["ord"])["cell"] if inside else None)
    assert len(name) == boxes.count()


def test_clipping():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    for low, high, area in (((-1, -1), (3, 3), 4.0), ((5, 5), (6, 6), 0.0), ((1, 0), (3, 2), 2.0), ((0.5, 0.5), (1, 1), 0.25)):
        assert math.isclose(abs(spatial.signed_area(spatial.clip_ring(square, low, high))), area, abs_tol=1e-12)
    hollow = np.array([(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4)], float)
    assert math.isclose(abs(spatial.signed_area(spatial.clip_ring(hollow, (0, 2), (4, 4)))), 4.0)


def test_sites(spark):
    boxes = spark.createDataFrame([("in", 0.0, 0.0, 1.0, 1.0), ("half", 1.0, 0.0, 2.0, 1.0), ("out", 5.0, 5.0, 6.0, 6.0)], "cell string, min_lon double, min_lat double, max_lon double, max_lat double")
    ring = [(0.0, 0.0), (1.5, 0.0), (1.5, 1.0), (0.0, 1.0)]
    sites = spark.createDataFrame([("Big Park", [ring])], "site string, rings array<array<struct<x:double,y:double>>>")
    assert rows_of(spatial.cells_of_site(boxes, sites, "park")) == [("half",), ("in",)]
    assert rows_of(spatial.cells_of_site(boxes, sites, "park", 0.6)) == [("in",)]
    assert rows_of(spatial.cells_of_site(boxes, sites, "park", 0.5, "exact")) == []
    assert rows_of(spatial.meets_zone(boxes, sites).select("cell")) == [("half",), ("in",)]
    assert math.isclose(sites.select(spatial.polygon_area(F.col("rings"))).first()[0], 1.5)


def test_overlaps_are_resolved(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 3.0, 3.0), (3, 9.0, 9.0, 10.0, 10.0)], "zone int, zx0 double, zy0 double, zx1 double, zy1 double")
    parts = spatial.resolve_overlaps(boxes, 1.0).collect()
    assert math.isclose(sum((p.x1 - p.x0) * (p.y1 - p.y0) for p in parts), 4 + 4 - 1 + 1)


@pytest.mark.parametrize("method", linkage.METHODS)
def test_linkage_against_a_plain_search(method):
    points = np.random.default_rng(2).normal(size=(14, 3))
    groups, heights = [[i] for i in range(14)], []
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = points[groups[i]], points[groups[j]]
                d = np.linalg.norm(a[:, None] - b[None], axis=2)
                h = {"single": d.min(), "complete": d.max(), "average": d.mean()}.get(method)
                if h is None:
                    h = math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(a.mean(0) - b.mean(0))
                if best is None or h < best[0]:
                    best = (h, i, j)
        heights.append(best[0])
        groups[best[2]] += groups.pop(best[1])
    assert np.allclose(linkage.linkage(points, method)[:, 2], heights)


def test_spatial_kmeans_parts_two_groups(spark):
    rows = [(i, float(i % 2) * 10 + i * 0.01, float(i % 2) * 5, 0.0) for i in range(20)]
    points = spark.createDataFrame(rows, "cell int, f double, x double, y double")
    for mode in ("euclidean", "squared", "neighbor"):
        labels, total = bioregion.spatial_kmeans(points, ["f"], 2, mode, starts=2, rounds=8)
        got = {r["cell"]: r["cluster"] for r in labels.collect()}
        assert len({(got[i], i % 2) for i in got}) == 2 and total >= 0


def test_components_are_centred(spark):
    vectors = bioregion.packed(spark.createDataFrame([(k, float(k), 2.0 * k + 1, float(k % 2)) for k in range(10)], "cell int, a double, b double, c double"), ["a", "b", "c"])
    scores, shares = bioregion.principal_components(vectors)
    assert scores.columns == ["cell", "PC1"] and shares[0] > 0.9
    assert abs(scores.agg(F.avg("PC1")).first()[0]) < 1e-9


def test_species_trees(spark):
    matrix = spark.createDataFrame([(i, j, 1.0 if (i < 2) == (j < 2) else -1.0) for i in range(4) for j in range(4)], "species_i int, species_j int, r double")
    got = {r["species_id"]: r["cluster_corr"] for r in species_clusters.cluster_species(matrix, 1.0).collect()}
    assert got[0] == got[1] != got[2] == got[3]


def test_cleaning(spark):
    raw = spark.createDataFrame([("1", "Vulpes vulpes vulpes", "A1 | B2", "2020-01-05", None), ("2", "Vulpes", "A1", "x", "Z"), (None, "A b", "A1", "x", "Z"), ("3", None, "A1", "x", "Z")], "cdRef string, nomScientifiqueRef string, codeMaille10Km string, dateObservation string, classe string")
    raw = raw.withColumn("codeInseeDepartement", F.lit("01"))
    got = cleaning.clean_inventory(raw, "reptiles").collect()
    assert [(r["cdRef"], r["nomScientifique"], r["codeMaille10Km"], r["classe"], r["day"]) for r in got] == [("1", "Vulpes vulpes", "A1", "Reptilia", 5)]


def test_names(spark):
    rows = spark.createDataFrame([(1, "red fox", "en"), (1, "Red Fox", "en"), (1, "vixen", "en"), (1, "goupil", "fr"), (1, "renard", "fr"), (2, None, "fr")], "taxon_id int, name string, language string")
    assert rows_of(names.name_dictionary(rows)) == [(1, "Goupil", "Red Fox")]


def test_layers(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 1.0, 0.0, 2.0, 1.0)], "cell string, min_lon double, min_lat double, max_lon double, max_lat double")
    values = spark.createDataFrame([("a", 1234), ("b", 0)], "cell string, n_obs int")
    layer, spec = layers.continuous_layer(values, boxes)
    assert rows_of(layer.select("cell", "n_obs")) == [("a", 1234.0), ("b", None)] and spec["max"] == 1240.0
    with pytest.raises(ValueError):
        layers.continuous_layer(values.filter("n_obs = 0"), boxes)
    with pytest.raises(ValueError):
        layers.status_layer(spark.createDataFrame([("a", "odd")], "cell string, status string"), boxes, {"known": "#fff"})
