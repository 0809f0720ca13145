"""Registered queries leave out no rows: small tables whose results are worked out by hand or by plain loops."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from terrane.operators import bioregion, fit, linkage, outliers
from terrane.operators.temporal import STATUS
from terrane.plans import queries_clusters, registry

#: Supplier, part and year of each line item; years of the three periods are up to 1996, 1998 and 2001.
LINES = [(c, p, y) for c in range(1, 8) for p in range(1, 13) for y in (1995, 1997, 1999) if (c * 31 + p * 17 + y * 7) % 5 < 2]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    lines = [(c, p, datetime.date(y, 6, 1)) for c, p, y in LINES]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_shipdate date").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(c, c % 3) for c in range(1, 9)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    parts = [(p, "T", f"Brand#{p % 4}", p, f"n{p}") for p in range(1, 13)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string, p_size int, p_name string").write.parquet(f"{folder}/part.parquet")
    return folder


def test_status_layer_has_every_cell_and_species(spark, small):
    colours = {v: f"#{i:06d}" for i, v in enumerate(sorted(set(STATUS.values())))}
    want = {}
    for c, p in {(c, p) for c, p, _ in LINES}:
        seen = {y for a, b, y in LINES if (a, b) == (c, p)}
        want[c, p] = (float(c % 50), colours[STATUS[tuple(int(y in seen) for y in (1995, 1997, 1999))]])
    got = registry.queries()["status_layer"](spark, small).collect()
    assert len(got) == len(want) and {(r.cell, r.species_id): (r.min_lon, r.colour) for r in got} == want


def observed():
    counts = {}
    for c, p, _ in LINES:
        counts[c, p] = counts.get((c, p), 0) + 1
    return counts


def test_every_cell_is_completed(spark, small):
    counts = observed()
    cells, kinds = {c for c, _ in counts}, {p for _, p in counts}
    want = {(c, p): counts.get((c, p), 0) for c in cells for p in kinds}
    got = registry.queries()["completed_all"](spark, small).collect()
    assert len(got) == len(want) and {(r.cell, r.species_id): r.n_obs for r in got} == want


def test_missing_clades_of_every_cell(spark, small):
    table = np.zeros((7, 4))
    for (c, p), n in observed().items():
        table[c - 1, p % 4] += n
    table[:, 3] = 0
    table[2, 3] = 5
    table[4, 1] = 0
    rows = spark.createDataFrame([(c + 1, f"Brand#{k}", int(table[c, k])) for c in range(7) for k in range(4) if table[c, k]], "cell long, class string, n_obs long")
    found = queries_clusters.missing_in_cells(rows, "class").collect()
    predicted = table @ np.corrcoef(table.T)
    want = {(c + 1, f"Brand#{k}"): round(predicted[c, k], 4) for c in range(7) for k in range(4) if not table[c, k]}
    assert len(want) > 6 and {(r.cell, r["class"]) for r in found} == set(want)
    assert all(abs(r.n_obs_predicted - want[r.cell, r["class"]]) < 1e-3 for r in found)


def test_bounds_of_forests_come_from_all_rows(spark):
    rng = np.random.default_rng(3)
    s, n = np.round(rng.random((300, 2)), 3), rng.integers(1, 9, 300)
    scored = spark.createDataFrame([(a.tolist(), int(k)) for a, k in zip(s, n, strict=True)], "s array<double>, n long")
    for q in (0.0, 0.5, 0.937, 0.99, 1.0):
        assert outliers.score_bounds(scored, 2, q) == [float(np.quantile(np.repeat(s[:, k], n), q)) for k in (0, 1)]


def test_forest_vote_is_the_same_however_rows_are_dealt(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(int(c), int(c) % 7, int(v)) for c, v in enumerate(rng.lognormal(3, 1, 3000))], "cell int, species_id int, n_obs long")
    found = []
    for parts in (1, 7):
        got = outliers.forest_vote(rows.repartition(parts), rounds=5, contamination=0.02, trees=20, sample=300)
        found.append({r.cell for r in got.filter("outlier").collect()})
    assert found[0] == found[1] and 0 < len(found[0]) <= 2 * 0.02 * 3000


@pytest.mark.parametrize("n", [1, 2, 300])
def test_ward_by_sums_is_the_tree_of_linkage(n):
    points = np.random.default_rng(6).normal(size=(n, 4))
    want, got = linkage.linkage(points), linkage.ward_by_sums(points)
    assert np.allclose(got, want)


def test_ward_takes_more_cells_than_a_table_holds(spark, monkeypatch):
    monkeypatch.setattr(bioregion, "MOST_LINKED", 10)
    rows = [(c, float(c % 3) * 100 + c * 0.01, float(c % 2)) for c in range(40)]
    vectors = bioregion.packed(spark.createDataFrame(rows, "cell int, a double, b double"), ["a", "b"])
    got = {r.cell: r.cluster for r in bioregion.cluster_cells(vectors, "ward", 3).collect()}
    assert len(got) == 40 and len({(got[c], c % 3) for c in got}) == 3
    with pytest.raises(ValueError):
        bioregion.cluster_cells(vectors, "average", 3)


def test_power_law_over_many_points_is_that_of_all_points(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.arange(1, 60), rng.lognormal(1, 1.5, 200), [900.0, 4000.0]])
    y = 0.8 * x**0.6 + rng.normal(0, 0.3, len(x))
    points = spark.createDataFrame(list(zip(np.tile(x, 2).tolist(), np.concatenate([y, y + 0.5]).tolist(), strict=True)), "x double, y double")
    want = fit.fit_law(points, "power")
    monkeypatch.setattr(fit, "MOST_POINTS", 40)
    assert np.allclose(fit.fit_law(points, "power"), want, rtol=1e-6)
