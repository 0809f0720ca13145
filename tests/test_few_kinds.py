"""Predictions without a matrix, and the complete table without a shuffle of the product."""

from __future__ import annotations

import random

import pytest

from terrane.operators import correlate, facts, few_kinds, pair_blocks


@pytest.fixture
def rows(spark):
    rng = random.Random(5)
    found = [(c, k, rng.randint(1, 9)) for c in range(40) for k in range(30) if rng.random() < 0.3]
    # One kind is the same in every cell: its coefficients are null.
    return spark.createDataFrame([*found, *[(c, 99, 2) for c in range(40)]], "cell long, species_id long, n_obs long")


def test_sums_of_predictions_are_those_of_the_matrix(spark, rows):
    local = rows.filter("cell IN (3, 4, 7)")
    whole = correlate.predict(facts.completed(local, rows), correlate.correlation_matrix(rows))
    want = {r[0]: (r[1], r[2]) for r in whole.groupBy("species_id").sum("n_obs", "n_obs_predicted").collect()}
    got = {r[0]: (r[1], r[2]) for r in correlate.predict_sums(local, rows).collect()}
    assert got.keys() == want.keys() and any(n == 0 for n, _ in got.values())
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_few_kinds_predict_as_pairs_of_blocks_do(spark, rows, monkeypatch):
    monkeypatch.setattr(few_kinds, "CELLS", 7)
    want = {(r[0], r[1]): r[2] for r in pair_blocks.predicted(rows.selectExpr("cell", "species_id AS kind", "n_obs AS v", "n_obs AS w"), 40, 3).collect()}
    got = {(r["cell"], r["species_id"]): r["n_obs_predicted"] for r in correlate.predict_all(rows).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_few_kinds_do_not_go_by_blocks(rows, monkeypatch):
    monkeypatch.setattr(pair_blocks, "predicted", None)
    assert correlate.predict_all(rows).count() == rows.count()


def test_the_complete_table_is_not_laid_out_by_a_product_of_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(facts, "BLOCK", 8)
    local = rows.filter("cell IN (1, 2)").unionByName(spark.createDataFrame([(50, None, 4), (None, 1, 4), (1, 777, 4)], rows.schema))
    out = facts.completed(local, rows)
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Cross" not in plan
    kinds = {r[0] for r in rows.select("species_id").distinct().collect()}
    seen = {(r[0], r[1]): r[2] for r in local.collect()}
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted((c, k, seen.get((c, k), 0)) for c in (1, 2, 50) for k in kinds)
