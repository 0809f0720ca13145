"""Quantiles by narrowing against the built-in percentile."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import outliers, quantiles

QS = [0.0, 0.25, 0.5, 0.98, 0.999, 1.0]


@pytest.mark.parametrize("held", [65_536, 5, 0])
def test_equal_the_percentile(spark, monkeypatch, held):
    monkeypatch.setattr(quantiles, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(1, float(v)) for v in rng.lognormal(0, 3, 3000)]  # a species with a third of all rows and more
    rows += [(2, float(v)) for v in rng.integers(-5, 6, 900)] + [(3, v) for v in (1e300, -1e308, 1e-300, 0.0, 5.0, 5.0, 1e308)]
    rows += [(4, 7.0)] * 50 + [(5, None), (6, math.nan), (6, 2.0), (None, 3.0)] + [(int(s), float(v)) for s, v in zip(rng.integers(10, 40, 500), rng.normal(size=500), strict=True)]
    frame = spark.createDataFrame(rows, "s int, v double").repartition(3)
    got = {r[0]: r[1:] for r in quantiles.exact_quantiles(frame, ["s"], "v", QS).collect()}
    plain = frame.filter("s IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)").groupBy("s").agg(*[F.percentile("v", F.lit(q)) for q in QS])
    want = {r[0]: r[1:] for r in plain.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-12, atol=0) for k in want)
    assert quantiles.exact_quantiles(frame.limit(0), ["s"], "v", QS).collect() == []


def test_winsorised_with_a_hot_species(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 3).cast("int").alias("species_id"), (F.col("id") * F.col("id") % 997).alias("n_obs"))
    want = sorted(tuple(r) for r in outliers.winsorised(rows).collect())
    monkeypatch.setattr(quantiles, "HELD", 20)
    assert sorted(tuple(r) for r in outliers.winsorised(rows).collect()) == want
