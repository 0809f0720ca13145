"""Rows of one mean and value are scored once, and have the votes that a row by itself has."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import outliers


def test_points_are_scored_once(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 97).alias("cell"), F.when(F.col("id") % 50 > 0, F.col("id") % 40).alias("species_id"), F.when(F.col("id") % 331 == 0, F.lit(None)).when(F.col("id") % 211 == 0, 60).otherwise(F.col("id") % 5 + 1).alias("n_obs"))
    options = {"rounds": 4, "trees": 10, "contamination": 0.02}
    once = outliers.forest_vote(rows, **options)
    assert "MapInArrow" not in once._jdf.queryExecution().toString()  # no row is scored, only points were
    monkeypatch.setattr(outliers, "MOST_POINTS", -1)
    each = outliers.forest_vote(rows, **options)
    assert "MapInArrow" in each._jdf.queryExecution().toString()
    assert sorted(once.collect(), key=str) == sorted(each.collect(), key=str)
    assert 0 < once.filter("outlier").count() < 200 and once.count() == 3000
