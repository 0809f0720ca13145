"""Small tables that show what summaries count, how names are listed, what fits see, and how plans are shaped."""

from __future__ import annotations

import math
import re

import pytest

from terrane.operators import correlate, explore, normalise, species_clusters


def test_summaries_count_present_species(spark):
    rows = spark.createDataFrame([(c, s, n) for c in (1, 2) for s, n in (("a", 4), ("b", 0))], "cell int, species_id string, n_obs long")
    assert explore.grid_summary(rows).first().species_mean == 1
    labels = spark.createDataFrame([(1, 7), (2, 7)], "cell int, cluster int")
    assert explore.cluster_summary(rows, labels).first().species_mean == 1


def test_names_follow_sums_over_the_whole_table(spark):
    rows = spark.createDataFrame([(1, 1, 9, "A", "x"), (1, 2, 1, "B", None), (2, 2, 50, "B", "y")], "cell int, species_id int, n_obs long, species string, vernacular string")
    clusters = spark.createDataFrame([(1, 5), (2, 5)], "species_id int, cluster_corr int")
    got = species_clusters.clusters_of_cell(rows.withColumn("n_obs_log", rows.n_obs * 1.0), clusters, names=["species", "vernacular"]).collect()
    assert [(r.cell, r.n_obs, r.n_obs_log, r.n_species, r.species, r.vernacular) for r in got] == [(1, 5.0, 10.0, 2, "B, A", "y, x"), (2, 25.0, 50.0, 2, "B, A", "y, x")]


def test_fits_see_the_cells_of_the_subject_only(spark):
    rows = spark.createDataFrame([(1, "s", 3), (2, "other", 5), (3, "s", 0)], "cell int, species_id string, n_obs long")
    predictions = spark.createDataFrame([(1, 2.0), (2, 8.0), (3, 9.0)], "cell int, p double")
    assert [tuple(r) for r in correlate.fit_points(rows, predictions, "s", "p").collect()] == [(1, 3.0, 1.0)]


def test_all_in_one_equals_the_single_steps(spark):
    kind = "cell int, species_id int, n_obs long, kingdom string, class string"
    data = [(1, 1, 4, "k", "c"), (1, 2, 0, "k", "d"), (2, 1, 3, "l", None), (2, 3, 9, None, "c"), (3, None, 2, "k", "c"), (None, 2, 5, "k", "d")]
    rows = spark.createDataFrame(data, kind)
    steps = normalise.per_species(normalise.presence(rows))
    for clade in ("kingdom", "class"):
        steps = normalise.per_cell_and_clade(steps, clade)
    steps = normalise.logarithm(normalise.logarithm(steps), "n_obs_per_cell_and_kingdom")
    got, want = normalise.all_in_one(rows), steps
    assert got.columns == want.columns
    plain = lambda frame: sorted(str([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r]) for r in frame.collect())
    assert plain(got) == plain(want)


def test_all_in_one_plans_the_rows_once_a_total(spark, tmp_path):
    spark.createDataFrame([(1, 1, 4, "k", "c", "s")], "cell int, species_id int, n_obs long, kingdom string, class string, species string").write.parquet(str(tmp_path / "t"))
    plan = normalise.all_in_one(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) <= 10


@pytest.mark.parametrize("value", [1, 8])
def test_logarithms_start_at_the_smallest_share(spark, value):
    rows = spark.createDataFrame([(1, 1, value, "k"), (1, 2, 3 * value, "k")], "cell int, species_id int, n_obs long, kingdom string")
    got = sorted(r.n_obs_per_cell_and_kingdom_log for r in normalise.all_in_one(rows).collect())
    assert got[0] == 0 and math.isclose(got[1], math.log10(3))


def test_a_legend_is_never_cut_silently(spark, monkeypatch):
    from terrane.operators import layers

    monkeypatch.setattr(layers, "MOST_LABELS", 3)
    grid = spark.createDataFrame([(i, 0.0) for i in range(5)], "cell int, min_lon double")
    labels = lambda n: spark.createDataFrame([(i, i % n) for i in range(5)], "cell int, cluster int")
    assert layers.discrete_layer(labels(3), grid)[1] == {"min": 0, "max": 2, "labels": [0, 1, 2]}
    with pytest.raises(ValueError, match="at most 3"):
        layers.discrete_layer(labels(4), grid)
