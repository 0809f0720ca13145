"""Tasks that count line items take a bounded part of them, and common values are sorted in several ranges."""

from __future__ import annotations

from terrane.operators import filters
from terrane.plans import fixtures


def test_reading_records_bounds_tasks(spark, tmp_path):
    spark.sql("SELECT 1L AS l_suppkey, 2L AS l_partkey, DATE'1999-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in fixtures.facts(spark, str(tmp_path)).collect()] == [(1, 2, 1)]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == fixtures.READ
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == fixtures.COUNTED


def test_shown_orders_ties_by_the_other_columns(spark):
    rows = spark.createDataFrame([(k * 37 % 100, 1) for k in range(100)], "cell long, n_obs long")
    assert [r["cell"] for r in filters.shown(rows, ["cell", "n_obs"], "n_obs").collect()] == list(range(100))
