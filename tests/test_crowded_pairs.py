"""Boxes that very many share a place with, and places beyond the pole."""

from __future__ import annotations

from terrane.operators import spatial
from terrane.plans.queries_sources import QUERIES


def test_boxes_of_a_crowded_bucket_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spatial, "COMPARED", 50)
    rows = [(k, float(k % 3), 0.0, k % 3 + 1.5, 2.0) for k in range(30)]
    boxes = spark.createDataFrame(rows, "zone long, zx0 double, zy0 double, zx1 double, zy1 double")
    found = spatial.intersecting_pairs(boxes, 5.0)
    assert "part" in found._jdf.queryExecution().toString()
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] < b[3] and b[1] < a[3])
    assert sorted((r["a"], r["b"]) for r in found.collect()) == want


def test_nothing_comes_back_from_beyond_the_pole(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 23_999, 24_000, 24_049, 24_050, 59_999)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = {r["cell"]: r for r in QUERIES["to_conic"][0](spark, str(tmp_path)).collect()}
    assert len(rows) == 6 and all(r["d_lon"] == 0 and r["d_lat"] == 0 for r in rows.values())
    assert rows[0]["x"] == rows[0]["x"] and rows[59_999]["x"] != rows[59_999]["x"]
