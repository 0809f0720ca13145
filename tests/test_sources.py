from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from terrane.plans import occurrences
from terrane.sources import readers, writers


def test_tsv_skips_long_lines_and_fills_short_ones(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('x\ty\tz\n1\t"q\t3\n1\t2\n1\t2\t3\t4\n\n')
    got = readers.read_tsv_skipping(spark, str(tmp_path / "a.tsv"), ["x", "y", "z"])
    assert [tuple(r) for r in got.collect()] == [("1", '"q', "3"), ("1", "2", None)]
    assert readers.read_tsv_skipping(spark, str(tmp_path / "a.tsv"), limit=1).count() == 1


def test_csv_text_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n1,5\nx,7\n")
    assert [tuple(r) for r in readers.read_csv_text(spark, str(tmp_path / "a.csv"), ["n"]).collect()] == [("5",), ("7",)]
    assert [r["id"] for r in readers.read_csv_typed(spark, str(tmp_path / "a.csv"), {"id": "int"}).collect()] == [1, None]


def test_missing_files_are_warned_about(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n")
    (tmp_path / "b.csv").write_text("id,n\n2,3\n")
    with pytest.warns(UserWarning):
        got = readers.read_many(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")])
    assert sorted(tuple(r) for r in got.collect()) == [("1", None), ("2", "3")]


def test_geojson_round_trip(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    features = [{"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]
    (tmp_path / "z.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = readers.read_geojson(spark, str(tmp_path / "z.geojson"), {"name": "string"})
    assert sorted((r["name"], len(r["rings"]), r["rings"][0][2]["x"]) for r in got.collect()) == [("a", 1, 1.0), ("b", 2, 1.0)]
    boxes = spark.createDataFrame([("c", 0.0, 0.0, 1.0, 2.0)], "cell string, min_lon double, min_lat double, max_lon double, max_lat double")
    writers.write_geojson(boxes, str(tmp_path / "out"), ["cell"])
    feature = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert feature["properties"] == {"cell": "c"} and feature["geometry"]["coordinates"][0][2] == [1.0, 2.0]


def test_tables_and_settings(spark, tmp_path):
    rows = spark.range(6).withColumn("k", F.col("id") % 2)
    writers.write_table(rows, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("k = 1").count() == 3
    writers.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 6
    writers.write_matrix(rows, str(tmp_path / "m"))
    assert readers.read_matrix(spark, str(tmp_path / "m")).count() == 6
    writers.write_settings({"é": 1}, str(tmp_path / "s.json"))
    assert readers.read_settings(str(tmp_path / "s.json")) == {"é": 1}


def test_country_pipeline(spark, tmp_path):
    header = "\t".join(readers.GBIF_COLUMNS)
    line = lambda **v: "\t".join(str(v.get(c, "")) for c in readers.GBIF_COLUMNS)
    rows = [
        line(species="Vulpes vulpes", occurrenceStatus="PRESENT", decimalLongitude=0.02, decimalLatitude=0.02, speciesKey=5, year=1999),
        line(species="Vulpes vulpes", occurrenceStatus="PRESENT", decimalLongitude=0.03, decimalLatitude=0.02, speciesKey=5, eventDate="2001-02-03"),
        line(species="Lutra lutra", occurrenceStatus="ABSENT", decimalLongitude=0.02, decimalLatitude=0.02, speciesKey=6, year=1999),
        line(species="Lutra lutra", occurrenceStatus="PRESENT", decimalLongitude="x", decimalLatitude=0.02, speciesKey=6, year=1999),
        line(species="Lutra lutra", occurrenceStatus="PRESENT", decimalLongitude=80, decimalLatitude=0.02, speciesKey=6, year=1999),
    ]
    (tmp_path / "o.tsv").write_text("\n".join([header, *rows]) + "\n")
    ring = [(0.0, 0.0), (0.3, 0.0), (0.3, 0.3), (0.0, 0.3)]
    zones = spark.createDataFrame([("XX", [ring])], "code string, rings array<array<struct<x:double,y:double>>>")
    facts, grid = occurrences.country_facts(spark, str(tmp_path / "o.tsv"), zones, "XX", 10, bounds=[1990, 2000, 2010])
    got = sorted((r["species_id"], r["period"], r["n_obs"], r["species"]) for r in facts.collect())
    assert got == [(5, "Période 1: 1991 à 2000", 1, "Vulpes vulpes"), (5, "Période 2: 2001 à 2010", 1, "Vulpes vulpes")]
    assert grid.count() == 16
    with pytest.raises(ValueError):
        occurrences.country_facts(spark, str(tmp_path / "o.tsv"), zones, "YY")
