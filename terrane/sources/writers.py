"""Sinks: parquet and CSV tables, GeoJSON features, matrices in long form, settings. Folders are made by the writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files with headers, one a partition."""
    rows.write.mode(mode).csv(path, header=True)


def write_table(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, in folders by the values of ``by`` (numbered chunks, countries, periods)."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_matrix(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A matrix in long form: a row an entry, so no side's size bounds it."""
    rows.write.mode(mode).parquet(path)


def geojson_features(rows: DataFrame, properties: list[str], min_lon: str = "min_lon", min_lat: str = "min_lat", max_lon: str = "max_lon", max_lat: str = "max_lat") -> DataFrame:
    """``value``: a feature a row, the box as a polygon."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner(min_lon, min_lat), corner(max_lon, min_lat), corner(max_lon, max_lat), corner(min_lon, max_lat), corner(min_lon, min_lat))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return rows.select(F.to_json(feature).alias("value"))


def write_geojson(rows: DataFrame, path: str, properties: list[str], mode: str = "overwrite") -> None:
    """Newline-delimited features, one file a partition: readers of GeoJSON sequences take them as they are."""
    geojson_features(rows, properties).write.mode(mode).text(path)


def write_settings(settings: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, ensure_ascii=False, indent=2)
