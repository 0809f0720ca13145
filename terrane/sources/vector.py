"""Zones from shapefiles and GeoPackages, read from any path that Spark reads and parsed on the executors.

Both give a row a feature: its attributes as text and ``rings``, all rings of its polygons as arrays of (x, y).
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"
#: Fixed values of the formats: shape kinds of polygons (plain, with heights, with measures), geometry kinds.
POLYGONS, POLYGON, MULTIPOLYGON = (5, 15, 25), 3, 6

Ring = list[tuple[float, float]]


def shapes(data: bytes) -> Iterator[list[Ring]]:
    """The rings of each record of a .shp file; none for kinds other than polygons."""
    at = 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        (kind,) = struct.unpack_from("<i", data, at + 8)
        rings: list[Ring] = []
        if kind in POLYGONS:
            parts, points = struct.unpack_from("<2i", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            rings = [list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2], strict=True)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield rings
        at += 8 + 2 * words


def attributes(data: bytes) -> Iterator[dict[str, str]]:
    """The rows of a .dbf file as text, deleted ones included so that they stay beside their shapes."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    columns, at = [], 32
    while data[at] != 0x0D:
        columns.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    for k in range(count):
        place, row = head + k * size + 1, {}
        for name, width in columns:
            raw = data[place : place + width].rstrip(b" \0")
            try:
                row[name] = raw.decode().strip()
            except UnicodeDecodeError:
                row[name] = raw.decode("latin-1").strip()
            place += width
        yield row


def well_known_rings(data: bytes, at: int = 0) -> tuple[list[Ring], int]:
    """The rings of a well-known binary polygon or multipolygon, and where it ends."""
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    width = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    at += 5
    (count,) = struct.unpack_from(order + "I", data, at)
    at += 4
    rings: list[Ring] = []
    if kind % 1000 == MULTIPOLYGON:
        for _ in range(count):
            more, at = well_known_rings(data, at)
            rings += more
    elif kind % 1000 == POLYGON:
        for _ in range(count):
            (n,) = struct.unpack_from(order + "I", data, at)
            flat = struct.unpack_from(f"{order}{n * width}d", data, at + 4)
            rings.append(list(zip(flat[::width], flat[1::width], strict=True)))
            at += 4 + 8 * n * width
    return rings, at


def package_rows(data: bytes, layer: str | None = None) -> Iterator[tuple[dict[str, str], list[Ring]]]:
    """Attributes and rings of a GeoPackage's layer (its first one by default)."""
    with sqlite3.connect(":memory:") as db:
        db.deserialize(data)
        found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        for table, column in [f for f in found if layer in (None, f[0])][:1]:
            rows = db.execute('SELECT * FROM "{}"'.format(table.replace('"', '""')))
            names = [c[0] for c in rows.description]
            for row in rows:
                held = dict(zip(names, row, strict=True))
                blob = held.pop(column)
                skip = 8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] if blob else 0
                yield {k: str(v) for k, v in held.items() if v is not None}, well_known_rings(blob, skip)[0] if blob else []


def _table(rows: list[tuple[dict[str, str], list[Ring]]], names: list[str]) -> pd.DataFrame:
    out = {n: [a.get(n) for a, _ in rows] for n in names}
    return pd.DataFrame(out | {"rings": [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for _, rings in rows]})


def read_shapefile(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Features of the .shp file at ``path`` with attributes ``names`` of the .dbf beside it."""
    stem = path.removesuffix(".shp")
    part = lambda suffix, name: spark.read.format("binaryFile").load(stem + suffix).select(F.col("content").alias(name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shp, dbf in zip(b["shp"], b["dbf"], strict=True):
                yield _table(list(zip(attributes(dbf), shapes(shp), strict=True)), names)

    # One row each: the two files of one layer.
    return part(".shp", "shp").join(part(".dbf", "dbf")).mapInPandas(run, ", ".join(f"`{n}` string" for n in names) + f", rings {RINGS}")


def read_geopackage(spark: SparkSession, path: str, names: list[str], layer: str | None = None) -> DataFrame:
    """Features of a layer with attributes ``names``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield _table(list(package_rows(content, layer)), names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{n}` string" for n in names) + f", rings {RINGS}")
