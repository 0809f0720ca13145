"""Shapefiles and GeoPackages written by hand, read back."""

from __future__ import annotations

import sqlite3
import struct

from terrane.sources import vector

SQUARE = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
HOLE = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]


def shp(records):
    body = b""
    for k, rings in enumerate(records):
        points = [p for r in rings for p in r]
        starts, n = [], 0
        for r in rings:
            starts.append(n)
            n += len(r)
        content = struct.pack("<i", 5) + struct.pack("<4d", 0, 0, 2, 2) + struct.pack("<2i", len(rings), n) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points) if rings else struct.pack("<i", 0)
        body += struct.pack(">2i", k + 1, len(content) // 2) + content
    return bytes(100) + body


def dbf(rows):
    head = struct.pack("<4BIHH", 3, 24, 1, 1, len(rows), 32 + 32 + 1, 11) + bytes(20)
    return head + b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([10]) + bytes(15) + b"\r" + b"".join(b" " + r.encode().ljust(10) for r in rows)


def test_shapefile(spark, tmp_path):
    (tmp_path / "z.shp").write_bytes(shp([[SQUARE, HOLE], [], [SQUARE]]))
    (tmp_path / "z.dbf").write_bytes(dbf(["one", "é", "three"]))
    got = vector.read_shapefile(spark, str(tmp_path / "z.shp"), ["NAME"]).collect()
    assert [(r["NAME"], [[tuple(p) for p in ring] for ring in r["rings"]]) for r in got] == [("one", [SQUARE, HOLE]), ("é", []), ("three", [SQUARE])]


def test_geopackage(spark, tmp_path):
    ring = lambda r, order: struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "2d", *p) for p in r)
    polygon = lambda rings, order: bytes([order == "<"]) + struct.pack(order + "2I", 3, len(rings)) + b"".join(ring(r, order) for r in rings)
    many = b"\x01" + struct.pack("<2I", 6, 2) + polygon([SQUARE], "<") + polygon([SQUARE, HOLE], ">")
    blob = b"GP\x00\x03" + struct.pack("<i", 4326) + bytes(32) + many
    db = sqlite3.connect(tmp_path / "z.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('zones', 'geom')")
    db.execute("CREATE TABLE zones (fid INTEGER, geom BLOB, name TEXT)")
    db.executemany("INSERT INTO zones VALUES (?, ?, ?)", [(1, blob, "a"), (2, None, None)])
    db.commit()
    db.close()
    got = vector.read_geopackage(spark, str(tmp_path / "z.gpkg"), ["fid", "name"]).collect()
    assert [(r["fid"], r["name"], len(r["rings"])) for r in got] == [("1", "a", 3), ("2", None, 0)]
    assert [tuple(p) for p in got[0]["rings"][2]] == HOLE
