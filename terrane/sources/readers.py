"""Readers of occurrence tables, name lists, zones and settings. All are lazy scans; none infers a schema."""

from __future__ import annotations

import json
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the two kinds of raw occurrence files (fixed names of the formats).
GBIF_COLUMNS = [
    "kingdom", "phylum", "class", "order", "family", "genus", "species", "verbatimScientificName", "taxonRank", "countryCode",
    "occurrenceStatus", "individualCount", "decimalLongitude", "decimalLatitude", "eventDate", "taxonKey", "speciesKey", "occurrenceID", "year",
]
INVENTORY_COLUMNS = [
    "codeMaille10Km", "codeInseeDepartement", "observateur", "dateObservation", "latitude", "longitude", "systemeCoordonnees", "cdNom", "cdRef",
    "rangTaxo", "nomVernaculaire", "nomScientifiqueRef", "genre", "famille", "ordre", "classe", "regne", "especeProtegee",
    "statutBiogeoEspeceTaxref", "habitatEspeceTaxref", "occSexe", "occStadeDeVie",
]


def _header(spark: SparkSession, path: str | list[str], separator: str) -> list[str]:
    first = spark.read.text(path if isinstance(path, str) else path[0]).first()
    return first[0].lstrip("﻿").split(separator) if first else []


def read_csv_text(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, separator: str = ",") -> DataFrame:
    """Every column as text; ``columns`` keeps some of them, and the scan parses only those."""
    names = [n.strip('"') for n in _header(spark, path, separator)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).csv(path, header=True, sep=separator, multiLine=False)
    return rows.select(*[F.col(f"`{c}`") for c in columns]) if columns else rows


def read_csv_typed(spark: SparkSession, path: str | list[str], kinds: dict[str, str]) -> DataFrame:
    """Columns of ``kinds`` cast to their types (what is no such value is null), others as text."""
    rows = read_csv_text(spark, path)
    return rows.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in rows.columns])


def read_tsv_skipping(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Tab-separated text: lines with too many fields are skipped, short ones are filled with nulls, quotes have no meaning."""
    names = _header(spark, path, "\t")
    lines = spark.read.text(path)
    parts = F.split("value", "\t", -1)
    rows = lines.filter((F.size(parts) <= len(names)) & (F.col("value") != F.lit("\t".join(names))) & (F.col("value") != ""))
    wanted = columns or names
    out = rows.select(*[F.nullif(F.get(parts, F.lit(names.index(c))), F.lit("")).alias(c) for c in wanted])
    return out.limit(limit) if limit else out


def read_tsv_unquoted(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Tab-separated text in which quotes are ordinary characters."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in _header(spark, path, "\t")])
    rows = spark.read.schema(schema).csv(path, header=True, sep="\t", quote="")
    return rows.select(*[F.col(f"`{c}`") for c in columns]) if columns else rows


def read_vernacular(spark: SparkSession, path: str | list[str], languages: tuple[str, ...] = ("fr", "en")) -> DataFrame:
    """taxon_id, name, language of a backbone's list of names, for the given languages."""
    rows = read_tsv_unquoted(spark, path, ["taxonID", "vernacularName", "language"])
    return rows.select(F.col("taxonID").try_cast("long").alias("taxon_id"), F.col("vernacularName").alias("name"), "language").filter(F.col("language").isin(*languages))


def read_many(spark: SparkSession, paths: list[str], read=read_csv_text) -> DataFrame | None:
    """The union, by name, of the files that exist; a missing one is warned about. Columns that a file lacks are null."""
    found = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found.append(read(spark, path))
        else:
            warnings.warn(f"no file at {path}", stacklevel=2)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def read_geojson(spark: SparkSession, path: str | list[str], properties: dict[str, str]) -> DataFrame:
    """A row a feature: its properties and ``rings``, all rings of its polygons as arrays of (x, y).

    Polygon and MultiPolygon features are read; other kinds have no rings. A ring's holes follow its outline and turn
    the other way, so areas add up with their sign.
    """
    fields = ", ".join(f"`{k}`: {v}" for k, v in properties.items())
    kind = f"struct<features: array<struct<properties: struct<{fields}>, geometry: struct<type: string, coordinates: string>>>>"
    features = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", F.lit(kind)).getField("features")).alias("f"))
    shape = F.col("f.geometry")
    one = F.from_json(shape.coordinates, F.lit("array<array<array<double>>>"))
    many = F.flatten(F.from_json(shape.coordinates, F.lit("array<array<array<array<double>>>>")))
    rings = F.when(shape.type == "Polygon", one).when(shape.type == "MultiPolygon", many)
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return features.select(*[F.col(f"f.properties.`{k}`").alias(k) for k in properties], points.alias("rings"))


def read_settings(path: str) -> dict:
    """A JSON file of settings, on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A stored matrix in long form (parquet): correlation (species_i, species_j, r), linkage or prediction rows."""
    return spark.read.parquet(path)
