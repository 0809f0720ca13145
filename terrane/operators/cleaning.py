"""Raw occurrence rows to clean ones. Every step is a projection or a filter: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import clean_scientific_name, date_parts, first_part, integer, number, timestamp, truth


def clean_inventory(raw: DataFrame, group: str, species: str = "cdRef", name: str = "nomScientifiqueRef", cell: str = "codeMaille10Km", department: str = "codeInseeDepartement", date: str = "dateObservation") -> DataFrame:
    """Inventory rows with an id and a name of several words; first cell code, clean name, date parts, constant ``all``.

    Rows without a name go. The group ``reptiles`` gets its missing class.
    """
    rows = raw.filter(F.col(species).isNotNull() & truth(F.col(name).contains(" ")))
    rows = rows.withColumnsRenamed({name: "nomScientifique", department: "codeDepartement"})
    extra: dict[str, Column] = {"all": F.lit("All"), cell: first_part(cell, "|"), "nomScientifique": clean_scientific_name("nomScientifique")}
    if date in rows.columns:
        extra |= date_parts(date)
    if group == "reptiles" and "classe" in rows.columns:
        extra["classe"] = F.coalesce("classe", F.lit("Reptilia"))
    return rows.withColumns(extra)


def loss_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_in, rows_out, loss_percent, as one aggregation of each side."""
    a, b = before.agg(F.count("*").alias("rows_in")), after.agg(F.count("*").alias("rows_out"))
    return a.join(b).withColumn("loss_percent", F.try_divide((F.col("rows_in") - F.col("rows_out")) * 100.0, F.col("rows_in")))


def present_only(rows: DataFrame, status: str = "occurrenceStatus") -> DataFrame:
    return rows.filter(F.col(status) == "PRESENT")


def coerce_occurrences(rows: DataFrame, lon: str = "decimalLongitude", lat: str = "decimalLatitude", species: str = "speciesKey", year: str = "year", date: str | None = "eventDate", count: str | None = "individualCount") -> DataFrame:
    """Coordinates and id as numbers, rows that lack one dropped; year filled from the date; counts that are missing are 1."""
    changed = {lon: number(lon), lat: number(lat), species: integer(species)}
    known = integer(year)
    changed[year] = (F.coalesce(known, F.year(timestamp(date)).cast("long")) if date and date in rows.columns else known).cast("int")
    if count and count in rows.columns:
        changed[count] = F.coalesce(number(count), F.lit(1.0))
    return rows.withColumns(changed).dropna(subset=[lon, lat, species])


def within_box(rows: DataFrame, lon_min: float, lon_max: float, lat_min: float, lat_max: float, lon: str = "decimalLongitude", lat: str = "decimalLatitude") -> DataFrame:
    """Rows inside a box, its border included."""
    return rows.filter(F.col(lon).between(lon_min, lon_max) & F.col(lat).between(lat_min, lat_max))


def since(rows: DataFrame, first_year: int, year: str = "year") -> DataFrame:
    """Rows of a year or later; a missing or odd year counts as 0."""
    return rows.withColumn(year, F.coalesce(integer(year), F.lit(0)).cast("int")).filter(F.col(year) >= first_year)


def null_counts(rows: DataFrame) -> DataFrame:
    """One row: nulls of every column."""
    return rows.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in rows.columns])


def replace_value(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def append_copy(rows: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """The rows, and a changed copy of those where the condition holds."""
    return rows.unionByName(rows.filter(where).withColumns(changes))
