"""From raw occurrence files to the fact table, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.operators.cleaning import clean_inventory, coerce_occurrences, present_only, within_box
from terrane.operators.facts import count_cells
from terrane.operators.grid import merged_grids, to_cells, zone_bounds, zone_grid
from terrane.operators.names import with_names
from terrane.sources.readers import GBIF_COLUMNS, read_tsv_unquoted


def counted_in_grid(raw: DataFrame, grid: DataFrame, first_year: int | None = None, bounds: list[int] | None = None, names: DataFrame | None = None) -> DataFrame:
    """Raw rows of points: coerced, present ones only, placed in cells, counted by cell, species and period, named."""
    placed = to_cells(present_only(coerce_occurrences(raw)), grid)
    facts = count_cells(placed.withColumnRenamed("speciesKey", "species_id"), first_year=first_year, bounds=bounds, whole_taxonomy=True)
    return with_names(facts, names) if names is not None else facts


def country_facts(spark: SparkSession, path: str | list[str], zones: DataFrame, code: str, km: int = 10, sea: DataFrame | None = None, first_year: int | None = None, bounds: list[int] | None = None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fact table, grid) of a country: its land grid, with that of its sea zones, and its tab-separated occurrences."""
    grid = zone_grid(zones, km, codes=[code], country=code)
    if sea is not None:
        grid = merged_grids(grid, zone_grid(sea, km, codes=[code], country=code))
    return counted_in_grid(read_tsv_unquoted(spark, path, GBIF_COLUMNS), grid, first_year, bounds, names), grid


def zone_rows(raw: DataFrame, zones: DataFrame) -> DataFrame:
    """Coerced rows inside the box around the zones: the box is four numbers, and its filter is pushed to the scan."""
    box = zone_bounds(zones).first()
    return within_box(coerce_occurrences(raw), box["min_lon"], box["max_lon"], box["min_lat"], box["max_lat"])


def zone_facts(raw: DataFrame, zones: DataFrame, codes: list[str], km: int = 1, code_col: str = "code", first_year: int | None = None, bounds: list[int] | None = None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fact table, grid) of sub-national zones; years and bounds are those given."""
    grid = zone_grid(zones, km, codes=codes, code_col=code_col, scale=10000, digits=5)
    return counted_in_grid(zone_rows(raw, zones), grid, first_year, bounds, names), grid


def inventory_facts(raw: DataFrame, group: str, cell: str = "codeMaille10Km", first_year: int | None = None, bounds: list[int] | None = None) -> DataFrame:
    """The fact table of an inventory group."""
    return count_cells(clean_inventory(raw, group), cell, "cdRef", first_year=first_year, bounds=bounds)
