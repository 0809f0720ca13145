"""Selections of species, cells and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.columns import any_of, truth
from terrane.operators.fixed_values import CATEGORIES


def in_category(rows: DataFrame, name: str, categories: dict[str, dict[str, list]] = CATEGORIES) -> DataFrame:
    """Rows of which any listed column holds one of its values; ValueError for a name that is not defined."""
    if name not in categories:
        raise ValueError(f"no category {name}; there are {', '.join(sorted(categories))}")
    return rows.filter(any_of([F.col(c).isin(values) for c, values in categories[name].items()]))


def in_kingdoms(rows: DataFrame, chosen: dict[str, bool], column: str = "kingdom") -> DataFrame:
    """Rows of the kingdoms that are switched on."""
    return rows.filter(truth(F.col(column).isin([k for k, on in chosen.items() if on])))


def centred_in(grid: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """Grid cells whose centre lies in a box, its border included."""
    lat, lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    return grid.filter(lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max))


def in_area(rows: DataFrame, grid: DataFrame, lon_min: float = -11, lon_max: float = 25, lat_min: float = 32, lat_max: float = 55, cell: str = "cell") -> DataFrame:
    """Rows of cells that centred_in keeps; all in degrees."""
    return rows.join(centred_in(grid, lat_min, lat_max, lon_min, lon_max).select(cell), cell, "left_semi")


def in_cells(rows: DataFrame, cells: DataFrame | list, cell: str = "cell") -> DataFrame:
    """Rows of the given cells: a list that a person wrote, or a table."""
    return rows.join(cells.select(cell), cell, "left_semi") if isinstance(cells, DataFrame) else rows.filter(F.col(cell).isin(cells))


def matches_text(rows: DataFrame, word: str) -> Column:
    """Whether any text column holds the word, upper and lower case alike."""
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    return any_of([F.contains(F.lower(F.col(f"`{c}`")), F.lower(F.lit(word))) for c in texts])


def shown(rows: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """The columns, each once, and in descending order of ``by`` if given; ties by the other columns, so that a value which
    very many rows share is sorted in many ranges."""
    out = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)])
    return out.orderBy(F.desc_nulls_last(by), *[F.col(f"`{c}`") for c in out.columns if c != by]) if by else out


def well_observed(rows: DataFrame, least: float = 100, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """Rows of species whose values sum to more than ``least`` - 1; species are counted once and joined back, so a
    species with very many rows is summed in parts."""
    kept = rows.filter(F.col(species).isNotNull()).groupBy(species).agg(F.sum(value).alias("total")).filter(F.col("total") > least - 1)
    return rows.join(kept.select(species), species, "left_semi")


def well_observed_or(rows: DataFrame, subject, least: float = 100, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """The distinct rows of ``well_observed`` and those of a subject, however rare it is."""
    return well_observed(rows, least, value, species).unionByName(rows.filter(F.col(species) == subject)).distinct()


def retained_share(rows: DataFrame, least: float = 100, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """species_in, species_kept, percent of well_observed."""
    totals = rows.filter(F.col(species).isNotNull()).groupBy(species).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    out = totals.agg(F.count("*").alias("species_in"), F.count_if(F.col("total") > least - 1).alias("species_kept"))
    return out.withColumn("percent", F.try_divide(F.col("species_kept") * 100.0, F.col("species_in")))


def predicted_present(rows: DataFrame, value: str) -> DataFrame:
    """Rows with a value of 1 or more."""
    return rows.filter(F.col(value) >= 1)
