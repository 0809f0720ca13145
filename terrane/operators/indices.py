"""Diversity of cells: richness, effort, Shannon (log10), Simpson, weighted endemism."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import truth


def _summed(rows: DataFrame, value: str, cell: str, species: str) -> DataFrame:
    """Per cell and species: v, n_obs, whether present, presences, rows. One shuffle, partial sums before it."""
    present = F.when(truth(F.col("n_obs") > 0), 1).otherwise(0)
    known = rows.filter(F.col(cell).isNotNull() & F.col(species).isNotNull())
    return known.groupBy(cell, species).agg(F.coalesce(F.sum(value), F.lit(0)).alias("v"), F.coalesce(F.sum("n_obs"), F.lit(0)).alias("n"), F.max(present).alias("present"), F.sum(present).alias("presences"), F.count("*").alias("rows"))


def shannon():
    """log10 S - sum(v log10 v) / S, and 0 for a cell without observations."""
    s = F.sum("v")
    return F.when(s > 0, F.log10(s) - F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("v") * F.log10("v"))), F.lit(0.0)) / s).otherwise(F.lit(0.0))


def simpson():
    """1 - sum(v squared) / S squared, and 1 for a cell without observations."""
    s, v = F.sum("v"), F.col("v").cast("double")
    return F.when(s > 0, 1 - F.sum(v * v) / (s.cast("double") * s)).otherwise(F.lit(1.0))


def richness(rows: DataFrame, cell: str = "cell", species: str = "species_id") -> DataFrame:
    """Species with an observation, by cell."""
    return _summed(rows, "n_obs", cell, species).groupBy(cell).agg(F.sum("present").alias("n_species"))


def effort(rows: DataFrame, cell: str = "cell", value: str = "n_obs") -> DataFrame:
    return rows.filter(F.col(cell).isNotNull()).groupBy(cell).agg(F.coalesce(F.sum(value), F.lit(0)).alias("n_observations"))


def shannon_index(rows: DataFrame, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    return _summed(rows, value, cell, species).groupBy(cell).agg(shannon().alias("shannon"))


def simpson_index(rows: DataFrame, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    return _summed(rows, value, cell, species).groupBy(cell).agg(simpson().alias("simpson"))


def endemism(rows: DataFrame, cell: str = "cell", species: str = "species_id") -> DataFrame:
    """Sum over a cell's rows of 1 / (presences of the row's species anywhere)."""
    return _indices(rows, "n_obs", cell, species).select(cell, "endemism")


def _indices(rows: DataFrame, value: str, cell: str, species: str) -> DataFrame:
    summed = _summed(rows, value, cell, species)
    # Joined rather than windowed: a species found nearly everywhere is not gathered in one task.
    area = summed.groupBy(species).agg(F.sum("presences").alias("area"))
    spread = summed.join(area, species).withColumn("weight", F.try_divide(F.col("rows").cast("double"), "area"))
    return spread.groupBy(cell).agg(F.sum("present").alias("n_species"), F.sum("n").alias("n_observations"), shannon().alias("shannon"), simpson().alias("simpson"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("endemism"))


def diversity_indices(rows: DataFrame, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    """All five indices by cell, in one pass: a sum by cell and species, the species' areas joined to it, a sum by cell."""
    return _indices(rows, value, cell, species)
