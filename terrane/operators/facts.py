"""The fact table: observations counted by cell, species and period, and the taxonomy beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.columns import integer, period
from terrane.operators.fixed_values import TAXONOMY_COLUMNS
from terrane.operators.stored import stored


def taxonomy(rows: DataFrame, species: str = "species_id", columns: list[str] | None = None) -> DataFrame:
    """One row a species: its row with the most known columns, ties to the smallest values.

    The best row is a maximum of a struct, so each partition reduces its rows before the shuffle.
    """
    kept = [c for c in (columns or TAXONOMY_COLUMNS) if c in rows.columns and c != species]
    known = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in kept), F.lit(0))
    best = F.min(F.struct((-known).alias("unknown"), *[F.col(f"`{c}`") for c in kept]))
    found = rows.filter(F.col(species).isNotNull()).groupBy(species).agg(best.alias("best"))
    return found.select(species, *[F.col("best").getField(c).alias(c) for c in kept])


def count_cells(rows: DataFrame, cell: str = "cell", species: str = "species_id", year: str = "year", first_year: int | None = None, bounds: list[int] | None = None, whole_taxonomy: bool = False, with_taxonomy: bool = True) -> DataFrame:
    """Rows counted by cell and species, and period if bounds are given, with the species' taxonomy.

    Odd years count as 0; rows without cell, species or period vanish. The taxonomy comes from the rows of the years in
    question, or with ``whole_taxonomy`` from all.
    """
    typed = rows.withColumns({year: F.coalesce(integer(year), F.lit(0)).cast("int"), species: integer(species)}) if year in rows.columns else rows.withColumn(species, integer(species))
    recent = typed.filter(F.col(year) >= first_year) if first_year is not None else typed
    keys = [cell, species]
    counted = recent
    if bounds:
        counted, keys = counted.withColumn("period", period(year, bounds)), [*keys, "period"]
    counts = counted.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n_obs"))
    if not with_taxonomy:
        return counts
    return counts.join(taxonomy(typed if whole_taxonomy else recent, species), species)


def period_histogram(rows: DataFrame, bounds: list[int], year: str = "year") -> DataFrame:
    return rows.select(period(integer(year), bounds).alias("period")).filter("period IS NOT NULL").groupBy("period").agg(F.count("*").alias("n"))


def merge_counts(parts: list[DataFrame], keys: list[str], value: str = "n_obs") -> DataFrame:
    """Counts of several chunks as one: their union, summed by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropna(subset=keys).groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def without_period(facts: DataFrame, dimension: DataFrame | None = None, cell: str = "cell", species: str = "species_id", value: str = "n_obs") -> DataFrame:
    """The fact table summed over periods, with its taxonomy joined again."""
    out = merge_counts([facts.select(cell, species, value)], [cell, species], value)
    return out.join(dimension, species, "left") if dimension is not None else out


#: Species of a block of the complete table, on average.
BLOCK = 4096


def completed(local: DataFrame, whole: DataFrame, cell: str = "cell", species: str = "species_id", values: list[str] | None = None) -> DataFrame:
    """A row for every local cell and every species of the whole, values 0 where there is none.

    The product is the result itself and arises last: only the rows that are there are shuffled, to the blocks of species
    of their cells, and each block of a cell adds the species that it lacks.
    """
    values = values or [c for c in local.columns if c.startswith("n_obs")]
    kinds = stored(whole.select(species).distinct().dropna())
    blocks = max(1, -(-kinds.count() // BLOCK))
    block = F.pmod(F.xxhash64(F.lit("block"), species), F.lit(blocks)).cast("int").alias("_block")
    known = stored(local.select(cell, species, *values).dropna(subset=[cell]))
    there = known.join(kinds, species, "left_semi")
    cells = known.select(cell).distinct().select(cell, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    held = there.select(cell, species, block).groupBy(cell, "_block").agg(F.collect_set(species).alias("_there"))
    listed = kinds.select(species, block).groupBy("_block").agg(F.collect_list(species).alias("_all"))
    lacks = F.when(F.col("_there").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_there"))
    absent = cells.join(held, [cell, "_block"], "left").join(listed, "_block").select(cell, F.explode(lacks).alias(species), *[F.lit(0).cast(local.schema[v].dataType).alias(v) for v in values])
    return there.select(cell, species, *values).fillna(0, subset=values).unionByName(absent)


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("row = 1").drop("row")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def periods_of(facts: DataFrame, cell: str = "cell", species: str = "species_id") -> DataFrame:
    """The sorted periods of each cell and species."""
    return facts.dropna(subset=[cell, species]).groupBy(cell, species).agg(F.array_sort(F.collect_set("period")).alias("periods"))


def year_histogram(rows: DataFrame, low: int, high: int, bins: int, year: str = "year") -> DataFrame:
    """bin (from 1) and count of years in equal bins, the last closed to the right."""
    y = integer(year)
    place = F.least(F.width_bucket(y.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    return rows.select(F.when(y.between(low, high), place).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
