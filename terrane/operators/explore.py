"""Looking at a fact table: top species, search, clades, protected species, cells, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.columns import ratio
from terrane.operators.filters import in_cells, matches_text

#: The ranks from the widest to the narrowest, in both vocabularies (fixed names).
RANKS = [["all", "regne", "classe", "ordre", "famille", "genre", "nomScientifique", "nomVernaculaire"], ["all", "kingdom", "class", "order", "family", "genus", "species"]]


def top_species(rows: DataFrame, dimension: DataFrame | None = None, value: str = "n_obs", species: str = "species_id", limit: int | None = None) -> DataFrame:
    """Values summed by species, with taxonomy, in descending order; ties by id."""
    out = rows.filter(F.col(species).isNotNull()).groupBy(species).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))
    out = out.join(dimension, species) if dimension is not None else out
    out = out.orderBy(F.desc(value), species)
    return out.limit(limit) if limit else out


def search_species(rows: DataFrame, word: str, dimension: DataFrame | None = None, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """top_species of the rows in which any text column holds the word."""
    return top_species(rows.filter(matches_text(rows, word)), dimension, value, species)


def next_rank(rank: str) -> str:
    """The rank below. ValueError for the narrowest; a rank of no vocabulary leads to kingdoms."""
    for ranks in RANKS[::-1]:
        if rank in ranks:
            at = ranks.index(rank)
            if at + 1 == len(ranks):
                raise ValueError(f"no rank below {rank}")
            return ranks[at + 1]
    return "kingdom"


def explore_clade(rows: DataFrame, rank: str, taxon: str, species: str = "species_id", value: str = "n_obs") -> DataFrame:
    """The taxon's children one rank below: species, observations and their ratio (one decimal, half to even)."""
    below = next_rank(rank)
    chosen = rows.filter(F.col(f"`{rank}`") == taxon) if any(rank in r for r in RANKS) else rows
    out = chosen.filter(F.col(f"`{below}`").isNotNull()).groupBy(F.col(f"`{below}`")).agg(F.count_distinct(species).alias("n_species"), F.coalesce(F.sum(value), F.lit(0)).alias("n_obs"))
    return out.withColumn("obs_per_species", F.bround(ratio("n_obs", "n_species"), 1)).orderBy(F.desc("n_species"), below)


def protected_species(rows: DataFrame, cells: DataFrame | list, dimension: DataFrame | None = None, value: str = "n_obs", cell: str = "cell", species: str = "species_id", flag: str = "especeProtegee") -> DataFrame:
    """top_species of the cells' rows whose flag is the text ``True``."""
    return top_species(in_cells(rows, cells, cell).filter(F.col(flag) == "True"), dimension, value, species)


def cell_profile(rows: DataFrame, cells: DataFrame | list, dimension: DataFrame | None = None, value: str = "n_obs", cell: str = "cell", species: str = "species_id", limit: int | None = None) -> DataFrame:
    """top_species of some cells."""
    return top_species(in_cells(rows, cells, cell), dimension, value, species, limit)


def _spread(column: str) -> list[Column]:
    whole = lambda c: c.cast("long")
    return [whole(F.avg(column)).alias(f"{column}_mean"), *[whole(F.percentile(column, F.lit(p))).alias(f"{column}_{n}") for n, p in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))]]


def _present(value: str) -> Column:
    """Rows with a value above 0: species that a cell merely lists, as after completing it, do not count."""
    return F.count(F.when(F.col(value) > 0, 1))


def grid_summary(rows: DataFrame, value: str = "n_obs", cell: str = "cell") -> DataFrame:
    """One row: mean, median, 10th and 90th percentile of the cells' observations and present species, cut to whole numbers."""
    cells = rows.filter(F.col(cell).isNotNull()).groupBy(cell).agg(F.sum(value).alias("observations"), _present(value).alias("species"))
    return cells.agg(*_spread("observations"), *_spread("species"))


def cluster_summary(rows: DataFrame, labels: DataFrame, value: str = "n_obs", cell: str = "cell", cluster: str = "cluster") -> DataFrame:
    """grid_summary by cluster."""
    cells = rows.join(labels.select(cell, cluster), cell).groupBy(cell, cluster).agg(F.sum(value).alias("observations"), _present(value).alias("species"))
    return cells.groupBy(cluster).agg(*_spread("observations"), *_spread("species"))


def site_means(measures: DataFrame, site: str, columns: list[str]) -> DataFrame:
    return measures.filter(F.col(site).isNotNull()).groupBy(site).agg(*[F.avg(c).alias(c) for c in columns])


def category_counts(rows: DataFrame, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """One row: species and observations of a selection."""
    return rows.agg(F.count_distinct(species).alias("n_species"), F.coalesce(F.sum(value), F.lit(0)).alias("n_observations"))


def sums_by(rows: DataFrame, cells: DataFrame | list, by: str, columns: list[str], cell: str = "cell") -> DataFrame:
    """The columns' sums by group, over some cells."""
    return in_cells(rows, cells, cell).filter(F.col(by).isNotNull()).groupBy(by).agg(*[F.sum(c).alias(c) for c in columns])


def top_of_each(rows: DataFrame, group: str, value: str, n: int, ties: list[str]) -> DataFrame:
    """The n largest rows of each group; limits are pushed below the shuffle by the optimiser."""
    order = Window.partitionBy(group).orderBy(F.desc(value), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def rank_of(rows: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """Each row's place, from 0, in descending order of a small summary table (such as one row a cluster)."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(value), *ties)) - 1)
