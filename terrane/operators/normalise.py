"""Normalised measures. Each adds one column; rows whose key is null get null, as they belong to no group.

A group's sum is aggregated, in parts before the shuffle, and joined back: a key that holds a third of all rows is never
gathered in one task, as it would be by a window, and few groups are broadcast by the adaptive plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import ratio, truth


def _totals(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.dropna(subset=keys).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.coalesce(F.sum(value), F.lit(0)).alias("group_total"))


def by_key(rows: DataFrame, keys: list[str], name: str, value: str = "n_obs", scale: float | None = None) -> DataFrame:
    """value / sum of its group, times ``scale`` or else the mean of all groups' sums, as ``name``."""
    totals = _totals(rows, keys, value)
    joined = rows.join(totals, keys, "left")
    share = ratio(value, "group_total")
    if scale is not None:
        return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (share * scale).alias(name))
    mean = F.broadcast(totals.agg(F.avg("group_total").alias("mean_total")))  # one row
    return joined.join(mean).select(*[F.col(f"`{c}`") for c in rows.columns], (share * F.col("mean_total")).alias(name))


def per_cell(rows: DataFrame, value: str = "n_obs", cell: str = "cell") -> DataFrame:
    return by_key(rows, [cell], f"{value}_per_cell", value)


def per_species(rows: DataFrame, value: str = "n_obs", species: str = "species_id", scale: float = 10000.0) -> DataFrame:
    return by_key(rows, [species], f"{value}_per_species", value, scale)


def per_clade(rows: DataFrame, clade: str = "kingdom", value: str = "n_obs") -> DataFrame:
    return by_key(rows, [clade], f"{value}_per_{clade}", value)


def per_cell_and_clade(rows: DataFrame, clade: str = "kingdom", value: str = "n_obs", cell: str = "cell") -> DataFrame:
    return by_key(rows, [cell, clade], f"{value}_per_cell_and_{clade}", value)


def per_period(rows: DataFrame, value: str = "n_obs", column: str = "period") -> DataFrame:
    return by_key(rows, [column], f"{value}_per_period", value)


def presence(rows: DataFrame, value: str = "n_obs") -> DataFrame:
    """1 where the value is above 0, else 0."""
    return rows.withColumn(f"{value}_unique", F.when(truth(F.col(value) > 0), 1).otherwise(0))


def logarithm(rows: DataFrame, value: str = "n_obs", least: float = 0.0) -> DataFrame:
    """log10 of the value's ratio to the smallest value above ``least``, where that ratio is above ``least``; else 0."""
    smallest = F.broadcast(rows.filter(F.col(value) > least).agg(F.min(value).alias("smallest")))  # one row
    r = ratio(value, "smallest")
    return rows.join(smallest).withColumn(f"{value}_log", F.when(truth(r > least), F.log10(r)).otherwise(F.lit(0.0))).drop("smallest")


def all_in_one(rows: DataFrame, value: str = "n_obs", cell: str = "cell", species: str = "species_id", clades: tuple[str, ...] = ("kingdom", "class", "species")) -> DataFrame:
    """Presence, share of the species, share of cell and clade for each clade, and the logarithms of the value and of its
    share of cell and first clade.

    All totals come from the rows themselves, each aggregated once, and all that is one number from one row; chaining the
    functions above would plan the rows anew for every use of them. A share's smallest value above 0 is that of its
    group's smallest value.
    """
    found = [c for c in clades if c in rows.columns]
    sets = [([species], f"{value}_per_species", 10000.0), *[([cell, c], f"{value}_per_cell_and_{c}", None) for c in found]]
    positive = F.min(F.when(truth(F.col(value) > 0), F.col(value)))
    out, ones, columns = presence(rows, value), rows.agg(positive.alias("_least")), []
    for k, (keys, name, scale) in enumerate(sets):
        totals = rows.dropna(subset=keys).groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.coalesce(F.sum(value), F.lit(0)).alias(f"_total{k}"), positive.alias("_first"))
        out = out.join(totals.drop("_first"), keys, "left")
        if scale is None:
            ones = ones.join(totals.agg(F.avg(f"_total{k}").alias(f"_mean{k}"), F.min(ratio("_first", f"_total{k}")).alias(f"_low{k}")))
        columns.append((ratio(value, f"_total{k}") * (F.col(f"_mean{k}") if scale is None else F.lit(scale))).alias(name))
    logs = [(value, F.col("_least"))] + [(sets[1][1], F.col("_low1") * F.col("_mean1"))] * bool(found)
    joined = out.join(F.broadcast(ones)).select("*", *columns)  # one row
    named = [F.when(truth(ratio(c, least) > 0), F.log10(ratio(c, least))).otherwise(F.lit(0.0)).alias(f"{c}_log") for c, least in logs]
    return joined.select(*[F.col(f"`{c}`") for c in [*rows.columns, f"{value}_unique", *[name for _, name, _ in sets]]], *named)
