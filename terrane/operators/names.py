"""Vernacular names: how often each is used, and the commonest by taxon and language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import title_case


def name_counts(rows: DataFrame, taxon: str = "taxon_id", name: str = "name", language: str = "language") -> DataFrame:
    """taxon, language, lower-cased name, n."""
    return rows.dropna(subset=[taxon, name, language]).groupBy(taxon, language, F.lower(name).alias(name)).agg(F.count("*").alias("n"))


def common_names(rows: DataFrame, taxon: str = "taxon_id", name: str = "name", language: str = "language") -> DataFrame:
    """The commonest name of each taxon and language in title case; of equally common ones the first in order."""
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(name).alias("name"))).getField("name")
    return name_counts(rows, taxon, name, language).groupBy(taxon, language).agg(best.alias(name)).withColumn(name, title_case(name))


def name_dictionary(rows: DataFrame, languages: tuple[str, ...] = ("fr", "en"), taxon: str = "taxon_id", name: str = "name", language: str = "language") -> DataFrame:
    """A row a taxon with a column ``name_<language>`` for each language."""
    found = common_names(rows.filter(F.col(language).isin(*languages)), taxon, name, language)
    return found.groupBy(taxon).agg(*[F.max(F.when(F.col(language) == k, F.col(name))).alias(f"name_{k}") for k in languages])


def with_names(rows: DataFrame, names: DataFrame, species: str = "species_id", taxon: str = "taxon_id") -> DataFrame:
    return rows.join(names.withColumnRenamed(taxon, species), species, "left")
