"""Occurrence-like views of the driver's tables.

A line item is an observation: its supplier is the cell, its part the species, its ship year the year; parts are the
taxonomy (type, brand, size, name as kingdom, class, order, species).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Year bounds of three periods, and of two.
THREE, TWO = [1994, 1996, 1998, 2001], [1994, 1998, 2001]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a task that reads and of one that counts: nearly every row is a group of its own, which takes some 300 bytes.
READ, COUNTED = "32m", "16m"


def _bounded_tasks(spark: SparkSession) -> None:
    """Tasks of a bounded number of rows, however many there are."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", READ)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", COUNTED)


def records(spark: SparkSession, sf_dir: str, *extra) -> DataFrame:
    """cell, species_id, year of every line item, and what else is asked for: no join."""
    _bounded_tasks(spark)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("species_id"), F.year("l_shipdate").alias("year"), *extra)


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("species_id"), F.col("p_type").alias("kingdom"), F.col("p_brand").alias("class"), F.col("p_size").alias("order"), F.col("p_name").alias("species"))


def observations(spark: SparkSession, sf_dir: str, *extra) -> DataFrame:
    """records with taxonomy; parts are broadcast by the plan where they are small."""
    return records(spark, sf_dir, *extra).join(dimension(spark, sf_dir), "species_id")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, species_id, n_obs."""
    return records(spark, sf_dir).groupBy("cell", "species_id").agg(F.count("*").alias("n_obs"))


def named_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts with taxonomy, joined after counting."""
    return facts(spark, sf_dir).join(dimension(spark, sf_dir), "species_id")


def facts_by_period(spark: SparkSession, sf_dir: str, bounds: list[int] = THREE) -> DataFrame:
    from terrane.operators.facts import count_cells

    return count_cells(records(spark, sf_dir), bounds=bounds, with_taxonomy=False)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, species_id, n_obs and the summed quantity as a second measure."""
    return records(spark, sf_dir, F.col("l_quantity").alias("quantity")).groupBy("cell", "species_id").agg(F.count("*").alias("n_obs"), F.sum("quantity").alias("n_obs_quantity"))


def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, cluster: suppliers by their nation's remainder of five."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_nationkey") % 5).cast("int").alias("cluster"))


def species_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("species_id"), (F.col("p_size") % 7).cast("int").alias("cluster_corr"))


def supplier_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of one degree for each supplier, fifty to a row."""
    x, y = (F.col("cell") % 50).cast("double"), F.floor(F.col("cell") / 50).cast("double")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell")).select("cell", x.alias("min_lon"), y.alias("min_lat"), (x + 1).alias("max_lon"), (y + 1).alias("max_lat"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order, line, lon, lat: quantities and taxes as places; a negative zero becomes zero."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("lon"), (F.round(F.col("l_tax") * 100, 4) + F.lit(0.0)).alias("lat"))


def vernacular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon_id, language, name: the first word of each document, by its source and language."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("taxon_id"), F.col("lang").alias("language"), F.split_part(F.col("text"), F.lit(" "), F.lit(1)).alias("name"))
