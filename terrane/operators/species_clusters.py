"""Clusters of species by the rows of their correlation matrix, and which of a cluster's species a place lacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.filters import in_cells
from terrane.operators.linkage import cut_at, cut_into, linkage

#: Species that a tree takes on the driver.
MOST_SPECIES = 5000


def dendrogram(matrix: DataFrame, method: str = "ward") -> tuple[list, np.ndarray]:
    """Species in ascending order and the tree of their matrix rows as points; null coefficients count as 0."""
    n = matrix.select("species_i").distinct().limit(MOST_SPECIES + 1).count()
    if n > MOST_SPECIES:
        raise ValueError(f"a tree takes at most {MOST_SPECIES} species; filter by observations first")
    rows = matrix.select("species_i", "species_j", F.coalesce("r", F.lit(0.0)).alias("r")).toPandas()
    table = rows.pivot(index="species_i", columns="species_j", values="r").fillna(0.0).sort_index()
    return table.index.tolist(), linkage(table.to_numpy(), method)


def tree_rows(matrix: DataFrame, method: str = "ward") -> DataFrame:
    """step, left, right, height, size: the tree as a table."""
    _, tree = dendrogram(matrix, method)
    return matrix.sparkSession.createDataFrame([(k, int(a), int(b), float(h), int(s)) for k, (a, b, h, s) in enumerate(tree)], "step int, left int, right int, height double, size int")


def cluster_species(matrix: DataFrame, level: float = 4, criterion: str = "distance", method: str = "ward", dimension: DataFrame | None = None, species: str = "species_id") -> DataFrame:
    """species, cluster_corr: the tree cut at a height (distance) or into a number of clusters (maxclust)."""
    if criterion not in ("distance", "maxclust"):
        raise ValueError("criterion must be distance or maxclust")
    names, tree = dendrogram(matrix, method)
    labels = cut_at(tree, level) if criterion == "distance" else cut_into(tree, int(level))
    out = matrix.sparkSession.createDataFrame(pd.DataFrame({species: names, "cluster_corr": labels.astype(np.int32)}))
    return out.join(dimension, species, "left") if dimension is not None else out


def cluster_of(clusters: DataFrame, subject, column: str = "species_id") -> DataFrame:
    """One row: the subject's cluster."""
    return clusters.filter(F.col(column) == subject).select("cluster_corr").limit(1)


def species_in_cluster(rows: DataFrame, clusters: DataFrame, number, dimension: DataFrame | None = None, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """Values summed by species of one cluster (its number compared as text), in descending order."""
    chosen = clusters.filter(F.trim(F.col("cluster_corr").cast("string")) == str(number).strip()).select(species)
    out = rows.join(chosen, species, "left_semi").groupBy(species).agg(F.sum(value).alias(value))
    return (out.join(dimension, species) if dimension is not None else out).orderBy(F.desc(value), species)


def names_of_clusters(rows: DataFrame, clusters: DataFrame, names: list[str], value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """By cluster, for each column of names: the distinct names of its species, by descending value over the whole table
    (ties by species). A species has its least name."""
    sums = rows.join(clusters.select(species, "cluster_corr"), species).groupBy("cluster_corr", species).agg(F.sum(value).alias("total"), *[F.min(F.col(f"`{n}`")).alias(n) for n in names])
    listed = lambda n: F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct((-F.col("total")).alias("k"), F.col(species), F.col(n).alias("w")))))
    return sums.groupBy("cluster_corr").agg(*[F.array_join(F.array_distinct(F.transform(listed(n), lambda s: s.w)), ", ").alias(n) for n in names])


def clusters_of_cell(rows: DataFrame, clusters: DataFrame, value: str = "n_obs", names: list[str] | None = None, cell: str = "cell", species: str = "species_id") -> DataFrame:
    """By cell and cluster: the sums of all measures (``n_obs``, ``n_obs_per_species`` and ``value`` divided once by the
    cluster's number of species) and the names of the cluster's species, the same in every cell."""
    labels = clusters.select(species, "cluster_corr")
    measures = list(dict.fromkeys([value, *[c for c in rows.columns if c.startswith("n_obs")]]))
    sizes = labels.groupBy("cluster_corr").agg(F.count_distinct(species).alias("n_species"))
    out = rows.join(labels, species).groupBy(cell, "cluster_corr").agg(*[F.sum(c).alias(c) for c in measures]).join(sizes, "cluster_corr")
    out = out.withColumns({c: F.try_divide(F.col(c).cast("double"), "n_species") for c in measures if c in ("n_obs", "n_obs_per_species", value)})
    if names:
        out = out.join(names_of_clusters(rows, clusters, names, value, species), "cluster_corr")
    return out.orderBy(cell, F.desc(value), "cluster_corr")


def cluster_names(rows: DataFrame, clusters: DataFrame, cells: DataFrame | list, name: str, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    """By cluster, over some cells: the distinct names in order, and the value's sum."""
    joined = in_cells(rows, cells, cell).join(clusters.select(species, "cluster_corr"), species)
    return joined.groupBy("cluster_corr").agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("names"), F.sum(value).alias(value))


def local_cluster(rows: DataFrame, clusters: DataFrame, number, cells: DataFrame | list, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    """The cluster's species with their sum everywhere and in some cells, 0 where it is not found there."""
    whole = species_in_cluster(rows, clusters, number, None, value, species).withColumnRenamed(value, f"{value}_total")
    local = species_in_cluster(in_cells(rows, cells, cell), clusters, number, None, value, species)
    return whole.join(local, species, "left").fillna(0, [value]).orderBy(F.desc(value), F.desc(f"{value}_total"), species)


def absent_species(rows: DataFrame, clusters: DataFrame, cells: DataFrame | list, most: int = 20, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    """For the clusters with the largest local sums: their species that the cells lack, by their sum everywhere."""
    labels = clusters.select(species, "cluster_corr")
    here = in_cells(rows, cells, cell).groupBy(species).agg(F.sum(value).alias("here"))
    ranked = here.join(labels, species).groupBy("cluster_corr").agg(F.sum("here").alias("cluster_here")).orderBy(F.desc("cluster_here"), "cluster_corr").limit(most)
    everywhere = rows.groupBy(species).agg(F.sum(value).alias(f"{value}_total"))
    out = labels.join(F.broadcast(ranked), "cluster_corr").join(everywhere, species).join(here, species, "left").filter(F.coalesce("here", F.lit(0)) == 0)
    return out.select("cluster_corr", "cluster_here", species, f"{value}_total").orderBy(F.desc("cluster_here"), "cluster_corr", F.desc(f"{value}_total"), species)


def zones_of_cluster(by_cell: DataFrame, clusters: DataFrame, subject, value: str = "n_obs", column: str = "species_id", cell: str = "cell") -> DataFrame:
    """Cells of clusters_of_cell that hold the subject's cluster, by descending value."""
    own = F.broadcast(cluster_of(clusters, subject, column))
    return by_cell.join(own, "cluster_corr", "left_semi").orderBy(F.desc(value), cell)


def best_of_each(rows: DataFrame, value: str, n: int = 5, cluster: str = "cluster_corr", tie: str = "species_id") -> DataFrame:
    order = Window.partitionBy(cluster).orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
