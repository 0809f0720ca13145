"""Co-occurrence of species over cells, and predictions from it. Matrices stay long and sparse: a cell without a species
counts as 0 and is never written out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.columns import ratio
from terrane.operators import few_kinds, pair_blocks
from terrane.operators.normalise import per_species
from terrane.operators.quantiles import exact_quantiles
from terrane.operators.stored import stored

METHODS = ("pearson", "spearman", "kendall")


def cell_vectors(rows: DataFrame, value: str, clade: str, cell: str = "cell", how: str = "sum") -> DataFrame:
    """cell, kind, v: one value for each cell and clade, summed or averaged."""
    fold = F.sum(value) if how == "sum" else F.avg(value)
    return rows.dropna(subset=[cell, clade]).groupBy(F.col(cell).alias("cell"), F.col(clade).alias("kind")).agg(F.coalesce(fold, F.lit(0)).cast("double").alias("v"))


def _moments(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("kind").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


def _coefficient(n: Column, sxy: Column, sx: Column, sy: Column, qx: Column, qy: Column) -> Column:
    """Pearson's r from sums; null if a side is constant (up to rounding)."""
    vx, vy = n * qx - sx * sx, n * qy - sy * sy
    sound = (vx > 1e-9 * n * qx) & (vy > 1e-9 * n * qy)
    return F.when(sound, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * sxy - sx * sy) / F.sqrt(vx * vy))))


def ranked(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """The vectors' average ranks less the rank of a 0, for values that are not negative: zeros stay unwritten.

    With z zeros, a zero's rank is (z + 1) / 2, and a value's is z plus its average rank among the values above 0.
    """
    above = vectors.filter("v > 0")
    place = Window.partitionBy("kind")
    order = place.orderBy("v")
    ties = F.count("*").over(Window.partitionBy("kind", "v"))
    zeros = F.col("cells") - F.count("*").over(place)
    rank = F.rank().over(order) + (ties - 1) / 2
    return above.join(F.broadcast(cells)).select("cell", "kind", (zeros + rank - (zeros + 1) / 2).alias("v"))


def _cells(rows: DataFrame, cell: str) -> DataFrame:
    """One row: the number of cells."""
    return rows.select(F.col(cell).alias("cell")).dropna().agg(F.count_distinct("cell").cast("double").alias("cells"))


def subject_correlation(rows: DataFrame, subject, value: str = "n_obs", clade: str = "species_id", method: str = "pearson", cell: str = "cell", dimension: DataFrame | None = None) -> DataFrame:
    """kind, coefficient of every clade with one of them, over all cells; joined with taxonomy on the clade if given."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    vectors, cells = cell_vectors(rows, value, clade, cell), _cells(rows, cell)
    if method == "kendall":
        found = _subject_kendall(vectors, cells, subject)
    else:
        vectors = ranked(vectors, cells) if method == "spearman" else vectors
        own = vectors.filter(F.col("kind") == subject).select("cell", F.col("v").alias("y"))
        products = vectors.join(own, "cell").groupBy("kind").agg(F.sum(F.col("v") * F.col("y")).alias("sxy"))
        side = F.broadcast(own.agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("sy"), F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0)).alias("qy")).join(cells))
        # Clades that are nowhere above 0 have no ranked rows; they are constant, hence null.
        everyone = cell_vectors(rows, value, clade, cell).select("kind").distinct()
        sums = everyone.join(_moments(vectors), "kind", "left").join(products, "kind", "left").fillna(0.0, ["s", "q", "sxy"]).join(side)
        found = sums.select("kind", _coefficient(F.col("cells"), F.col("sxy"), F.col("s"), F.col("sy"), F.col("q"), F.col("qy")).alias("coefficient"))
    if dimension is not None:
        found = found.join(dimension, found.kind == dimension[clade])
    return found.orderBy(F.desc_nulls_last("coefficient"), "kind")


def _subject_kendall(vectors: DataFrame, cells: DataFrame, subject) -> DataFrame:
    """Tau-b of each clade with the subject: a clade's values and the subject's meet cell by cell, absent ones as zeros;
    pairs of cells are counted from value frequencies, so a clade's work is n log n in its cells."""
    own = vectors.filter(F.col("kind") == subject).select("cell", F.col("v").alias("y"))
    both = vectors.join(own, "cell", "left").select("kind", "v", F.coalesce("y", F.lit(0.0)).alias("y"))
    kinds = vectors.select("kind").distinct()
    rest = kinds.join(own.select("cell", "y")).join(vectors.select("kind", "cell"), ["kind", "cell"], "left_anti").select("kind", F.lit(0.0).alias("v"), "y")
    counted = both.unionAll(rest).groupBy("kind", "v", "y").agg(F.count("*").alias("n")).join(F.broadcast(cells))
    kind = vectors.schema["kind"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, y, n = group["v"].to_numpy(), group["y"].to_numpy(), group["n"].to_numpy(np.float64)
        missing = group["cells"].iloc[0] - n.sum()
        if missing > 0:
            x, y, n = np.append(x, 0.0), np.append(y, 0.0), np.append(n, missing)
        return pd.DataFrame({"kind": group["kind"].iloc[:1], "coefficient": [tau_b(x, y, n)]})

    return counted.groupBy("kind").applyInPandas(run, f"kind {kind}, coefficient double")


def tau_b(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float | None:
    """Kendall's tau-b of weighted points, by merging and counting inversions with a binary indexed tree."""
    total = n.sum()
    pairs = lambda w: (w * (w - 1) / 2).sum()
    group = lambda v: np.bincount(np.unique(v, return_inverse=True)[1], n)
    all_, tied_x, tied_y = total * (total - 1) / 2, pairs(group(x)), pairs(group(y))
    if all_ in (tied_x, tied_y):
        return None
    levels = np.unique(y, return_inverse=True)[1]
    tree = np.zeros(levels.max() + 2)

    def below(k: int) -> float:
        s = 0.0
        while k > 0:
            s += tree[k]
            k -= k & -k
        return s

    order = np.argsort(x, kind="stable")
    agree = differ = seen = 0.0
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and x[order[end]] == x[order[at]]:
            i = order[end]
            agree += n[i] * below(int(levels[i]))
            differ += n[i] * (seen - below(int(levels[i]) + 1))
            end += 1
        for i in order[at:end]:
            seen += n[i]
            k = int(levels[i]) + 1
            while k < len(tree):
                tree[k] += n[i]
                k += k & -k
        at = end
    return float((agree - differ) / np.sqrt((all_ - tied_x) * (all_ - tied_y)))


def correlation_matrix(rows: DataFrame, value: str = "n_obs", clade: str = "species_id", method: str = "pearson", cell: str = "cell") -> DataFrame:
    """species_i, species_j, r for every ordered pair, values averaged by cell; null where a side is constant.

    The cells' values are counted once and kept; pairs are taken by blocks of clades (see ``pair_blocks``), each pair of
    blocks once, for any of the methods.
    """
    vectors, cells, blocks, kinds = _vectors(rows, value, clade, method, cell)
    return pair_blocks.matrix(vectors, cells, blocks, method, kinds)


def wide_table(rows: DataFrame, kinds: list, value: str = "n_obs", clade: str = "species_id", cell: str = "cell", how: str = "mean") -> DataFrame:
    """A row a cell and a column for each of ``kinds``, 0 where there is none: for the few clades a person looks at. All
    else here stays in long form."""
    fold = F.sum if how == "sum" else F.avg
    table = rows.dropna(subset=[cell]).groupBy(cell).agg(*[F.coalesce(fold(F.when(F.col(clade) == k, F.col(value))).cast("double"), F.lit(0.0)).alias(str(k)) for k in kinds])
    return table


def normalised_predictions(rows: DataFrame, predictions: DataFrame, value: str = "n_obs", cell: str = "cell", species: str = "species_id", scale: float = 10000.0) -> DataFrame:
    """The rows with their predicted value merged back (0 where there is none), and its share of the species' predictions
    times ``scale``."""
    name = f"{value}_predicted"
    merged = rows.drop(name).join(predictions.select(cell, species, name), [cell, species], "left").fillna(0.0, [name])
    return per_species(merged, name, species, scale)


def _vectors(rows: DataFrame, value: str, clade: str, method: str, cell: str) -> tuple[DataFrame, int, int, int]:
    """cell, kind, v (mean), w (sum) as a table, the number of cells (with a clade or not), a number of blocks that fits the
    values, and the number of clades."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    known = rows.filter(F.col(cell).isNotNull())
    held = stored(known.groupBy(F.col(cell).alias("cell"), F.col(clade).alias("kind")).agg(F.coalesce(F.avg(value), F.lit(0)).cast("double").alias("v"), F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("w")))
    values, cells, kinds = held.agg(F.count("kind"), F.count_distinct("cell"), F.count_distinct("kind")).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return held.filter("kind IS NOT NULL"), cells, pair_blocks.blocks_for(values, kinds, tasks), kinds


def predict_from_subject(rows: DataFrame, coefficients: DataFrame, subject, value: str = "n_obs", with_subject: bool = True, cell: str = "cell", species: str = "species_id") -> DataFrame:
    """cell, <value>_predicted: values weighted by their species' coefficient with the subject (its own is 1, or 0)."""
    own = F.when(F.col("kind") == subject, F.lit(1.0 if with_subject else 0.0)).otherwise(F.coalesce("coefficient", F.lit(0.0)))
    weights = coefficients.select(F.col("kind").alias(species), own.alias("weight"))
    joined = rows.filter(F.col(cell).isNotNull()).join(weights, species, "left")
    return joined.groupBy(cell).agg(F.coalesce(F.sum(F.col(value) * F.coalesce("weight", F.lit(0.0))), F.lit(0.0)).alias(f"{value}_predicted"))


def predict(rows: DataFrame, matrix: DataFrame, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    """The rows with <value>_predicted: the matrix times the cell's values, as a join and a sum. Null coefficients and
    species that the matrix does not know add nothing; zero values are left out before the join."""
    products = rows.filter(F.col(value) != 0).select(cell, F.col(species).alias("species_j"), F.col(value).alias("v")).join(matrix.filter("r IS NOT NULL AND r <> 0"), "species_j")
    predicted = products.groupBy(cell, F.col("species_i").alias(species)).agg(F.sum(F.col("r") * F.col("v")).alias(f"{value}_predicted"))
    return rows.join(predicted, [cell, species], "left").fillna(0.0, [f"{value}_predicted"])


def predict_all(rows: DataFrame, value: str = "n_obs", clade: str = "species_id", method: str = "pearson", cell: str = "cell") -> DataFrame:
    """``predict`` with the correlation matrix of the same rows, which is not laid out: pairs of blocks of clades sum for
    their own rows what their coefficients add to them. Few clades (Pearson's r) go by their products, without pairs of blocks."""
    vectors, cells, blocks, kinds = _vectors(rows, value, clade, method, cell)
    by = few_kinds.predicted(vectors, cells) if method == "pearson" and kinds <= few_kinds.FEW else pair_blocks.predicted(vectors, cells, blocks, method, kinds)
    found = by.select(F.col("cell").alias(cell), F.col("kind").alias(clade), F.col("p").alias(f"{value}_predicted"))
    return rows.join(found, [cell, clade], "left").fillna(0.0, [f"{value}_predicted"])


def predict_sums(local: DataFrame, rows: DataFrame, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    """species, value and <value>_predicted of every species of ``rows``, summed over the cells of ``local``: what ``predict``
    with Pearson's matrix of ``rows`` gives in sum, without a pair of species. As r is made of products over cells, the
    matrix times the sums is the cells' table times its transpose times the sums, less the part of the means."""
    known = rows.dropna(subset=[cell, species]).groupBy(F.col(cell).alias("cell"), F.col(species).alias("kind")).agg(F.coalesce(F.avg(value), F.lit(0)).cast("double").alias("v"))
    vectors, cells = stored(known), F.broadcast(_cells(rows, cell))
    spread = F.col("cells") * F.col("q") - F.col("s") * F.col("s")
    moments = _moments(vectors).join(cells).select("kind", "s", "cells", F.when(spread > 1e-9 * F.col("cells") * F.col("q"), F.sqrt(spread)).alias("root"))
    totals = local.dropna(subset=[cell, species]).groupBy(F.col(species).alias("kind")).agg(F.coalesce(F.sum(value), F.lit(0)).alias("t"))
    figures = stored(moments.join(totals, "kind", "left").fillna(0, ["t"]).withColumn("u", F.when(F.col("t") != 0, F.col("t") / F.col("root"))))
    there = figures.filter("u IS NOT NULL")
    by_cell = vectors.join(there.select("kind", "u"), "kind").groupBy("cell").agg(F.sum(F.col("v") * F.col("u")).alias("y"))
    products = vectors.join(by_cell, "cell").groupBy("kind").agg(F.sum(F.col("v") * F.col("y")).alias("z"))
    means = F.broadcast(there.agg(F.coalesce(F.sum(F.col("s") * F.col("u")), F.lit(0.0)).alias("m")))  # one row
    p = (F.col("cells") * F.coalesce("z", F.lit(0.0)) - F.col("s") * F.col("m")) / F.col("root")
    found = figures.join(products, "kind", "left").join(means)
    return found.select(F.col("kind").alias(species), F.col("t").alias(value), F.coalesce(p, F.lit(0.0)).alias(f"{value}_predicted"))


def missing_species(rows: DataFrame, predicted: str, dimension: DataFrame | None = None, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """Species without an observation, by descending predicted sum."""
    out = rows.filter(F.col(species).isNotNull()).groupBy(species).agg(F.sum(value).alias(value), F.sum(predicted).alias(predicted)).filter(F.col(value) == 0)
    return (out.join(dimension, species) if dimension is not None else out).orderBy(F.desc(predicted), species)


def threshold(rows: DataFrame, predictions: DataFrame, subject, predicted: str, least: float = 1, sigmas: float = 2, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    """One row: mean less ``sigmas`` sample deviations of the predictions where the subject was seen; 0 for sigmas 0."""
    if not sigmas:
        return predictions.agg(F.lit(0.0).alias("threshold"))
    seen = rows.filter((F.col(species) == subject) & (F.col(value) >= least)).select(cell)
    return predictions.join(seen, cell, "left_semi").agg((F.avg(predicted) - sigmas * F.stddev_samp(predicted)).alias("threshold"))


def quantile_threshold(rows: DataFrame, predictions: DataFrame, subject, predicted: str, q: float = 0.2, least: float = 1, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> DataFrame:
    """One row: a quantile of the predictions where the subject was seen."""
    seen = rows.filter((F.col(species) == subject) & (F.col(value) >= least)).select(cell)
    found = exact_quantiles(predictions.join(seen, cell, "left_semi").withColumn("_all", F.lit(1)), ["_all"], predicted, [q])
    # One row, null without a prediction.
    return found.agg(F.max("q0").alias("threshold"))


def presence_zone(predictions: DataFrame, bound: DataFrame, predicted: str) -> DataFrame:
    """Cells whose prediction reaches the threshold (one row)."""
    return predictions.join(F.broadcast(bound)).filter(F.col(predicted) >= F.col("threshold")).drop("threshold")


def fit_points(rows: DataFrame, predictions: DataFrame, subject, predicted: str, value: str = "n_obs", cell: str = "cell", species: str = "species_id", observations: str = "n_obs") -> DataFrame:
    """cell, x (the subject's value) and y (the prediction's share of the largest one) of the cells with at least one
    observation of the subject; the largest prediction is that of these cells."""
    own = rows.filter(F.col(species) == subject).groupBy(cell).agg(F.sum(observations).alias("seen"), F.sum(value).cast("double").alias("x")).filter("seen >= 1")
    both = own.join(predictions.select(cell, predicted), cell, "left").fillna(0.0, ["x", predicted])
    top = F.broadcast(both.agg(F.max(predicted).alias("top")))  # one row
    return both.join(top).select(cell, "x", ratio(predicted, "top").alias("y"))
