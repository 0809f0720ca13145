"""Outliers of a species' counts: winsorising at a quantile, a vote of random forests, putting corrected values back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import truth
from terrane.operators.quantiles import exact_quantiles
from terrane.operators.stored import stored


def species_quantile(rows: DataFrame, q: float, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """species, bound: the exact quantile, rounded half to even; a species with very many values is narrowed down."""
    return exact_quantiles(rows, [species], value, [q]).select(species, F.bround("q0", 0).alias("bound"))


def winsorised(rows: DataFrame, q: float = 0.98, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """Values above their species' bound become the bound, in ``<value>_corrected``."""
    bounds = species_quantile(rows, q, value, species)
    out = rows.join(bounds, species, "left")
    return out.withColumn(f"{value}_corrected", F.when(truth(F.col(value) > F.col("bound")), F.col("bound")).otherwise(F.col(value).cast("double"))).drop("bound")


def replace_flagged(rows: DataFrame, flag: str, q: float = 0.99, value: str = "n_obs", species: str = "species_id") -> DataFrame:
    """Values of flagged rows become their species' rounded quantile."""
    out = rows.join(species_quantile(rows, q, value, species), species, "left")
    return out.withColumn(value, F.when(truth(F.col(flag)), F.col("bound")).otherwise(F.col(value).cast("double"))).drop("bound")


def put_back(rows: DataFrame, corrected: DataFrame, keys: list[str], value: str = "n_obs") -> DataFrame:
    """The rows with corrected values where there are any."""
    return rows.join(corrected.select(*keys, F.col(value).alias("corrected")), keys, "left").withColumn(value, F.coalesce(F.col("corrected"), F.col(value).cast("double"))).drop("corrected")


#: Points that are sent to all tasks (16 bytes each); where more are strange, tasks score their rows themselves.
MOST_POINTS = 1_000_000


class IsolationForest:
    """Trees of random cuts over (species code, value); points that few cuts isolate are outliers."""

    def __init__(self, points: np.ndarray, trees: int, size: int, rng: np.random.Generator):
        self.size = min(size, len(points))
        depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.trees = [self._grow(points[rng.integers(0, len(points), self.size)], depth, rng) for _ in range(trees)]

    def _grow(self, points: np.ndarray, depth: int, rng: np.random.Generator):
        spans = points.max(0) - points.min(0) if len(points) else np.zeros(points.shape[1])
        if depth == 0 or len(points) < 2 or not spans.any():
            return _path(len(points))
        axis = int(rng.choice(np.flatnonzero(spans)))
        cut = float(points[:, axis].min() + rng.random() * spans[axis])
        left = points[:, axis] < cut
        return axis, cut, self._grow(points[left], depth - 1, rng), self._grow(points[~left], depth - 1, rng)

    def score(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        for tree in self.trees:
            total += self._depths(tree, points)
        return 2.0 ** (-total / len(self.trees) / max(_path(self.size), 1e-9))

    def _depths(self, node, points: np.ndarray) -> np.ndarray:
        if not isinstance(node, tuple):
            return np.full(len(points), float(node))
        axis, cut, low, high = node
        left, out = points[:, axis] < cut, np.empty(len(points))
        out[left], out[~left] = self._depths(low, points[left]) + 1, self._depths(high, points[~left]) + 1
        return out


def _path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def score_bounds(scored: DataFrame, n_forests: int, q: float, buckets: int = 4096) -> list[float]:
    """The exact quantile of each forest's scores, over all rows. scored: s (a score in 0 .. 1 for each forest), n (rows).

    Counts by bucket show where the two values beside the quantile lie; only the distinct scores of those buckets are
    looked at one by one.
    """
    at = scored.select(F.posexplode("s").alias("k", "s"), "n").withColumn("b", F.floor(F.col("s") * buckets).cast("int"))
    tables = [{} for _ in range(n_forests)]
    for k, b, n in at.groupBy("k", "b").agg(F.sum("n")).collect():
        tables[k][b] = n
    place = q * (sum(tables[0].values()) - 1)
    ends = [int(np.floor(place)), int(np.ceil(place))]
    found: list[dict[int, tuple[int, int]]] = []
    for table in tables:
        names = sorted(table)
        upto = np.cumsum([table[b] for b in names])
        found.append({e: (names[i := int(np.searchsorted(upto, e, "right"))], int(upto[i]) - table[names[i]]) for e in ends})
    wanted = scored.sparkSession.createDataFrame(sorted({(k, b) for k, f in enumerate(found) for b, _ in f.values()}), "k int, b int")
    values: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for k, b, v, n in at.join(F.broadcast(wanted), ["k", "b"]).groupBy("k", "b", "s").agg(F.sum("n")).collect():
        values.setdefault((k, b), []).append((v, n))
    bounds = []
    for k, f in enumerate(found):
        pair = []
        for e in ends:
            b, before = f[e]
            held = sorted(values[k, b])
            pair.append(held[int(np.searchsorted(before + np.cumsum([n for _, n in held]), e, "right"))][0])
        bounds.append(float(np.quantile(pair, place - ends[0])))
    return bounds


def forest_vote(rows: DataFrame, value: str = "n_obs", species: str = "species_id", rounds: int = 30, share: float = 0.8, contamination: float = 0.002, trees: int = 50, sample: int = 20_000, seed: int = 0) -> DataFrame:
    """Adds ``outlier``: whether at least ``share`` of the forests put the row among the ``contamination`` strangest.

    Trees are drawn from the at most ``sample`` rows of least hash, so from the same ones however rows are dealt; each
    bound is the quantile of the scores of all rows. A species enters as the rank of its mean value, so one axis orders
    all of them. Rows of one mean and value are one point, which is scored once and has the votes of all of them.
    """
    rows = stored(rows)
    means = rows.filter(F.col(species).isNotNull() & F.col(value).isNotNull()).groupBy(species).agg(F.avg(value).alias("species_mean"))
    points = stored(rows.join(means, species, "left"))
    known = points.select("species_mean", F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), *rows.columns).alias("hash")).dropna()
    drawn = known.orderBy("hash", "species_mean", "v").limit(sample).select("species_mean", "v").toPandas().sort_values(["species_mean", "v"]).to_numpy()
    if len(drawn) < 2:
        return rows.withColumn("outlier", F.lit(False))
    rng = np.random.default_rng(seed)
    forests = [IsolationForest(drawn, trees, 256, rng) for _ in range(rounds)]
    planted = rows.sparkSession.sparkContext.broadcast(forests)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([np.asarray(batch.column(k)) for k in (0, 1)], 1)
            flat = np.stack([f.score(at) for f in planted.value], 1).reshape(-1)
            offsets = pa.array(np.arange(len(at) + 1) * len(planted.value), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(offsets, pa.array(flat)), batch.column(2)], names=["species_mean", "v", "s", "n"])

    # The shuffle that counts points puts many of them into a task, though scoring one takes far longer: they are dealt anew.
    counted = stored(known.groupBy("species_mean", "v").agg(F.count("*").alias("n")))
    scored = stored(counted.repartition(rows.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(scores, "species_mean double, v double, s array<double>, n long"))
    bounds = score_bounds(scored, rounds, 1 - contamination)
    votes = sum((F.col("s")[k] > limit).cast("int") for k, limit in enumerate(bounds))
    strange = stored(scored.filter(votes >= share * rounds).select("species_mean", "v"))
    if strange.count() <= MOST_POINTS:
        near = F.broadcast(strange.select(F.col("species_mean").alias("_mean"), F.col("v").alias("_v"), F.lit(True).alias("_strange")))
        found = points.join(near, (F.col("species_mean") == F.col("_mean")) & (F.col(value).cast("double") == F.col("_v")), "left")
        return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("_strange", F.lit(False)).alias("outlier"))
    sent = rows.sparkSession.sparkContext.broadcast((forests, bounds))
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, limits = sent.value
        for batch in batches:
            at = np.stack([np.asarray(batch.column(names.index(c)).cast(pa.float64()).fill_null(np.nan)) for c in ("species_mean", value)], 1)
            known = ~np.isnan(at).any(1)
            votes = np.zeros(len(at))
            for forest, limit in zip(fitted, limits, strict=True):
                votes[known] += forest.score(at[known]) > limit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known & (votes >= share * len(fitted)))], names=[*names, "outlier"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", outlier boolean"
    return points.mapInArrow(run, schema).select(*rows.columns, "outlier")
