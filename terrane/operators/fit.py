"""Laws fitted to (count, prediction) points, their residuals, and predictions turned back to counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import ratio
from terrane.functions.laws import COEFFICIENTS, LAWS, inverse_law
from terrane.operators.stored import stored

#: Distinct values of x that a curve is fitted on in the driver; with more, the fit's sums are taken in Spark.
MOST_POINTS, STEPS = 20_000, 10_000


def fit_linear(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: slope a and intercept b of least squares."""
    return points.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("a"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("b"))


#: For coefficients: the sums J'J and J'r of misses and their differences, and the sum of squared misses.
Terms = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]]


def terms_of(x: np.ndarray, y: np.ndarray, weight: np.ndarray, law: str) -> Terms:
    f, n, root = LAWS[law], COEFFICIENTS[law], np.sqrt(weight)

    def misses(q: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return (f(x, *q) - y) * root

    def terms(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        r = misses(q)
        h = 1e-7 * np.maximum(1, np.abs(q))
        with np.errstate(all="ignore"):
            jacobian = np.stack([(misses(q + h[k] * (np.arange(n) == k)) - r) / h[k] for k in range(n)], 1)
            return jacobian.T @ jacobian, jacobian.T @ r, float(r @ r)

    return terms


def terms_in_spark(groups: DataFrame, law: str) -> Terms:
    """The same sums over all of (x, y, n), in parts; only their sums reach the driver."""
    n = COEFFICIENTS[law]

    def terms(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, weight = (np.asarray(batch.column(k), np.float64) for k in range(3))
                a, g, cost = terms_of(x, y, weight, law)(q)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*a.ravel().tolist(), *g.tolist(), cost)], names=names)

        names = [f"s{k}" for k in range(n * n + n + 1)]
        sums = groups.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
        sums = np.array([float("nan") if v is None else v for v in sums])
        return sums[: n * n].reshape(n, n), sums[n * n : -1], float(sums[-1])

    return terms


def least_squares(terms: Terms, law: str, steps: int = STEPS) -> list[float]:
    """Levenberg-Marquardt from ones, with differences for derivatives; raises if it ends without finite coefficients."""
    p, damp = np.ones(COEFFICIENTS[law]), 1e-3
    a, g, cost = terms(p)
    for _ in range(steps):
        if not (np.isfinite(a).all() and np.isfinite(g).all()):
            break
        step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g, rcond=None)[0]
        tried = terms(p + step)
        if np.isfinite(tried[2]) and tried[2] < cost:
            gain, p, damp = cost - tried[2], p + step, damp / 3
            a, g, cost = tried
            if gain <= 1e-14 * max(cost, 1e-300) or np.abs(step).max() < 1e-12:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    if not np.isfinite(p).all():
        raise ValueError(f"no fit of the {law} law")
    return p.tolist()


def fit_law(points: DataFrame, law: str, x: str = "x", y: str = "y") -> list[float]:
    """Coefficients of a law. Points of one x count as often at their mean y, which leaves the fit as it is; where even
    the values of x are very many, every step sums its terms over all of them in Spark."""
    if law not in LAWS:
        raise ValueError(f"law must be one of {', '.join(LAWS)}")
    known = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    groups = known.groupBy("x").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    if groups.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        return least_squares(terms_in_spark(stored(groups), law), law)
    rows = np.array([tuple(r) for r in groups.orderBy("x").collect()], np.float64).reshape(-1, 3)
    return least_squares(terms_of(rows[:, 0], rows[:, 1], rows[:, 2], law), law)


def residuals(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: mean and population deviation of the linear fit's residuals."""
    line = F.broadcast(fit_linear(points, x, y))
    return points.join(line).select((F.col(y) - (F.col("a") * F.col(x) + F.col("b"))).alias("e")).agg(F.avg("e").alias("mean"), F.stddev_pop("e").alias("deviation"))


def transformed(rows: DataFrame, column: str, method: str, coefficients: list[float]) -> DataFrame:
    """n_obs_predicted_<method>: the inverse law of the column's share of its largest value."""
    top = F.broadcast(rows.agg(F.max(column).alias("top")))
    return rows.join(top).withColumn(f"n_obs_predicted_{method}", inverse_law(ratio(column, "top"), method, coefficients)).drop("top")
