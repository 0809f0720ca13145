"""Laws that relate counts to predictions, and their inverses."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAWS: dict[str, Callable[..., np.ndarray]] = {
    "linear": lambda x, a, b: a * x + b,
    "power": lambda x, a, b: a * np.power(x, b),
    "exp": lambda x, a, b: np.exp(a * x + b),
    "quadratic": lambda x, a, b, c: a * x * x + b * x + c,
    "normal": lambda x, a, b: np.array([0.5 * (1 + math.erf((v - a) / (b * math.sqrt(2)))) for v in np.atleast_1d(x)]),
    "poisson": lambda x, a: np.array([poisson_cdf(v, a) for v in np.atleast_1d(x)]),
}
#: Number of coefficients of each law.
COEFFICIENTS = {"linear": 2, "power": 2, "exp": 2, "quadratic": 3, "normal": 2, "poisson": 1}


def poisson_cdf(x: float, rate: float) -> float:
    if x < 0 or not rate > 0:
        return 0.0 if x < 0 else float("nan")
    logs = [-rate + k * math.log(rate) - math.lgamma(k + 1) for k in range(int(x) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(v - top) for v in logs))


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series, mean: pd.Series, deviation: pd.Series) -> pd.Series:
    scaled = (x - mean) / (deviation * math.sqrt(2))
    return pd.Series([0.5 * (1 + math.erf(v)) if v == v else None for v in scaled], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return pd.Series([inverse(v) if v == v and 0 < v < 1 else None for v in p.astype("float64")], dtype="float64")


@F.pandas_udf(T.DoubleType())
def poisson_sum(x: pd.Series, rate: pd.Series) -> pd.Series:
    known = {pair: poisson_cdf(*pair) for pair in set(zip(x, rate, strict=True)) if pair[0] == pair[0]}
    return pd.Series([known.get(pair) for pair in zip(x, rate, strict=True)], dtype="float64")


def law(x: Column, name: str, coefficients: list[float]) -> Column:
    """A law's value as a column expression; the normal and Poisson laws run in batches of a function."""
    c = [F.lit(float(v)) for v in coefficients]
    if name == "linear":
        return c[0] * x + c[1]
    if name == "power":
        return c[0] * F.pow(x, c[1])
    if name == "exp":
        return F.exp(c[0] * x + c[1])
    if name == "quadratic":
        return c[0] * x * x + c[1] * x + c[2]
    if name == "normal":
        return normal_cdf(x.cast("double"), c[0], c[1])
    if name == "poisson":
        return poisson_sum(x.cast("double"), c[0])
    raise ValueError(f"unknown law {name}")


def inverse_law(y: Column, name: str, coefficients: list[float]) -> Column:
    """The count that a law maps to y; null where there is none."""
    c = [F.lit(float(v)) for v in coefficients]
    if name == "power":
        return F.when(y / c[0] >= 0, F.pow(F.try_divide(y, c[0]), F.try_divide(F.lit(1.0), c[1])))
    if name == "linear":
        return F.try_divide(y - c[1], c[0])
    if name == "exp":
        return F.try_divide(F.ln(F.when(y > 0, y)) - c[1], c[0])
    if name == "poisson":
        return F.rint(c[0] + F.sqrt(c[0]) * normal_quantile(y.cast("double")))
    if name == "normal":
        return c[0] + c[1] * normal_quantile(y.cast("double"))
    raise ValueError(f"unknown law {name}")
