"""The incomplete beta function and its relatives, vectorised where Spark has none."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            out = out * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return out


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(X <= x) for X of Beta(a, b); zero below 0, one above 1."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    if inside.any():
        p, q, t = a[inside], b[inside], x[inside]
        swap = t > (p + 1) / (p + q + 2)
        p, q, t = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - t, t)
        front = np.exp((_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(t) + q * np.log1p(-t)) / p
        low = front * _fraction(p, q, t)
        out[inside] = np.where(swap, 1 - low, low)
    return out


@F.pandas_udf(T.DoubleType())
def _survival(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series(1 - beta_cdf(a.to_numpy(float), b.to_numpy(float), t.to_numpy(float)))


def beta_survival(a: Column, b: Column, threshold: Column) -> Column:
    """P(X > threshold) for X of Beta(a, b)."""
    return _survival(a.cast("double"), b.cast("double"), threshold.cast("double"))


def student_quantiles(p: float, freedoms: list[float]) -> list[float]:
    """The p-quantile of Student's t for each number of degrees of freedom, by bisection of the incomplete beta."""
    if p < 0.5:
        return [-x for x in student_quantiles(1 - p, freedoms)]
    f = np.array(freedoms, float)
    low, high = np.zeros(len(f)), np.full(len(f), 1e6)
    for _ in range(72):
        mid = (low + high) / 2
        more = 1 - beta_cdf(f / 2, 0.5, f / (f + mid * mid)) / 2 < p
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return ((low + high) / 2).tolist()


def student_quantile(p: float, freedom: float) -> float:
    return student_quantiles(p, [freedom])[0]
