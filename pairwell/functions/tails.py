"""Test tails on one row per group: chi-square with one degree of freedom, and Fisher's exact test.

Spark has no erfc and no non-central hypergeometric distribution. Both run on report rows, never on subjects.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FISHER_TYPE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("p", "odds", "lo", "hi")])
# Terms this many deviations (plus a margin for small means) from the mode are below the smallest double.
_REACH, _MARGIN = 40.0, 1000
_REL_ERR = 1 + 1e-7


@F.pandas_udf(T.DoubleType())
def _chi2_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)), na_action="ignore")


def chi2_tail(x) -> Column:
    """Upper tail of chi-square with one degree of freedom; NaN stays NaN and NULL stays NULL."""
    x = F.col(x) if isinstance(x, str) else x
    # Arrow turns NaN into NULL on the way back, so both are settled here
    return F.when(F.isnan(x), F.lit(float("nan"))).when(x.isNotNull(), _chi2_udf(x))


def _support(row1: int, row2: int, col1: int, centre: float, spread: float) -> tuple[int, int]:
    lo, hi = max(0, col1 - row2), min(row1, col1)
    reach = int(_REACH * spread) + _MARGIN
    return max(lo, int(centre) - reach), min(hi, int(centre) + reach)


def _log_weights(row1: int, row2: int, col1: int, lo: int, hi: int) -> np.ndarray:
    """Log hypergeometric probabilities over [lo, hi] up to a constant, by the ratio of neighbours."""
    x = np.arange(lo, hi, dtype=np.float64)
    step = np.log(row1 - x) + np.log(col1 - x) - np.log(x + 1) - np.log(row2 - col1 + x + 1)
    return np.concatenate(([0.0], np.cumsum(step)))


def _bisect(fn, target: float, rising: bool) -> float:
    """Solve fn(t) = target for the log odds ratio t, fn monotone."""
    lo, hi = -1.0, 1.0
    while (fn(lo) > target) == rising and lo > -700:
        lo *= 2
    while (fn(hi) < target) == rising and hi < 700:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if (fn(mid) < target) == rising:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13 * max(1.0, abs(lo)):
            break
    return math.exp((lo + hi) / 2)


def fisher_one(a: int, b: int, c: int, d: int) -> tuple[float, float, float, float]:
    """Two-sided p, conditional maximum-likelihood odds ratio and its exact 95% interval of [[a, b], [c, d]]."""
    row1, row2, col1 = a + c, b + d, a + b
    first, last = max(0, col1 - row2), min(row1, col1)
    if first == last:
        return 1.0, 0.0, 0.0, math.inf
    total = row1 + row2
    mean = row1 * col1 / total
    sd = math.sqrt(max(mean * (row2 / total) * ((total - col1) / max(total - 1, 1)), 0.0))
    lo, hi = _support(row1, row2, col1, mean, sd)
    if lo <= a <= hi:
        w = _log_weights(row1, row2, col1, lo, hi)
        prob = np.exp(w - w.max())
        prob /= prob.sum()
        p = float(min(1.0, prob[prob <= prob[a - lo] * _REL_ERR].sum()))
    else:
        p = 0.0

    near = 1 / math.sqrt(sum(1 / (v + 0.5) for v in (a, b, c, d)))
    lo, hi = _support(row1, row2, col1, a, near)
    w = _log_weights(row1, row2, col1, lo, hi)
    x = np.arange(lo, hi + 1, dtype=np.float64) - a

    def dist(t: float) -> np.ndarray:
        v = w + x * t
        v = np.exp(v - v.max())
        return v / v.sum()

    at_first, at_last = a == first, a == last
    odds = 0.0 if at_first else math.inf if at_last else _bisect(lambda t: float((dist(t) * x).sum()), 0.0, True)
    low = 0.0 if at_first else _bisect(lambda t: float(dist(t)[a - lo :].sum()), 0.025, True)
    high = math.inf if at_last else _bisect(lambda t: float(dist(t)[: a - lo + 1].sum()), 0.025, False)
    return p, odds, low, high


@F.pandas_udf(FISHER_TYPE)
def fisher_test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    rows = [fisher_one(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)]
    return pd.DataFrame(rows, columns=["p", "odds", "lo", "hi"])
