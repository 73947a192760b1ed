"""Tail probabilities of test statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

KS_TERMS = 100


def kolmogorov_tail(statistic: Column, n_ref: Column, n_cur: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value as a series of 100 terms."""
    size = n_ref.cast("double") * n_cur / (n_ref + n_cur)
    lam2 = statistic * statistic * size
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam2),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    # For a tiny statistic the alternating series does not converge; the limit is 1.
    return F.when(lam2 < 0.02, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def _chi2_tail(x: float, df: float) -> float:
    """P(chi-square with whole degrees of freedom > x), by its finite sum."""
    if x is None or df is None or math.isnan(x) or df < 1:
        return 1.0
    if math.isinf(x):
        return 0.0
    if x <= 0:
        return 1.0
    h, n = x / 2.0, int(df)
    odd = n % 2
    offset = 0.5 if odd else 0.0
    start = math.erfc(math.sqrt(h)) if odd else 0.0
    powers = range(1, n // 2 + 1) if odd else range(0, n // 2)
    steps = ((k - offset) for k in powers)
    tail = start + sum(math.exp(a * math.log(h) - h - math.lgamma(a + 1)) for a in steps)
    return min(1.0, tail)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Applied to one row per feature, after all counting is done."""
    return pd.Series([_chi2_tail(a, b) for a, b in zip(x, df)])


# Samples up to this size get the exact p-value; beyond it the asymptotic one is as good.
KS_EXACT = 10_000


def _ks_exact(statistic: float, n: int, m: int) -> float:
    """P(D >= statistic) for two samples without ties, by counting lattice paths.

    A path from (0, 0) to (n, m) is an order of the pooled sample; it stays below the
    statistic while |i m - j n| does. Within a row of such points the counts are running sums of the
    row before, so only the band under the statistic is walked. Counts are kept as shares.
    """
    if statistic is None or not n or not m or math.isnan(statistic):
        return float("nan")
    gap = round(statistic * n * m)
    if gap <= 0:
        return 1.0
    low, high = 0, min(m, (gap - 1) // n)
    row, log_scale = np.ones(high + 1), 0.0
    for i in range(1, n + 1):
        first, last = max(0, -((gap - 1 - i * m) // n)), min(m, (i * m + gap - 1) // n)
        if first > last or first > high:
            return 1.0
        wide = np.zeros(last - first + 1)
        part = row[first - low: min(high, last) - low + 1]
        wide[: len(part)] = part
        row, low, high = np.cumsum(wide), first, last
        top = row[-1]
        if top > 1e200:
            row, log_scale = row / top, log_scale + math.log(top)
    if high < m:
        return 1.0
    paths = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return min(1.0, max(0.0, 1.0 - math.exp(math.log(row[m - low]) + log_scale - paths)))


@F.pandas_udf(DoubleType())
def ks_exact_tail(statistic: pd.Series, n_ref: pd.Series, n_cur: pd.Series) -> pd.Series:
    """Applied to one row per feature, after all counting is done."""
    return pd.Series([_ks_exact(d, int(n), int(m)) for d, n, m in zip(statistic, n_ref, n_cur)])


def ks_tail(statistic: Column, n_ref: Column, n_cur: Column) -> Column:
    """Exact p-value where both samples have at most `KS_EXACT` values, else the asymptotic one."""
    small = F.greatest(n_ref, n_cur) <= KS_EXACT
    exact = ks_exact_tail(F.when(small, statistic), F.when(small, n_ref).otherwise(0), F.when(small, n_cur).otherwise(0))
    return F.when(small, exact).otherwise(kolmogorov_tail(statistic, n_ref, n_cur))
