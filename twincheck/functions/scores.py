"""Column expressions that several reports share."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(x: Column) -> Column:
    """x within [0, 1]; NaN and null stay as they are, since least and greatest order NaN above every number."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def entropy_term(p: Column, q: Column) -> Column:
    """p ln(p / q), 0 where p is 0."""
    return F.when(p > 0, p * F.ln(p / q)).otherwise(F.lit(0.0))


def risk_level(x: Column) -> Column:
    return F.when(x <= 0.05, "low").when(x <= 0.15, "medium").when(x <= 0.30, "high").otherwise("critical")


def memorization_level(auc: Column) -> Column:
    return F.when(auc < 0.55, "low").when(auc < 0.65, "medium").otherwise("high")


def ks_pvalue(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic."""
    t = n * m / (n + m) * d * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t))
    return F.when(t < 0.03, F.lit(1.0)).otherwise(clip01(series))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series for small x, else Lentz's continued fraction."""
    if x <= 0:
        return 1.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - head * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def chi2_pvalue(statistic: str, dof: str) -> Column:
    """Only used on finished reports, one row per column."""

    def run(statistic: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([1.0 if k < 1 else upper_gamma(k / 2, x / 2) for x, k in zip(statistic, dof, strict=True)])

    return F.pandas_udf(run, "double")(statistic, dof)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guard: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + guard) * (norm(b) + guard))


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)
