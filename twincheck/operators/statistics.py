"""Test suites over the frequency table: Kolmogorov-Smirnov, Wasserstein, Anderson-Darling, chi-squared, Jensen-Shannon."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import chi2_pvalue
from .frequency import categorical_scores, numeric_scores

#: Rows on each side that a column needs.
LEAST_ROWS = 5
DISTANCE_LIMIT = 0.1
PASSING_SHARE = 0.85


def anderson_darling_t(a2: float, n: int, m: int) -> float:
    """The standardised two-sample statistic (Scholz and Stephens 1987).

    Beyond a million values the harmonic sums take their limits."""
    big, k, sizes = n + m, 2, 1 / n + 1 / m
    if big <= 1_000_000:
        harmonic = np.cumsum(1 / np.arange(1, big))
        h = float(harmonic[-1])
        i = np.arange(1, big - 1)
        g = float(((h - harmonic[i - 1]) / (big - i)).sum())
    else:
        h, g = math.log(big - 1) + 0.5772156649015329 + 0.5 / (big - 1), math.pi**2 / 6
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * sizes
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * sizes - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * sizes + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    return (a2 - (k - 1)) / math.sqrt((a * big**3 + b * big**2 + c * big + d) / ((big - 1.0) * (big - 2) * (big - 3)))


#: Fixed values of the published table for two samples: significance levels and the coefficients of their critical values.
LEVELS = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)
CRITICAL = ((0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085), (-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615), (-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154))


def anderson_darling_p(t: float) -> float:
    """p-value of the standardised statistic: log significance as a parabola through the table's critical values, within the table's range."""
    critical = np.sum(CRITICAL, axis=0)
    if not math.isfinite(t):
        return t if math.isnan(t) else LEVELS[-1] if t > 0 else LEVELS[0]
    if t <= critical[0] or t >= critical[-1]:
        return LEVELS[0] if t <= critical[0] else LEVELS[-1]
    return float(np.exp(np.polyval(np.polyfit(critical, np.log(LEVELS), 2), t)))


def anderson_darling_pvalue(t: Column) -> Column:
    """Only used on finished reports, one row per column."""

    def run(t: pd.Series) -> pd.Series:
        return t.map(anderson_darling_p, na_action="ignore").astype(float)

    return F.pandas_udf(run, "double")(t)


def standardised(a2: str, n: str, m: str) -> Column:
    """Only used on finished reports, one row per column."""

    def run(a2: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([anderson_darling_t(x, int(i), int(j)) for x, i, j in zip(a2, n, m, strict=True)])

    return F.pandas_udf(run, "double")(a2, n, m)


def numeric_tests(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: KS with p-value, Wasserstein by the real deviation, Anderson-Darling sum, JS of histograms, means and deviations."""
    found = numeric_scores(real, synth, columns, LEAST_ROWS)
    found = found.withColumn("anderson_darling_t", standardised("a2", "n_real", "n_synth"))
    return found.select(
        "column", "n_real", "n_synth", "ks", "ks_pvalue", (F.col("wasserstein") / (F.col("std_real") + 1e-8)).alias("wasserstein"), F.col("a2").alias("anderson_darling"), "anderson_darling_t", anderson_darling_pvalue(F.col("anderson_darling_t")).alias("anderson_darling_p"),
        F.least(F.col("js"), F.lit(1.0)).alias("js"), "mean_real", "mean_synth", "std_real", "std_synth", F.abs(F.col("mean_real") - F.col("mean_synth")).alias("mean_difference"),
    )


def categorical_tests(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    found = categorical_scores(real, synth, columns, LEAST_ROWS)
    return found.select("column", F.col("total_real").alias("n_real"), F.col("total_synth").alias("n_synth"), "chi2", "dof", chi2_pvalue("chi2", "dof").alias("chi2_pvalue"), F.col("tv_distance").alias("tvd"), "js_divergence", "unique_real", "unique_synth")


def suite(real: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str], alpha: float = 0.05, limit: float = DISTANCE_LIMIT) -> DataFrame:
    """One row per column with its test, the Bonferroni decision and the verdict over all columns."""
    a = numeric_tests(real, synth, numeric).select("column", F.lit("ks").alias("test"), F.col("ks").alias("statistic"), F.col("ks_pvalue").alias("p_value"), ((F.col("wasserstein") > limit) | (F.col("js") > limit)).alias("distance_failed"))
    b = categorical_tests(real, synth, categorical).select("column", F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), F.col("chi2_pvalue").alias("p_value"), (F.col("js_divergence") > limit).alias("distance_failed"))
    w = Window.partitionBy(F.lit(1))  # a row per column of the datasets
    both = a.unionByName(b).withColumn("rejected", F.col("p_value") < alpha / F.greatest(F.count(F.lit(1)).over(w), F.lit(1)))
    share = 1 - F.count_if("rejected").over(w) / F.count(F.lit(1)).over(w)
    return both.select("*", share.alias("fraction_passing"), ((share >= PASSING_SHARE) & (F.count_if("distance_failed").over(w) == 0)).alias("passed"))


def ks_only(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ks, ks_pvalue) of every numeric column with a value on both sides."""
    return numeric_scores(real, synth, columns, 1).select("column", "ks", "ks_pvalue")


def chi2_only(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(column, chi2, dof, chi2_pvalue) of every categorical column with a value on both sides."""
    return categorical_scores(real, synth, columns, 1).select("column", "chi2", "dof", chi2_pvalue("chi2", "dof").alias("chi2_pvalue"))
