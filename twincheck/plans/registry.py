"""Plugins: named callables (synthetic, real) that add a metric row to a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLUGINS: dict[str, tuple[Callable[[DataFrame, DataFrame], float], list[str]]] = {}


def register(name: str, metric: Callable[[DataFrame, DataFrame], float], columns: list[str]) -> None:
    PLUGINS[name] = (metric, columns)


def evaluate(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(metric, score) of every plugin whose columns both sides have."""
    rows = [(n, float(f(synth.select(*c), real.select(*c)))) for n, (f, c) in sorted(PLUGINS.items()) if set(c) <= set(real.columns) & set(synth.columns)]
    return real.sparkSession.createDataFrame(rows, "metric string, score double").select("metric", F.col("score"))
