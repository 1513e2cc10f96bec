"""One evaluation of two datasets: columns and their kinds come from the schemas, and what can't be scored is named.

Dates and timestamps are compared as numbers, the microseconds since 1970; text on the other side is read as a timestamp.

Defined results: a named column that one side lacks is `missing`; one of numbers (or dates) on the real side and of neither such nor
text on the other is `incompatible`; one with fewer than `least` values on a side is `empty`. None of these has a score or enters a
mean. Columns that only the synthetic side has are ignored unless named. Without any score a mean is 0.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ..plans.storage import materialised
from ..sources.datasets import capped
from . import frequency as fq
from . import similarity
from .health import number
from .sequences import new_rows_within

_TYPES = {"numeric": (NumericType, BooleanType), "datetime": (DateType, TimestampType, TimestampNTZType)}


def kind_of(held: DataType) -> str:
    """numeric, datetime or categorical, by a column's type."""
    return next((k for k, types in _TYPES.items() if isinstance(held, types)), "categorical")


def kinds(real: DataFrame, synth: DataFrame, columns: list[str] | None = None) -> list[tuple[str, str, str | None]]:
    """(column, kind, problem) in the real side's order, or that of the names; the kind goes by the real side's type, else by the other's."""
    out: list[tuple[str, str, str | None]] = []
    for c in columns or real.columns:
        sides = [df for df in (real, synth) if c in df.columns]
        kind = kind_of(sides[0].schema[c].dataType) if sides else "categorical"
        problem = None if len(sides) == 2 else "missing"
        if kind != "categorical" and not problem and not isinstance(synth.schema[c].dataType, (*_TYPES[kind], StringType)):
            problem = "incompatible"
        out.append((c, kind, problem))
    return out


def micros(c: str) -> Column:
    """A date, a timestamp or its text as microseconds since 1970; other text becomes null."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', try_cast(`{c}` AS TIMESTAMP_NTZ))").cast("double")


def comparable(df: DataFrame, found: list[tuple[str, str, str | None]]) -> DataFrame:
    """The usable columns of a side: numbers and times as doubles, the rest as text."""
    as_kind = {"numeric": number, "datetime": micros, "categorical": lambda c: F.col(f"`{c}`").cast("string")}
    return df.select(*(as_kind[kind](c).alias(c) for c, kind, problem in found if not problem))


def _usable(found: list[tuple[str, str, str | None]]) -> tuple[list[str], list[str]]:
    """Names of numbers and times, and of categories."""
    return [c for c, k, problem in found if not problem and k != "categorical"], [c for c, k, problem in found if not problem and k == "categorical"]


def evaluate(real: DataFrame, synth: DataFrame, columns: list[str] | None = None, least: int = 1) -> DataFrame:
    """(column, kind, status, score): a row for each column of the real side, or each named one, and one of kind `table` with their mean."""
    found = kinds(real, synth, columns)
    numeric, categorical = _usable(found)
    spark, sides = real.sparkSession, (comparable(real, found), comparable(synth, found))
    parts = []
    if numeric:
        parts.append(fq.numeric_scores(*sides, numeric, least))
    if categorical:
        parts.append(fq.categorical_scores(*sides, categorical, least))
    scores = spark.createDataFrame([], "column string, column_score double")
    for part in parts:
        scores = scores.unionByName(part.select("column", "column_score"))
    plan = spark.createDataFrame(found, "column string, kind string, problem string")
    status = F.coalesce("problem", F.when(F.col("column_score").isNull(), "empty").otherwise("scored"))
    rows = materialised(plan.join(scores, "column", "left").select("column", "kind", status.alias("status"), F.col("column_score").alias("score")))  # a row per column
    whole = F.when(F.count("score") > 0, "scored").otherwise("empty")
    return rows.unionByName(rows.agg(F.lit("").alias("column"), F.lit("table").alias("kind"), whole.alias("status"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score")))


_SHAPES = ["ks_complement", "tv_complement"]


def _planned(found: list[tuple[str, str, str | None]], numeric: list[str], categorical: list[str]) -> list[tuple[str, str, str, str, str | None]]:
    """Every marginal and pairwise row that the evaluation owes, scored or not."""
    rows = []
    for c, kind, problem in found:
        for metric in ("tv_complement", "category_adherence") if kind == "categorical" else ("ks_complement", "boundary_adherence"):
            rows.append(("marginal", metric, c, "", problem))
    for metric, names in (("correlation", numeric), ("contingency", categorical)):
        rows += [("pairwise", metric, a, b, None) for a, b in combinations(names, 2)]
    return rows


def evaluate_all(
    real: DataFrame, synth: DataFrame, columns: list[str] | None = None, least: int = 1, most: int | None = None, key: str | None = None, detect: bool = True, tolerances: dict[str, float] | None = None
) -> DataFrame:
    """(part, metric, column, other, status, score): the evaluation in its parts, what could not be scored included.

    - `marginal`: KS complement and boundary adherence of numbers and times, TV complement and category adherence of categories;
    - `pairwise`: correlation similarity of every two columns of numbers or times, contingency similarity of every two categories;
      a pair without a correlation on a side (constant or without values) is `undefined`;
    - `table_level`: new-row synthesis (numbers agree within `tolerances`, else exactly) and, with `detect`, logistic detection; `empty`
      where a side has no rows to judge;
    - `quality`: the means of column shapes (KS and TV complements) and of pair trends;
    - a row of metric `score` for the first three parts, the mean of what they scored, and one of part `overall`: the mean of the quality rows.

    `most` caps each side by a hash of the unique column `key`, as a sampling option; without it all rows count. The key is not evaluated
    unless named."""
    if most is not None:
        if key is None:
            raise ValueError("a row cap needs the name of a unique key")
        columns = columns or [c for c in real.columns if c != key]
        real, synth = capped(real, key, most), capped(synth, key, most)
    found = kinds(real, synth, columns)
    numeric, categorical = _usable(found)
    spark, usable = real.sparkSession, numeric + categorical
    real, synth = comparable(real, found), comparable(synth, found)

    scores = similarity.marginals(real, synth, numeric, categorical, least).select(F.lit("marginal").alias("part"), "metric", "column", F.lit("").alias("other"), "score")
    for metric, pairs in (("correlation", similarity.correlation_similarity(real, synth, numeric)), ("contingency", similarity.contingency_similarity(real, synth, categorical))):
        scores = scores.unionByName(pairs.select(F.lit("pairwise").alias("part"), F.lit(metric).alias("metric"), F.col("a").alias("column"), F.col("b").alias("other"), "score"))
    planned = spark.createDataFrame(_planned(found, numeric, categorical), "part string, metric string, column string, other string, problem string")
    absent = F.when(F.col("metric") == "correlation", "undefined").otherwise("empty")
    status = F.coalesce("problem", F.when(F.col("score").isNull(), absent).otherwise("scored"))
    rows = planned.join(scores, ["part", "metric", "column", "other"], "left").select("part", "metric", "column", "other", status.alias("status"), "score")

    def whole(name: str, one: DataFrame) -> DataFrame:
        state = F.when(F.col("score").isNull(), "empty").otherwise("scored")
        return one.select(F.lit("table_level").alias("part"), F.lit(name).alias("metric"), F.lit("").alias("column"), F.lit("").alias("other"), state.alias("status"), "score")

    if usable:
        near = {c: e for c, e in (tolerances or {}).items() if c in numeric}
        new = new_rows_within(real, synth, near, [c for c in usable if c not in near]) if near else similarity.new_rows(real, synth, usable)
        rows = rows.unionByName(whole("new_row_synthesis", new))
        if detect:
            rows = rows.unionByName(whole("logistic_detection", similarity.logistic_detection(real, synth, usable)))
    rows = materialised(rows)  # two rows a column, one a pair

    def mean(held: DataFrame, part: str, metric: str) -> DataFrame:
        state = F.when(F.count("score") > 0, "scored").otherwise("empty")
        return held.agg(F.lit(part).alias("part"), F.lit(metric).alias("metric"), F.lit("").alias("column"), F.lit("").alias("other"), state.alias("status"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"))

    shapes, trends = mean(rows.where(F.col("metric").isin(_SHAPES)), "quality", "column_shapes"), mean(rows.where("part = 'pairwise'"), "quality", "pair_trends")
    quality = shapes.unionByName(trends)
    out = rows.unionByName(quality).unionByName(mean(quality.where("status = 'scored'"), "overall", "score"))
    for part in ("marginal", "pairwise", "table_level"):
        out = out.unionByName(mean(rows.where(F.col("part") == part), part, "score"))
    return out
