"""Marginal, pairwise and table-level similarity, and the quality report that sums them up."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import FeatureHasher
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialised
from .frequency import categorical_scores, category_distances, numeric_scores


def marginals(real: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str], least: int = 1) -> DataFrame:
    """(column, metric, score): KS complement and boundary adherence of numbers, TV complement and category adherence of categories.

    Columns with fewer than `least` values on a side are left out."""
    out = real.sparkSession.createDataFrame([], "column string, metric string, score double")
    sides = [
        (numeric, numeric_scores, {"ks_complement": "ks_score", "boundary_adherence": "boundary_adherence"}),
        (categorical, categorical_scores, {"tv_complement": "tv_score", "category_adherence": "adherence"}),
    ]
    for columns, scores, metrics in sides:
        if columns:
            cells = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(held).alias("score")) for name, held in metrics.items()))
            out = out.unionByName(scores(real, synth, columns, least).select("column", F.explode(cells).alias("m")).select("column", "m.*"))
    return out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, corr) of each pair of column numbers i < j: the correlation over the rows where both are finite numbers.

    Each task turns its rows into four products of matrices, d by d for d columns, and sends a row per pair; sums of such rows follow.
    So a row costs no copies of itself however many columns there are. Values are taken from their column's mean before
    squares are summed; a spread below a millionth of the distance from that mean counts as none, and the correlation is null."""
    d = len(columns)
    value = [F.col(f"`{c}`").cast("double") for c in columns]
    finite = [F.when(F.abs(v) < float("inf"), v) for v in value]
    mean = np.array([x or 0.0 for x in df.agg(*(F.avg(v) for v in finite)).first()])  # d figures
    upper = np.triu_indices(d, 1)

    def run(batches):
        n, sx, sy, sxx, syy, sxy = (np.zeros(len(upper[0])) for _ in range(6))
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.slice(at, 8192)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns]) - mean
                held = ~np.isnan(x)
                x, held = np.where(held, x, 0.0), held.astype(np.float64)
                both, first, square, cross = held.T @ held, x.T @ held, (x * x).T @ held, x.T @ x
                for total, matrix in ((n, both), (sx, first), (sy, first.T), (sxx, square), (syy, square.T), (sxy, cross)):
                    total += matrix[upper]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*upper, n, sx, sy, sxx, syy, sxy)], names=["i", "j", *names])

    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = df.select(*(v.alias(f"c{k}") for k, v in enumerate(finite))).mapInArrow(run, "i long, j long, " + ", ".join(f"{x} double" for x in names))
    total = parts.groupBy("i", "j").agg(*(F.sum(x).alias(x) for x in names))
    spread = {s: F.col("n") * F.col(f"s{s}{s}") - F.col(f"s{s}") * F.col(f"s{s}") for s in "xy"}
    least = {s: F.when(spread[s] > 1e-12 * F.col("n") * F.col(f"s{s}{s}"), spread[s]) for s in "xy"}
    return total.select("i", "j", ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(least["x"]) * F.sqrt(least["y"]))).alias("corr"))


def correlation_similarity(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr_real, corr_synth, score) of every pair of the columns, in their order. Pairs without a correlation on a side have a null score."""
    if len(columns) < 2:
        return real.sparkSession.createDataFrame([], "a string, b string, corr_real double, corr_synth double, score double")
    name = F.array(*map(F.lit, columns))
    pairs = correlations(real, columns).withColumnRenamed("corr", "corr_real").join(correlations(synth, columns).withColumnRenamed("corr", "corr_synth"), ["i", "j"])
    at = lambda k: F.get(name, F.col(k).cast("int"))
    return pairs.select(at("i").alias("a"), at("j").alias("b"), "corr_real", "corr_synth", (1 - F.abs(F.col("corr_real") - F.col("corr_synth")) / 2).alias("score"))


def contingency_similarity(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, score): 1 - total variation of the pair's joint distribution; null is a value like others. A side without rows has no pairs.

    Equal rows are counted before they are taken apart into pairs, so tables of few different rows send each once; the pairs' cells are
    counted in each task before the shuffle."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return real.sparkSession.createDataFrame([], "a string, b string, score double")

    def side(df: DataFrame, r: int) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns)), F.lit(r).alias("r"))

    keys = [f"c{k}" for k in range(len(columns))]
    counted = side(real, 1).unionByName(side(synth, 0)).groupBy(*keys).agg(F.sum("r").alias("n_real"), F.sum(1 - F.col("r")).alias("n_synth"))
    place = {c: k for k, c in enumerate(columns)}
    cells = F.array(*(F.struct(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")).alias("column"), F.col(f"c{place[x]}").alias("x"), F.col(f"c{place[y]}").alias("y")) for x, y in pairs))
    long = counted.select(F.explode(cells).alias("c"), "n_real", "n_synth").select("c.*", "n_real", "n_synth")
    freq = long.groupBy("column", "x", "y").agg(F.sum("n_real").alias("n_real"), F.sum("n_synth").alias("n_synth"))
    return category_distances(freq).select("column.a", "column.b", F.col("tv_score").alias("score"))


def new_rows(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(n_synth, n_new, score): the share of synthetic rows that no real row equals; null equals null."""
    on = [real.select(*columns).distinct().alias("r"), synth.select(*columns).alias("s")]
    same = None
    for c in columns:
        e = F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
        same = e if same is None else same & e
    hit = on[1].join(on[0].withColumn("__hit", F.lit(1)), same, "left")
    return hit.agg(F.count(F.lit(1)).alias("n_synth"), F.count_if(F.col("__hit").isNull()).alias("n_new")).withColumn("score", F.try_divide(F.col("n_new"), F.col("n_synth")))


def logistic_detection(real: DataFrame, synth: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """(auc, score): how badly a logistic regression on two thirds of the rows tells the rest of both sides apart, the mean of three folds.

    Rows with a null take no part; both figures are null if a side has no other row in one of the folds."""
    both = real.select(*columns, F.lit(1.0).alias("label")).unionByName(synth.select(*columns, F.lit(0.0).alias("label"))).dropna()
    fold = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(3)).alias("fold")
    if both.select("label", fold).distinct().count() < 6:
        return real.sparkSession.createDataFrame([(None, None)], "auc double, score double")
    counted = materialised(both.groupBy(*(F.col(f"`{c}`") for c in columns), "label").agg(F.count(F.lit(1)).cast("double").alias("__weight")))  # equal rows are fitted as one that weighs as much
    ready = FeatureHasher(inputCols=columns, outputCol="features", numFeatures=1 << 12).transform(counted).select("features", "label", fold, "__weight")
    folds = [(ready.where(F.col("fold") != k), ready.where(F.col("fold") == k)) for k in range(3)]
    auc = sum(BinaryClassificationEvaluator(weightCol="__weight").evaluate(LogisticRegression(maxIter=20, regParam=0.01, weightCol="__weight").fit(rest).transform(own)) for rest, own in folds) / 3
    return real.sparkSession.createDataFrame([(auc, 1 - (2 * max(0.5, auc) - 1))], "auc double, score double")


def quality_report(real: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str], threshold: float = 0.82) -> DataFrame:
    """(category, score, metrics, passed) for column shapes, pair trends and the overall score, which is the mean of both."""
    shapes = marginals(real, synth, numeric, categorical).where("metric IN ('ks_complement', 'tv_complement')").select(F.lit("column_shapes").alias("category"), "score")
    trends = correlation_similarity(real, synth, numeric).select("score").unionByName(contingency_similarity(real, synth, categorical).select("score")).select(F.lit("pair_trends").alias("category"), "score")
    parts = shapes.unionByName(trends).groupBy("category").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"), F.count("score").alias("metrics"))
    whole = parts.agg(F.lit("overall").alias("category"), F.avg("score").alias("score"), F.sum("metrics").alias("metrics"))
    return parts.unionByName(whole).withColumn("passed", F.col("score") >= threshold)
