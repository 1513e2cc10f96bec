"""Queries over column metrics, tests and similarity, each with DuckDB SQL that computes the same from the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequency as fq
from ..operators import governance, similarity, statistics
from ..sources import datasets

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def lineitems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.where("l_orderkey % 2 = 0"), df.where("l_orderkey % 2 = 1")


def distorted_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even orders, and odd ones with dearer prices and a missing priority."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return df.where("o_orderkey % 2 = 0"), df.where("o_orderkey % 2 = 1 AND o_orderpriority <> '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") * 1.1)


def ks_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fq.numeric_scores(*lineitems(spark, sf_dir), NUMERIC)
    return rounded(found.select("column", "n_real", "n_synth", "ks", "wasserstein", "wasserstein_score", "ks_score", "boundary_adherence"))


def ks_distorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fq.numeric_scores(*distorted_orders(spark, sf_dir), ["o_totalprice"])
    return rounded(found.select("column", "n_real", "n_synth", "ks", "ks_pvalue", "wasserstein_score", "boundary_adherence"), 5)


def moments_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fq.numeric_scores(*lineitems(spark, sf_dir), NUMERIC)
    return rounded(found.select("column", "mean_real", "mean_synth", "std_real", "std_synth", "q10_real", "q25_real", "q50_real", "q75_real", "q90_real", "q50_synth"), 4)


def histogram_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = fq.materialised(fq.frequency(*distorted_orders(spark, sf_dir), ["o_totalprice"]))
    return rounded(fq.divergence(fq.histogram(freq)), 6)


def column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fq.numeric_scores(*lineitems(spark, sf_dir), NUMERIC)
    return rounded(found.select("column", "wasserstein_score", "kl_score", "statistics_score", "ks_score", "quantile_similarity", "column_score"), 5)


def categorical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fq.categorical_scores(*lineitems(spark, sf_dir), CATEGORICAL)
    return rounded(found.select("column", "tv_distance", "js_divergence", "coverage", "adherence", "unique_real", "unique_synth", "chi2", "dof", "column_score"))


def categorical_distorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fq.categorical_scores(*distorted_orders(spark, sf_dir), ["o_orderpriority"])
    return rounded(found.select("column", "tv_distance", "js_divergence", "coverage", "adherence", "unique_real", "unique_synth", "chi2", "dof", "column_score"), 5)


def table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = lineitems(spark, sf_dir)
    scores = fq.numeric_scores(*sides, NUMERIC).select("column_score").unionByName(fq.categorical_scores(*sides, CATEGORICAL).select("column_score"))
    return rounded(scores.agg(F.count(F.lit(1)).alias("columns"), F.coalesce(F.avg("column_score"), F.lit(0.0)).alias("overall_score")), 5)


def anderson_darling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.numeric_tests(*lineitems(spark, sf_dir), NUMERIC).select("column", "n_real", "n_synth", "anderson_darling"), 4)


def statistical_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.suite(*lineitems(spark, sf_dir), NUMERIC, CATEGORICAL)


def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.correlation_similarity(*lineitems(spark, sf_dir), NUMERIC))


def contingency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.contingency_similarity(*lineitems(spark, sf_dir), CATEGORICAL))


def new_row_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.new_rows(*part_sides(spark, sf_dir), ["p_brand", "p_type", "p_size"]))


def part_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.where("p_partkey % 2 = 0"), df.where("p_partkey % 2 = 1")


def logistic_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.logistic_detection(*distorted_orders(spark, sf_dir), ["o_totalprice", "o_orderstatus", "o_orderpriority"])


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.quality_report(*lineitems(spark, sf_dir), NUMERIC, CATEGORICAL), 5)


def worst_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = lineitems(spark, sf_dir)
    scores = fq.numeric_scores(*sides, NUMERIC).select("column", "column_score").unionByName(fq.categorical_scores(*sides, CATEGORICAL).select("column", "column_score"))
    return rounded(governance.worst_columns(scores), 5)


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, fidelity): mean of KS and TV complements per level, on generated data."""
    real, out = datasets.calibration_real(spark, 2000), None
    for level in datasets.LEVELS:
        synth = datasets.calibration_synthetic(spark, level)
        parts = fq.numeric_scores(real, synth, ["age", "income", "score"]).select(F.col("ks_score").alias("s")).unionByName(fq.categorical_scores(real, synth, ["category"]).select(F.col("tv_score").alias("s")))
        one = parts.agg(F.lit(level).alias("level"), F.avg("s").alias("fidelity"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (ks_wasserstein, ks_distorted, moments_quantiles, histogram_divergence, column_scores, categorical_columns, categorical_distorted, table_score, anderson_darling, statistical_suite, correlation_pairs, contingency_pairs, new_row_synthesis, logistic_detection, quality_report, worst_columns, calibration)}

_SIDES = "real AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0), synth AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)"
_ORDERS = "real AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), synth AS (SELECT * REPLACE (o_totalprice * 1.1 AS o_totalprice) FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority <> '1-URGENT')"


def _numeric_sql(sides: str, columns: list[str], result: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS v, {r} AS r, {1 - r} AS s FROM {t}" for c in columns for t, r in (("real", 1), ("synth", 0)))
    return f"""WITH {sides},
        cells AS ({long}),
        freq AS (SELECT "column", v, sum(r) AS a, sum(s) AS b FROM cells WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL),
        cum AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS n, sum(b) OVER p AS m, lead(v) OVER (PARTITION BY "column" ORDER BY v) AS nxt FROM freq WINDOW w AS (PARTITION BY "column" ORDER BY v), p AS (PARTITION BY "column")),
        shape AS (SELECT "column", n::BIGINT AS n_real, m::BIGINT AS n_synth, max(abs(ca / n - cb / m)) AS ks, sum(abs(ca / n - cb / m) * coalesce(nxt - v, 0)) AS w1,
            sum(CASE WHEN (ca + cb - (a + b) / 2) * ((n + m) - (ca + cb - (a + b) / 2)) - (n + m) * (a + b) / 4 > 0 THEN (a + b) / (n + m) * (power((n + m) * (ca - a / 2) - n * (ca + cb - (a + b) / 2), 2) / n + power((n + m) * (cb - b / 2) - m * (ca + cb - (a + b) / 2), 2) / m) / ((ca + cb - (a + b) / 2) * ((n + m) - (ca + cb - (a + b) / 2)) - (n + m) * (a + b) / 4) ELSE 0 END) * (n + m - 1) / (n + m) AS a2
            FROM cum GROUP BY "column", n, m),
        stat AS (SELECT "column", avg(v) FILTER (r = 1) AS mr, avg(v) FILTER (r = 0) AS ms, stddev_pop(v) FILTER (r = 1) AS sr, stddev_pop(v) FILTER (r = 0) AS ss, min(v) FILTER (r = 1) AS lo, max(v) FILTER (r = 1) AS hi, min(v) AS jlo, max(v) AS jhi,
            quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) FILTER (r = 1) AS qr, quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) FILTER (r = 0) AS qs, kurtosis_pop(v) FILTER (r = 1) AS kr, kurtosis_pop(v) FILTER (r = 0) AS ksn FROM cells GROUP BY "column"),
        third AS (SELECT c."column", avg(power(v - mr, 3)) FILTER (r = 1) / power(any_value(sr), 3) AS skr, avg(power(v - ms, 3)) FILTER (r = 0) / power(any_value(ss), 3) AS sks, avg((v BETWEEN lo AND hi)::DOUBLE) FILTER (r = 0) AS inside FROM cells c JOIN stat USING ("column") GROUP BY c."column"),
        binned AS (SELECT f."column", least(floor((v - jlo) / ((jhi - jlo) / 50)), 49)::INT AS bin, sum(a) AS a, sum(b) AS b FROM freq f JOIN stat USING ("column") GROUP BY ALL),
        grid AS (SELECT "column", bin, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT "column", unnest(range(50))::INT AS bin FROM stat) LEFT JOIN binned USING ("column", bin)),
        share AS (SELECT "column", (a + 1e-10) / (sum(a) OVER p + 50e-10) AS p, (b + 1e-10) / (sum(b) OVER p + 50e-10) AS q FROM grid WINDOW p AS (PARTITION BY "column")),
        div AS (SELECT "column", sum(p * ln(p / q)) AS kl, 0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))) AS js FROM share GROUP BY "column"),
        scores AS (SELECT *, greatest(0, 1 - w1 / (hi - lo)) AS w_score, 1 - least(1, greatest(0, kl / 10)) AS kl_score, 1 - ks AS ks_score,
            0.35 * (1 - least(1, abs(mr - ms) / (sr + 1e-8))) + 0.35 * (1 - least(1, abs(sr - ss) / (sr + 1e-8))) + 0.15 * (1 - least(1, abs(skr - sks) / 5)) + 0.15 * (1 - least(1, abs(kr - ksn) / 10)) AS st_score,
            1 - list_avg(list_transform(range(1, 6), lambda i: least(1, abs(qr[i] - qs[i]) / (abs(qr[i]) + 1e-8)))) AS q_score
            FROM shape JOIN stat USING ("column") JOIN third USING ("column") JOIN div USING ("column")),
        num AS (SELECT *, 0.35 * w_score + 0.25 * kl_score + 0.25 * st_score + 0.15 * ks_score AS column_score FROM scores)
        {result}"""


def _categories(columns: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS v, {r} AS r FROM {t}" for c in columns for t, r in (("real", 1), ("synth", 0)))
    return f"""ccells AS ({long}),
        cfreq AS (SELECT "column", v, sum(r) AS a, sum(1 - r) AS b FROM ccells WHERE v IS NOT NULL GROUP BY ALL),
        ctot AS (SELECT *, sum(a) OVER p AS n, sum(b) OVER p AS m, count(*) OVER p AS k FROM cfreq WINDOW p AS (PARTITION BY "column")),
        cs AS (SELECT *, (a / n + 1e-10) / (1 + k * 1e-10) AS p, (b / m + 1e-10) / (1 + k * 1e-10) AS q, (a + b) * n / (n + m) AS ea, (a + b) * m / (n + m) AS eb FROM ctot),
        cat AS (SELECT "column", 0.5 * sum(abs(a / n - b / m)) AS tv, 0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))) AS cjs, count_if(a > 0) AS ur, count_if(b > 0) AS us, count_if(a > 0 AND b > 0) / count_if(a > 0) AS cov, sum(CASE WHEN a > 0 THEN b ELSE 0 END) / any_value(m) AS adh,
            sum(power(CASE WHEN k = 2 THEN greatest(0, abs(a - ea) - 0.5) ELSE abs(a - ea) END, 2) / ea + power(CASE WHEN k = 2 THEN greatest(0, abs(b - eb) - 0.5) ELSE abs(b - eb) END, 2) / eb) AS chi2, any_value(k) - 1 AS dof FROM cs GROUP BY "column"),
        cats AS (SELECT *, 0.4 * (1 - tv) + 0.4 * (1 - least(1, cjs)) + 0.2 * cov AS column_score FROM cat)"""


_CAT_RESULT = 'SELECT "column", round(tv, {d}) AS tv_distance, round(cjs, {d}) AS js_divergence, round(cov, {d}) AS coverage, round(adh, {d}) AS adherence, ur::BIGINT AS unique_real, us::BIGINT AS unique_synth, round(chi2, {d}) AS chi2, dof, round(column_score, {d}) AS column_score FROM cats'
_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (SELECT corr({a}, {b}) FROM real) AS x, (SELECT corr({a}, {b}) FROM synth) AS y" for a, b in _PAIRS)
_CONT = "SELECT 0.5 * sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))) AS tv FROM (SELECT l_returnflag, l_linestatus, count(*) / (SELECT count(*) FROM real) AS p FROM real GROUP BY ALL) x FULL JOIN (SELECT l_returnflag, l_linestatus, count(*) / (SELECT count(*) FROM synth) AS p FROM synth GROUP BY ALL) y USING (l_returnflag, l_linestatus)"
_P_VALUE = "CASE WHEN {t} < 0.03 THEN 1.0 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * {t}))))) END".format(t="(n_real::DOUBLE * n_synth / (n_real + n_synth) * ks * ks)")

ORACLES = {
    "ks_wasserstein": _numeric_sql(_SIDES, NUMERIC, 'SELECT "column", n_real, n_synth, round(ks, 6) AS ks, round(w1, 6) AS wasserstein, round(w_score, 6) AS wasserstein_score, round(ks_score, 6) AS ks_score, round(inside, 6) AS boundary_adherence FROM num'),
    "ks_distorted": _numeric_sql(_ORDERS, ["o_totalprice"], f'SELECT "column", n_real, n_synth, round(ks, 5) AS ks, round({_P_VALUE}, 5) AS ks_pvalue, round(w_score, 5) AS wasserstein_score, round(inside, 5) AS boundary_adherence FROM num'),
    "moments_quantiles": _numeric_sql(_SIDES, NUMERIC, 'SELECT "column", round(mr, 4) AS mean_real, round(ms, 4) AS mean_synth, round(sr, 4) AS std_real, round(ss, 4) AS std_synth, round(qr[1], 4) AS q10_real, round(qr[2], 4) AS q25_real, round(qr[3], 4) AS q50_real, round(qr[4], 4) AS q75_real, round(qr[5], 4) AS q90_real, round(qs[3], 4) AS q50_synth FROM num'),
    "histogram_divergence": _numeric_sql(_ORDERS, ["o_totalprice"], 'SELECT "column", round(kl, 6) AS kl, round(js, 6) AS js FROM num'),
    "column_scores": _numeric_sql(_SIDES, NUMERIC, 'SELECT "column", round(w_score, 5) AS wasserstein_score, round(kl_score, 5) AS kl_score, round(st_score, 5) AS statistics_score, round(ks_score, 5) AS ks_score, round(q_score, 5) AS quantile_similarity, round(column_score, 5) AS column_score FROM num'),
    "categorical_columns": f"WITH {_SIDES}, {_categories(CATEGORICAL)} {_CAT_RESULT.format(d=6)}",
    "categorical_distorted": f"WITH {_ORDERS}, {_categories(['o_orderpriority'])} {_CAT_RESULT.format(d=5)}",
    "table_score": _numeric_sql(_SIDES, NUMERIC, f', {_categories(CATEGORICAL)} SELECT count(*) AS columns, round(avg(column_score), 5) AS overall_score FROM (SELECT column_score FROM num UNION ALL SELECT column_score FROM cats)'),
    "anderson_darling": _numeric_sql(_SIDES, NUMERIC, 'SELECT "column", n_real, n_synth, round(a2, 4) AS anderson_darling FROM num'),
    "correlation_pairs": f"WITH {_SIDES} SELECT a, b, round(x, 6) AS corr_real, round(y, 6) AS corr_synth, round(1 - abs(x - y) / 2, 6) AS score FROM ({_CORR})",
    "contingency_pairs": f"WITH {_SIDES} SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, round(1 - tv, 6) AS score FROM ({_CONT})",
    "new_row_synthesis": """WITH r AS (SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 1)
        SELECT count(*) AS n_synth, count_if(NOT hit)::BIGINT AS n_new, round(count_if(NOT hit) / count(*), 6) AS score FROM (SELECT EXISTS (SELECT 1 FROM r WHERE r.p_brand IS NOT DISTINCT FROM s.p_brand AND r.p_type IS NOT DISTINCT FROM s.p_type AND r.p_size IS NOT DISTINCT FROM s.p_size) AS hit FROM s)""",
    "quality_report": _numeric_sql(_SIDES, NUMERIC, f""", {_categories(CATEGORICAL)},
        items AS (SELECT 'column_shapes' AS category, ks_score AS s FROM num UNION ALL SELECT 'column_shapes', 1 - tv FROM cats UNION ALL SELECT 'pair_trends', 1 - abs(x - y) / 2 FROM ({_CORR}) UNION ALL SELECT 'pair_trends', 1 - tv FROM ({_CONT})),
        parts AS (SELECT category, avg(s) AS score, count(s) AS metrics FROM items GROUP BY category)
        SELECT category, round(score, 5) AS score, metrics::BIGINT AS metrics, score >= 0.82 AS passed FROM (FROM parts UNION ALL SELECT 'overall', avg(score), sum(metrics) FROM parts)"""),
    "worst_columns": _numeric_sql(_SIDES, NUMERIC, f', {_categories(CATEGORICAL)} SELECT "column", round(column_score, 5) AS score FROM (SELECT "column", column_score FROM num UNION ALL SELECT "column", column_score FROM cats) ORDER BY column_score, "column" LIMIT 20'),
}
