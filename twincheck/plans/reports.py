"""Queries over job reports and single tests. A job is a supplier's order lines: even orders are the real side, odd ones the synthetic one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequency as fq
from ..operators import reports, statistics
from .tabular import _P_VALUE, _SIDES, CATEGORICAL, NUMERIC, _categories, _numeric_sql, lineitems, rounded

COLUMNS, RECORD = ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity", "l_discount", "l_returnflag"]
METRICS = (["ks_score", "wasserstein_score", "kl_score", "statistics_score"], ["tv_distance", "js_divergence", "coverage"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.job_scores(_lines(spark, sf_dir), "l_suppkey", F.col("l_orderkey") % 2 == 1, COLUMNS, RECORD)
    owners = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("tenant_id"))
    return found.join(owners, F.col("job_id") == F.col("s_suppkey")).select("job_id", "tenant_id", F.lit("1998-12-01").alias("validated_at"), F.lit(None).cast("string").alias("certificate"), "fidelity", "privacy", "memorization")


def job_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_jobs(spark, sf_dir).select("job_id", "tenant_id", "fidelity", "privacy", "memorization"))


def regulatory_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.statements(_jobs(spark, sf_dir))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.column_likeness(_lines(spark, sf_dir), "l_suppkey", F.col("l_orderkey") % 2 == 1, COLUMNS)
    return reports.report_lines(found.select("job_id", F.col("column").alias("metric"), F.round("score", 9).alias("score")))


def column_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = lineitems(spark, sf_dir)
    return rounded(reports.breakdown(fq.numeric_scores(*sides, NUMERIC), fq.categorical_scores(*sides, CATEGORICAL), METRICS), 5)


def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.column_likeness(_lines(spark, sf_dir), "l_suppkey", F.col("l_orderkey") % 2 == 1, COLUMNS)
    return rounded(reports.chart(found.select(F.col("column").alias("category"), F.round("score", 9).alias("score"))))


def ks_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.ks_only(*lineitems(spark, sf_dir), NUMERIC), 5)


def chi2_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.chi2_only(*lineitems(spark, sf_dir), ["l_returnflag", "l_linenumber"]), 5)


QUERIES = {f.__name__: f for f in (job_scores, regulatory_statements, report_lines, column_breakdown, chart_rows, ks_only, chi2_only)}

_CELLS = " UNION ALL ".join(f"SELECT l_suppkey AS job_id, l_orderkey % 2 AS s, '{c}' AS \"column\", {c}::VARCHAR AS v FROM lineitem" for c in COLUMNS)
_LIKE = f"""cells AS ({_CELLS}), counts AS (SELECT job_id, "column", v, count_if(s = 0) AS a, count_if(s = 1) AS b FROM cells GROUP BY ALL),
    likes AS (SELECT job_id, "column", CASE WHEN n > 0 AND m > 0 THEN 1 - sum(abs(a / n - b / m)) / 2 END AS score FROM (SELECT *, sum(a) OVER p AS n, sum(b) OVER p AS m FROM counts WINDOW p AS (PARTITION BY job_id, "column")) GROUP BY job_id, "column", n, m)"""
_JOBS = f"""{_LIKE}, records AS (SELECT l_suppkey AS job_id, count_if(l_orderkey % 2 = 0) AS a, count_if(l_orderkey % 2 = 1) AS b FROM lineitem GROUP BY l_suppkey, {', '.join(RECORD)}),
    risks AS (SELECT job_id, coalesce(sum(b) FILTER (a > 0), 0) / nullif(sum(b), 0) AS held, coalesce(sum(b) FILTER (a = 1), 0) / nullif(sum(b), 0) AS single FROM records GROUP BY job_id),
    jobs AS (SELECT job_id, s_nationkey AS tenant_id, coalesce(f, 0) AS fidelity, 1 - coalesce(single, 1) AS privacy, coalesce(held, 1) AS memorization
        FROM (SELECT job_id, avg(score) AS f FROM likes GROUP BY job_id) JOIN risks USING (job_id) JOIN supplier ON s_suppkey = job_id)"""
_SHOWN = "round({c}, 4)::DECIMAL(12, 4)::VARCHAR"


def _filled(template: str) -> str:
    """The template in nested replacements."""
    out = "'" + template.replace("'", "''") + "'"
    values = {"job_id": "job_id::VARCHAR", "tenant_id": "tenant_id::VARCHAR", "validated_at": "'1998-12-01'", "certificate": "''", "passed": "(f AND p AND m)::VARCHAR", "fidelity_passed": "f::VARCHAR", "privacy_passed": "p::VARCHAR", "memorization_passed": "m::VARCHAR"}
    for name, value in (values | {c: _SHOWN.format(c=c) for c in ("fidelity", "privacy", "memorization")}).items():
        out = f"replace({out}, '{{{{ {name} }}}}', {value})"
    return out


_EVEN = "exp(-chi2 / 2) * list_sum(list_transform(range(dof // 2), lambda i: power(chi2 / 2, i) / factorial(i::INT)))"

ORACLES = {
    "job_scores": f"WITH {_JOBS} SELECT job_id, tenant_id, round(fidelity, 6) AS fidelity, round(privacy, 6) AS privacy, round(memorization, 6) AS memorization FROM jobs",
    "regulatory_statements": f"WITH {_JOBS}, judged AS (SELECT *, fidelity >= 0.75 AS f, privacy >= 0.8 AS p, memorization <= 0.1 AS m FROM jobs) " + " UNION ALL ".join(f"SELECT job_id, '{s}' AS standard, f AND p AND m AS passed, {_filled(t)} AS report FROM judged" for s, t in reports.TEMPLATES.items()),
    "report_lines": f"""WITH {_LIKE}, r AS (SELECT job_id, "column" AS metric, round(score, 9) AS score FROM likes)
        SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY score NULLS FIRST, metric) + 2)::INT AS line, rpad(metric, 32, ' ') || coalesce({_SHOWN.format(c='score')}, 'missing') || CASE WHEN score >= 0.75 THEN '  PASS' ELSE '  FAIL' END AS text FROM r
        UNION ALL SELECT DISTINCT job_id, 1, 'Validation report of job ' || job_id FROM r
        UNION ALL SELECT job_id, 2, count_if(coalesce(score >= 0.75, false)) || ' of ' || count(*) || ' metrics reached' FROM r GROUP BY job_id""",
    "column_breakdown": _numeric_sql(_SIDES, NUMERIC, f""", {_categories(CATEGORICAL)},
        found AS (SELECT "column", 'numeric' AS kind, ks_score, w_score AS wasserstein_score, kl_score, st_score AS statistics_score, NULL::DOUBLE AS tv_distance, NULL::DOUBLE AS js_divergence, NULL::DOUBLE AS coverage, column_score FROM num
            UNION ALL SELECT "column", 'categorical', NULL, NULL, NULL, NULL, tv, cjs, cov, column_score FROM cats)
        SELECT (row_number() OVER (ORDER BY column_score, "column"))::INT AS place, "column", kind, {', '.join(f'round({c}, 5) AS {c}' for c in METRICS[0] + METRICS[1] + ['column_score'])} FROM found"""),
    "chart_rows": f"""WITH {_LIKE}, r AS (SELECT "column" AS category, round(score, 9) AS score FROM likes WHERE score IS NOT NULL)
        SELECT 'category' AS part, category AS label, NULL::DOUBLE AS low, NULL::DOUBLE AS high, round(avg(score), 6) AS value FROM r GROUP BY category
        UNION ALL SELECT 'histogram', printf('%02d', b), b / 10, (b + 1) / 10, (SELECT count(*) FROM r WHERE least(floor(score * 10), 9) = b)::DOUBLE FROM range(10) t(b)
        UNION ALL SELECT 'figure', unnest(['total', 'mean', 'least', 'greatest']), NULL, NULL, unnest([count(*)::DOUBLE, round(avg(score), 6), round(min(score), 6), round(max(score), 6)]) FROM r""",
    "ks_only": _numeric_sql(_SIDES, NUMERIC, f'SELECT "column", round(ks, 5) AS ks, round({_P_VALUE}, 5) AS ks_pvalue FROM num'),
    "chi2_only": f"WITH {_SIDES}, {_categories(['l_returnflag', 'l_linenumber'])} SELECT \"column\", round(chi2, 5) AS chi2, dof, round({_EVEN}, 5) AS chi2_pvalue FROM cats",
}
