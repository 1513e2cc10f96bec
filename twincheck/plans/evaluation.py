"""Queries over whole evaluations: two datasets by their schemas, clinical columns by their names, and the calibration's flags."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clinical, evaluation, health
from ..operators import overall as ov
from .tabular import _ORDERS, _categories, _numeric_sql, distorted_orders, lineitems, rounded

_LEVELS = list(ov.EXPECTED)


def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic side lacks a column, has another of its own, and one is null throughout."""
    real, synth = distorted_orders(spark, sf_dir)
    real = real.select("o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey").withColumn("discount", F.lit(0.1))
    return rounded(evaluation.evaluate(real, synth.select("o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderkey").withColumn("discount", F.lit(None).cast("double"))), 5)


_LINES = ["l_quantity", "l_discount", "l_shipdate", "l_returnflag", "l_linestatus"]


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    real, synth = lineitems(spark, sf_dir)
    return real.select(*_LINES, "l_tax"), synth.select(*_LINES)


def evaluate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.evaluate_all(*_lines(spark, sf_dir)), 5)


def evaluation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the detection, which SQL can't express; the synthetic side lacks a column."""
    return rounded(evaluation.evaluate_all(*_lines(spark, sf_dir), detect=False), 5)


def lab_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rounded(health.labs(df.select((F.col("c_acctbal") / 10).alias("Glucose_mg_dl_value"), (F.col("c_nationkey") * 12).alias("pulse"), F.lit("none").alias("bmi")), {"pulse": "heart_rate_bpm"}))


def medication_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    drug = F.when(F.col("c_mktsegment") == "BUILDING", "Warfarin 5 mg").when(F.col("c_mktsegment") == "MACHINERY", "low-dose aspirin").otherwise(F.col("c_mktsegment"))
    return rounded(health.medication_safety(df.select(F.floor(F.col("c_custkey") / 2).alias("patient_id"), drug.alias("medication_name"))))


#: A patient record of each customer, as expressions that Spark and DuckDB read alike.
_RECORD = {
    "age_years": "c_nationkey * 6",
    "systolic_bp_mmhg": "c_acctbal / 50 + 60",
    "diastolic_bp_mmhg": "CAST(70 + c_nationkey AS DOUBLE)",
    "glucose_mg_dl": "c_acctbal / 10",
    "diagnosis_code": "CASE WHEN c_nationkey % 4 = 0 THEN 'e11.9' WHEN c_nationkey % 4 = 1 THEN ' I10 ' WHEN c_nationkey % 4 = 2 THEN 'J45.909' ELSE 'none' END",
    "procedure_code": "CASE WHEN c_nationkey = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN '99213' WHEN c_nationkey % 3 = 1 THEN '00042T' ELSE '0042T' END",
    "drug": "CASE c_mktsegment WHEN 'BUILDING' THEN 'Warfarin 5 mg' WHEN 'MACHINERY' THEN 'low-dose aspirin' ELSE c_mktsegment END",
    "patient_id": "CAST(floor(c_custkey / 60) AS BIGINT)",
}
_BUNDLE = """'{"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "' || c_custkey || '"}}, {"resource": {"resourceType": "Encounter", "id": 1, ' || CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE '"status": "done", ' END || '"subject": {}}}]}'"""


def _patients(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Customers of even or odd key as patients."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") % 2 == k)
    return df.select(*(F.expr(e).alias(c) for c, e in _RECORD.items()), F.expr(_BUNDLE).alias("bundle"))


def healthcare(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth = (_patients(spark, sf_dir, k).drop("bundle") for k in (0, 1))
    return rounded(clinical.healthcare(real, synth), 5)


def healthcare_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With FHIR bundles, every fifth nation's encounters of which lack a field."""
    real, synth = (_patients(spark, sf_dir, k) for k in (0, 1))
    return rounded(clinical.healthcare(real.drop("bundle"), synth.drop("bundle"), bundles=synth.select("bundle")), 5)


def calibration_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average discounts by line number stand in for the levels' fidelity."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 5")
    one = df.groupBy("l_linenumber").agg((F.avg(F.col("l_discount").cast("double")) * 3.6 * F.first("l_linenumber")).alias("fidelity"))
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), F.col("l_linenumber").cast("int"))
    return rounded(ov.calibrated(one.select(level.alias("level"), "fidelity")))


QUERIES = {f.__name__: f for f in (evaluate, evaluate_all, evaluation_parts, lab_values, medication_safety, healthcare, healthcare_bundles, calibration_flags)}

_BOUNDS = ", ".join(f"({k + 1}, '{level}', {low:.2f}::DOUBLE, {high:.2f}::DOUBLE)" for k, (level, (low, high)) in enumerate(ov.EXPECTED.items()))

_TIMES = ", ".join(f"{name} AS (SELECT * REPLACE (epoch_us(l_shipdate) AS l_shipdate) FROM lineitem WHERE l_orderkey % 2 = {k})" for k, name in enumerate(("real", "synth")))
_NUMBERS, _TEXTS = _LINES[:3], _LINES[3:]
_CORRELATED = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, 1 - abs((SELECT corr({a}, {b}) FROM real) - (SELECT corr({a}, {b}) FROM synth)) / 2 AS s" for a, b in combinations(_NUMBERS, 2)
)
_SAME = " AND ".join(f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in _LINES)

_RECORDS = ", ".join(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _RECORD.items())}, c_nationkey FROM customer WHERE c_custkey % 2 = {k})" for k, name in enumerate(("real", "synth")))


def _healthcare_sql(fhir: bool) -> str:
    weights = ov.WEIGHTS["healthcare_with_bundles" if fhir else "healthcare"]
    bundles = "UNION ALL SELECT 'fhir', 'fhir_validation', 1 - count_if(c_nationkey % 5 = 0) / (2 * count(*)) FROM synth" if fhir else ""
    share = " UNION ALL ".join(f"SELECT '{lab}' AS lab, avg(({c} BETWEEN {low} AND {high})::DOUBLE) AS s FROM synth" for lab in _RECORD if lab in health.LAB_BOUNDS for c, (low, high) in [(lab, health.LAB_BOUNDS[lab])])
    return _numeric_sql(
        _RECORDS,
        ["age_years", "systolic_bp_mmhg", "diastolic_bp_mmhg", "glucose_mg_dl", "patient_id"],
        f""", first AS (SELECT left(diagnosis_code, 1) AS p, 1 AS r FROM real UNION ALL SELECT left(diagnosis_code, 1), 0 FROM synth),
        letters AS (SELECT sum(r) AS a, sum(1 - r) AS b FROM first WHERE p IS NOT NULL GROUP BY p),
        pairs AS (SELECT patient_id, bool_or(drug LIKE '%Warfarin%') AND bool_or(drug LIKE '%aspirin%') AS hit FROM synth GROUP BY patient_id),
        per(part, "check", score) AS (
            SELECT 'clinical', 'age_plausibility', avg((age_years BETWEEN 0 AND 120)::DOUBLE) FROM synth
            UNION ALL SELECT 'clinical', 'systolic_above_diastolic', avg((systolic_bp_mmhg > diastolic_bp_mmhg)::DOUBLE) FROM synth
            UNION ALL SELECT 'clinical', 'distribution_similarity', avg(ks_score) FROM num
            UNION ALL SELECT 'codes', 'icd10_validity', avg((diagnosis_code <> 'none')::DOUBLE) FROM synth
            UNION ALL SELECT 'codes', 'icd10_prefixes', 1 - 0.5 * sum(abs(a / (SELECT count(*) FROM real) - b / (SELECT count(*) FROM synth))) FROM letters
            UNION ALL SELECT 'codes', 'cpt_validity', avg(regexp_full_match(procedure_code, '[0-9]{{5}}[FUMT]?')::DOUBLE) FROM synth
            UNION ALL SELECT 'labs', 'lab_plausibility', avg(s) FROM ({share})
            UNION ALL SELECT 'medication', 'medication_safety', greatest(0, 1 - 10 * count_if(hit) / count(*)) FROM pairs {bundles}),
        means AS (SELECT part, avg(score) AS score FROM per GROUP BY part),
        w(part, w) AS (VALUES {", ".join(f"('{p}', {x}::DOUBLE)" for p, x in weights.items())})
        SELECT part, "check", round(score, 5) AS score FROM per UNION ALL SELECT part, 'score', round(score, 5) FROM means
        UNION ALL SELECT 'overall', 'score', round(sum(w * score), 5) FROM means JOIN w USING (part)""",
    )


ORACLES = {
    "healthcare": _healthcare_sql(False),
    "healthcare_bundles": _healthcare_sql(True),
    "evaluation_parts": _numeric_sql(
        _TIMES,
        _NUMBERS,
        f""", {_categories(_TEXTS)},
        cell AS (SELECT l_returnflag AS x, l_linestatus AS y, 1 AS r FROM real UNION ALL SELECT l_returnflag, l_linestatus, 0 FROM synth),
        joint AS (SELECT 1 - 0.5 * sum(abs(a / (SELECT count(*) FROM real) - b / (SELECT count(*) FROM synth))) AS s FROM (SELECT sum(r) AS a, sum(1 - r) AS b FROM cell GROUP BY x, y)),
        new AS (SELECT count_if(NOT hit) / count(*) AS s FROM (SELECT EXISTS (SELECT 1 FROM (SELECT DISTINCT {", ".join(_LINES)} FROM real) r WHERE {_SAME}) AS hit FROM synth s)),
        per AS (SELECT 'marginal' AS part, 'ks_complement' AS metric, "column", '' AS other, 'scored' AS status, ks_score AS score FROM num
            UNION ALL SELECT 'marginal', 'boundary_adherence', "column", '', 'scored', inside FROM num
            UNION ALL SELECT 'marginal', 'tv_complement', "column", '', 'scored', 1 - tv FROM cats
            UNION ALL SELECT 'marginal', 'category_adherence', "column", '', 'scored', adh FROM cats
            UNION ALL SELECT 'marginal', m, 'l_tax', '', 'missing', NULL FROM (VALUES ('ks_complement'), ('boundary_adherence')) t(m)
            UNION ALL SELECT 'pairwise', 'correlation', a, b, 'scored', s FROM ({_CORRELATED})
            UNION ALL SELECT 'pairwise', 'contingency', '{_TEXTS[0]}', '{_TEXTS[1]}', 'scored', s FROM joint
            UNION ALL SELECT 'table_level', 'new_row_synthesis', '', '', 'scored', s FROM new),
        quality AS (SELECT 'quality' AS part, 'column_shapes' AS metric, '' AS "column", '' AS other, 'scored' AS status, avg(score) AS score FROM per WHERE metric IN ('ks_complement', 'tv_complement')
            UNION ALL SELECT 'quality', 'pair_trends', '', '', 'scored', avg(score) FROM per WHERE part = 'pairwise'),
        everything AS (FROM per UNION ALL FROM quality UNION ALL SELECT 'overall', 'score', '', '', 'scored', avg(score) FROM quality
            UNION ALL SELECT part, 'score', '', '', 'scored', avg(score) FROM per GROUP BY part)
        SELECT part, metric, "column", other, status, round(score, 5) AS score FROM everything""",
    ),
    "evaluate": _numeric_sql(
        _ORDERS,
        ["o_totalprice"],
        f""", {_categories(["o_orderstatus", "o_orderpriority"])},
        per AS (SELECT "column", 'numeric' AS kind, 'scored' AS status, column_score AS score FROM num UNION ALL SELECT "column", 'categorical', 'scored', column_score FROM cats
            UNION ALL SELECT 'o_custkey', 'numeric', 'missing', NULL UNION ALL SELECT 'discount', 'numeric', 'empty', NULL)
        SELECT "column", kind, status, round(score, 5) AS score FROM per UNION ALL SELECT '', 'table', 'scored', round(avg(score), 5) FROM per""",
    ),
    "lab_values": """WITH x AS (SELECT 'glucose_mg_dl' AS lab, 'Glucose_mg_dl_value' AS "column", count(*) AS n, avg((c_acctbal / 10 BETWEEN 40 AND 500)::DOUBLE) AS share FROM customer
            UNION ALL SELECT 'heart_rate_bpm', 'pulse', count(*), avg((c_nationkey * 12 BETWEEN 20 AND 250)::DOUBLE) FROM customer)
        SELECT lab, "column", n, round(share, 6) AS share FROM x UNION ALL SELECT 'overall', NULL, sum(n)::BIGINT, round(avg(share), 6) FROM x""",
    "medication_safety": """WITH p AS (SELECT c_custkey // 2 AS id, bool_or(c_mktsegment = 'BUILDING') AND bool_or(c_mktsegment = 'MACHINERY') AS hit FROM customer GROUP BY ALL)
        SELECT count(*) AS patients, count_if(hit)::BIGINT AS flags, round(greatest(0, 1 - 10 * count_if(hit) / count(*)), 6) AS score FROM p""",
    "calibration_flags": f"""WITH b(k, level, expected_min, expected_max) AS (VALUES {_BOUNDS}), f AS (SELECT l_linenumber AS k, avg(l_discount::DOUBLE) * 3.6 * l_linenumber AS fidelity FROM lineitem GROUP BY l_linenumber),
        j AS (SELECT b.*, fidelity, lag(fidelity) OVER (ORDER BY k) AS before FROM b JOIN f USING (k))
        SELECT level, round(fidelity, 6) AS fidelity, expected_min, expected_max, fidelity BETWEEN expected_min AND expected_max AS in_range, (SELECT count_if(fidelity < before) = 0 FROM j) AS ranking_verified FROM j""",
}
