"""Queries over clinical checks, contracts, regression, verdicts, sampling and the drift monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequency as fq
from ..operators import governance, health
from ..sources import datasets
from ..streaming import drift as monitor
from .tabular import distorted_orders, lineitems, rounded

CONTRACT = [
    {"name": "price_not_null", "kind": "not_null", "args": {"column": "o_totalprice"}},
    {"name": "price_range", "kind": "between", "args": {"column": "o_totalprice", "low": 0, "high": 400_000}},
    {"name": "status_set", "kind": "in_set", "args": {"column": "o_orderstatus", "values": ["O", "F"]}},
    {"name": "priority_format", "kind": "matches", "args": {"column": "o_orderpriority", "pattern": "^[1-5]-"}},
    {"name": "key_unique", "kind": "unique", "args": {"columns": ["o_orderkey"]}},
]
PAIRS = [("purchase", "error"), ("signup", "purchase"), ("view", "click")]


def value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_acctbal", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    return rounded(health.ranges(df, {"c_acctbal": (0.0, 5000.0), "c_nationkey": (3.0, 20.0)}))


def greater_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.greater(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_discount", "l_tax"))


def code_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("code", F.concat(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")))
    return rounded(health.codes(df, "code", health.ICD10, True))


def prefix_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth = (d.select(health.prefix("o_orderpriority").alias("prefix")) for d in distorted_orders(spark, sf_dir))
    return rounded(fq.categorical_scores(real, synth, ["prefix"]).select("column", "tv_distance"))


def pair_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.pair_safety(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", PAIRS))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(governance.run_contract(spark.read.parquet(f"{sf_dir}/orders.parquet"), CONTRACT))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price per order status of this data against a baseline of another, both scaled into [0, 1]."""
    real, synth = lineitems(spark, sf_dir)
    score = lambda d: d.groupBy(F.col("l_returnflag").alias("category")).agg((F.avg("l_quantity") / 50).alias("score"))
    return rounded(governance.regressions(score(real.where("l_quantity <= 40")), score(synth)))


def full_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = lineitems(spark, sf_dir)
    fidelity = fq.categorical_scores(*sides, ["l_returnflag", "l_linestatus"]).agg(F.avg("tv_score").alias("fidelity"))
    return rounded(fidelity.select("fidelity", *governance.full_score(F.col("fidelity"), F.lit(True), F.lit(False))), 5)


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fidelity is measured; the other values are those of an earlier run, of which the inference attack is missing."""
    fidelity = fq.categorical_scores(*lineitems(spark, sf_dir), ["l_returnflag", "l_linestatus"]).agg(F.avg("tv_score").alias("fidelity"))
    return fidelity.select("fidelity", F.lit(0.02).alias("singling_out"), F.lit(0.12).alias("linkability"), F.lit(None).cast("double").alias("inference"), F.lit(0.62).alias("auc"), F.lit(0.16).alias("overall_risk"))


def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.executive_summary(_reported(spark, sf_dir))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(governance.dashboard(_reported(spark, sf_dir)), 5)


def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.score_histogram(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") / 50).alias("score")))


def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: 500 orders by a hash that any partitioning agrees on."""
    return datasets.capped(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 500).select("o_orderkey", "o_totalprice")


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("updated_at"), F.col("event_type").alias("status"))
    return datasets.latest(jobs)


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = events.groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    got = monitor.drift(monitor.window_counts(events), counts.join(total).select("category", (F.col("n") / F.col("total")).alias("share")))
    return rounded(got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "tv_distance"))


QUERIES = {f.__name__: f for f in (executive_summary, dashboard, value_ranges, greater_than, code_format, prefix_distance, pair_safety, contract, regression, full_verdict, score_bins, row_cap, latest_rows, drift)}

_CONTRACT = {
    "price_not_null": "SELECT count_if(o_totalprice IS NULL) FROM orders",
    "price_range": "SELECT count_if(o_totalprice IS NOT NULL AND NOT o_totalprice BETWEEN 0 AND 400000) FROM orders",
    "status_set": "SELECT count_if(o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('O', 'F')) FROM orders",
    "priority_format": "SELECT count_if(o_orderpriority IS NOT NULL AND NOT regexp_matches(o_orderpriority, '^[1-5]-')) FROM orders",
    "key_unique": "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)",
}
_FLAGS = " + ".join(f"(bool_or(event_type = '{a}') AND bool_or(event_type = '{b}'))::INT" for a, b in PAIRS)
_TV = "SELECT 0.5 * sum(abs(a / n - b / m)) AS tv FROM (SELECT {c}, count_if(l_orderkey % 2 = 0) AS a, count_if(l_orderkey % 2 = 1) AS b FROM lineitem GROUP BY {c}), (SELECT count_if(l_orderkey % 2 = 0) AS n, count_if(l_orderkey % 2 = 1) AS m FROM lineitem)"

ORACLES = {
    "value_ranges": "SELECT 'c_acctbal' AS \"column\", round(avg((c_acctbal BETWEEN 0 AND 5000)::DOUBLE), 6) AS share FROM customer UNION ALL SELECT 'c_nationkey', round(avg((c_nationkey BETWEEN 3 AND 20)::DOUBLE), 6) FROM customer",
    "greater_than": "SELECT round(avg((l_discount > l_tax)::DOUBLE), 6) AS share FROM lineitem",
    "code_format": r"SELECT count(*) AS n, count_if(ok)::BIGINT AS valid, round(count_if(ok) / count(*), 6) AS share FROM (SELECT regexp_full_match(upper(trim(o_orderstatus || o_orderkey)), '[A-Z][0-9]{2}(\.[A-Z0-9]{1,4})?') AS ok FROM orders)",
    "prefix_distance": "WITH t AS (SELECT o_orderpriority[1] AS p, count_if(o_orderkey % 2 = 0) AS a, count_if(o_orderkey % 2 = 1 AND o_orderpriority <> '1-URGENT') AS b FROM orders GROUP BY 1) SELECT 'prefix' AS \"column\", round(0.5 * sum(abs(a / n - b / m)), 6) AS tv_distance FROM t, (SELECT sum(a) AS n, sum(b) AS m FROM t)",
    "pair_safety": f"WITH u AS (SELECT user_id, {_FLAGS} AS f FROM events WHERE user_id IS NOT NULL GROUP BY user_id) SELECT count(*) AS patients, sum(f)::BIGINT AS flags, round(greatest(0, 1 - 10 * sum(f) / count(*)), 6) AS score FROM u",
    "contract": "WITH a AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, ({sql})::BIGINT AS violations" for k, sql in _CONTRACT.items()) + ") SELECT name, violations, violations = 0 AS passed, round(100.0 * count_if(violations = 0) OVER () / count(*) OVER (), 6) AS success_percent FROM a",
    "regression": """WITH c AS (SELECT l_returnflag AS category, avg(l_quantity) / 50 AS s FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity <= 40 GROUP BY 1), b AS (SELECT l_returnflag AS category, avg(l_quantity) / 50 AS s FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1)
        SELECT category, round(b.s, 6) AS baseline, round(c.s, 6) AS current, round(b.s - c.s, 6) AS drop, b.s - c.s > 0.05 AS regressed FROM c JOIN b USING (category)""",
    "full_verdict": f"WITH f AS (SELECT avg(1 - tv) AS f FROM (({_TV.format(c='l_returnflag')}) UNION ALL ({_TV.format(c='l_linestatus')}))) SELECT round(f, 5) AS fidelity, round(0.6 * f + 0.2, 5) AS overall_score, false AS passed FROM f",
    "score_bins": "SELECT b::INT AS bin, coalesce(n, 0) AS n FROM range(10) t(b) LEFT JOIN (SELECT least(floor(l_quantity / 50 * 10), 9)::INT AS k, count(*) AS n FROM lineitem WHERE l_quantity / 50 BETWEEN 0 AND 1 GROUP BY 1) ON k = b",
    "latest_rows": "SELECT user_id AS job_id, max(event_id) AS updated_at, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id",
    "drift": """WITH d AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT day, sum(n) AS total FROM d GROUP BY day), g AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type)
        SELECT t.day, round(0.5 * sum(abs(coalesce(n, 0) / total - share)), 6) AS tv_distance FROM t CROSS JOIN g LEFT JOIN d ON d.day = t.day AND d.event_type = g.event_type GROUP BY t.day""",
    "executive_summary": f"""WITH f AS (SELECT avg(1 - tv) >= 0.82 AS ok FROM (({_TV.format(c='l_returnflag')}) UNION ALL ({_TV.format(c='l_linestatus')})))
        SELECT 'FAIL' AS verdict, concat_ws('; ', CASE WHEN NOT ok THEN 'Fidelity score below threshold (0.82)' END, 'Privacy thresholds failed: linkability risk too high, inference risk too high', 'Memorization AUC (0.620) exceeds threshold (0.60)') AS explanation,
            ok AS fidelity_passed, false AS privacy_passed, false AS memorization_passed FROM f""",
    "dashboard": f"""WITH f AS (SELECT avg(1 - tv) AS f FROM (({_TV.format(c='l_returnflag')}) UNION ALL ({_TV.format(c='l_linestatus')})))
        SELECT 'Overall Fidelity' AS metric, round(f, 5) AS score, 0.75::DOUBLE AS threshold, f >= 0.75 AS passed FROM f UNION ALL SELECT 'Privacy Safety', 0.84, 0.80, true UNION ALL SELECT 'Memorization Resistance', 0.38, 0.40, false""",
}
