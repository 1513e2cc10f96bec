"""Queries over overall scores, score summaries and jobs. Averages of lineitem stand in for the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health
from ..operators import overall as ov
from .tabular import rounded

_STATES = {"signup": "pending", "view": "pending", "click": "running", "purchase": "completed"}


def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    q, d, t = F.col("q") / 50, F.col("d") * 10, F.col("t") * 10
    parts = {
        "image": {"fid": ov.fid_score(F.col("q")), "lpips": q, "ssim": d, "inception": ov.inception_part(10 * F.col("q"))},
        "video": {"lpips": q, "flow": d, "temporal": t},  # without scene transitions
        "audio": {"mos": ov.listening_part(1 + 4 * d), "speaker": q, "pitch": t, "prosody": d, "snr": q},
        "text": {"bleu": d, "rouge_l": t, "cosine": q, "coherence": q, "perplexity": d},
        "healthcare_with_bundles": {"fhir": q, "clinical": d, "codes": t, "labs": q, "medication": d},
        "healthcare": {"clinical": d, "codes": t, "labs": q, "medication": d},
    }
    cells = F.array(*(F.struct(F.lit(k).alias("kind"), ov.overall_score(k, p).alias("score")) for k, p in parts.items()))
    return rounded(one.select(F.explode(cells).alias("x")).select("x.*"))


def clinical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the checks that apply: two that do and one that doesn't; and of none."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    one = df.agg(health.share_within("c_acctbal", 0.0, 5000.0).alias("a"), health.share_within("c_nationkey", 3.0, 20.0).alias("b"))
    none = F.lit(None).cast("double")
    return rounded(one.select(ov.mean_of_present(F.col("a"), none, F.col("b")).alias("clinical_score"), ov.mean_of_present(none, none).alias("code_score")))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.avg("l_discount").alias("x"))
    return rounded(ov.summary(rows.select(F.when(F.col("x") >= 0.04, F.col("x")).alias("score"))))


def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", "user_id")
    return ov.first_per_key(events, "event_type", ["event_id"], 20)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _STATES.items()), F.lit("failed"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("updated_at"), state.alias("status"))


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.transitions(_jobs(spark, sf_dir))


def certified_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.certified(_jobs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (overall_scores, clinical_scores, score_summary, first_errors, job_transitions, certified_jobs)}

_JOBS = "SELECT user_id AS job_id, event_id AS updated_at, CASE WHEN event_type IN ('signup', 'view') THEN 'pending' WHEN event_type = 'click' THEN 'running' WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events"

ORACLES = {
    "overall_scores": """WITH m AS (SELECT avg(l_quantity)::DOUBLE AS raw, avg(l_quantity)::DOUBLE / 50 AS q, avg(l_discount)::DOUBLE * 10 AS d, avg(l_tax)::DOUBLE * 10 AS t FROM lineitem)
        SELECT 'image' AS kind, round(0.4 * (1 - least(raw / 300, 1)) + 0.3 * q + 0.2 * d + 0.1 * least(1, greatest(0, (10 * raw - 1) / 1000)), 6) AS score FROM m
        UNION ALL SELECT 'video', round(0.35 * q + 0.3 * d + 0.25 * t, 6) FROM m
        UNION ALL SELECT 'audio', round(0.25 * d + 0.3 * q + 0.2 * t + 0.15 * d + 0.1 * q, 6) FROM m
        UNION ALL SELECT 'text', round(0.2 * d + 0.25 * t + 0.35 * q + 0.1 * q + 0.1 * d, 6) FROM m
        UNION ALL SELECT 'healthcare_with_bundles', round(0.2 * q + 0.3 * d + 0.2 * t + 0.2 * q + 0.1 * d, 6) FROM m
        UNION ALL SELECT 'healthcare', round(0.35 * d + 0.25 * t + 0.25 * q + 0.15 * d, 6) FROM m""",
    "clinical_scores": "SELECT round((avg((c_acctbal BETWEEN 0 AND 5000)::DOUBLE) + avg((c_nationkey BETWEEN 3 AND 20)::DOUBLE)) / 2, 6) AS clinical_score, 0.5::DOUBLE AS code_score FROM customer",
    "score_summary": "WITH s AS (SELECT CASE WHEN avg(l_discount) >= 0.04 THEN avg(l_discount)::DOUBLE END AS score FROM lineitem GROUP BY l_suppkey) SELECT count(score) AS n, count_if(score IS NULL)::BIGINT AS failed, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM s",
    "first_errors": "SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 20",
    "job_transitions": f"""WITH j AS ({_JOBS}), s AS (SELECT status, lag(status) OVER (PARTITION BY job_id ORDER BY updated_at) AS before FROM j)
        SELECT before, status, count(*) AS n, coalesce(CASE WHEN before IS NULL THEN status = 'pending' WHEN before = 'pending' THEN status = 'running' WHEN before = 'running' THEN status IN ('completed', 'failed') ELSE false END, false) AS legal FROM s GROUP BY before, status""",
    "certified_jobs": f"WITH j AS ({_JOBS}) SELECT job_id, max(updated_at) AS updated_at FROM j GROUP BY job_id HAVING arg_max(status, updated_at) = 'completed'",
}
