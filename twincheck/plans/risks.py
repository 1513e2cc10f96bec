"""Queries over privacy and memorization risks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import memorization_level, risk_level
from ..operators import frequency as fq
from ..operators import privacy
from .tabular import lineitems, part_sides, rounded

PART = ["p_brand", "p_type", "p_size"]


def singling_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(privacy.singling_out(*part_sides(spark, sf_dir), PART))


def verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(privacy.verbatim(*part_sides(spark, sf_dir), PART, "p_partkey", n=1000))  # as its SQL says


def _thirds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    return [df.where(f"event_id % 3 = {k}") for k in range(3)]


def linkability(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth, aux = _thirds(spark, sf_dir)
    return rounded(privacy.linkability(real, synth, aux, ["user_id", "value"], "event_id"))


def linkability_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without auxiliary data: the second half of the real rows stands in for it."""
    real, synth, _ = _thirds(spark, sf_dir)
    first, second = privacy.halves(real, "event_id")
    return rounded(privacy.linkability(first, synth, second, ["user_id", "value"], "event_id"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, synth, others = _thirds(spark, sf_dir)
    return rounded(privacy.membership(members, others, synth, ["user_id", "value"], "event_id").withColumn("risk_level", memorization_level(F.col("auc"))))


def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth = lineitems(spark, sf_dir)
    return privacy.inference(real, synth, ["l_returnflag", "l_linestatus", "l_tax"], ["l_quantity", "l_extendedprice", "l_discount"])


def column_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(privacy.column_risk(fq.frequency(*part_sides(spark, sf_dir), ["p_brand", "p_type", "p_retailprice"], "string")))


def privacy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    so = privacy.singling_out(*part_sides(spark, sf_dir), PART).select(F.col("risk").alias("singling_out"))
    real, synth, aux = _thirds(spark, sf_dir)
    link = privacy.linkability(real, synth, aux, ["user_id", "value"], "event_id").select(F.col("risk").alias("linkability"))
    risks = so.join(link).withColumn("inference", F.lit(None).cast("double"))  # not run: counts as 1
    return rounded(privacy.verdict(risks).withColumn("singling_out_level", risk_level(F.col("singling_out"))))


QUERIES = {f.__name__: f for f in (singling_out, verbatim, linkability, linkability_halves, membership, inference, column_risk, privacy_verdict)}

_PART = "r AS (SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0)"
_SINGLE = "SELECT count(*) FILTER (r.p_size IS NOT NULL)::BIGINT AS matched, count(*)::BIGINT AS total, round(count(*) FILTER (r.p_size IS NOT NULL) / count(*), 6) AS risk FROM s LEFT JOIN r USING (p_brand, p_type, p_size)"


def _link_sql(real: str, aux: str) -> str:
    return f"""WITH e AS (SELECT event_id AS id, user_id::DOUBLE AS x, value AS y FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND NOT isnan(value)),
        r0 AS ({real}), r AS (SELECT * FROM r0 ORDER BY id LIMIT 200), s AS (SELECT * FROM e WHERE id % 3 = 1 ORDER BY id LIMIT 200), a AS ({aux} ORDER BY id LIMIT 100),
        sc AS (SELECT stddev_pop(x) + 1e-8 AS sx, stddev_pop(y) + 1e-8 AS sy FROM r),
        d AS (SELECT a.id, s.x, s.y, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(power((a.x - s.x) / sx, 2) + power((a.y - s.y) / sy, 2)), s.id) AS k FROM a, s, sc),
        c AS (SELECT d.id, min(sqrt(power((d.x - r.x) / sx, 2) + power((d.y - r.y) / sy, 2))) AS dist FROM d, r, sc WHERE k = 1 GROUP BY d.id)"""


_LINK = _link_sql("SELECT * FROM e WHERE id % 3 = 0", "SELECT * FROM e WHERE id % 3 = 2")
_HALF = "(SELECT max(event_id) FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS n FROM events WHERE event_id % 3 = 0) WHERE k <= ceil(n / 2))"
_LINK_RESULT = "SELECT count_if(dist < 0.5)::BIGINT AS linked, count(*) AS probes, round(count_if(dist < 0.5) / count(*), 6) AS risk FROM c"

ORACLES = {
    "singling_out": f"WITH {_PART}, s AS (SELECT * FROM part WHERE p_partkey % 2 = 1) {_SINGLE}",
    "verbatim": f"WITH {_PART}, s AS (SELECT * FROM part WHERE p_partkey % 2 = 1 ORDER BY p_partkey LIMIT 1000) {_SINGLE}",
    "linkability": f"{_LINK} {_LINK_RESULT}",
    "linkability_halves": _link_sql(f"SELECT * FROM e WHERE id % 3 = 0 AND id <= {_HALF}", f"SELECT * FROM e WHERE id % 3 = 0 AND id > {_HALF}") + f" {_LINK_RESULT}",
    "membership": """WITH e AS (SELECT event_id AS id, user_id::DOUBLE AS x, value AS y FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND NOT isnan(value)),
        m AS (SELECT * FROM e WHERE id % 3 = 0 ORDER BY id LIMIT 200), o AS (SELECT * FROM e WHERE id % 3 = 2 ORDER BY id LIMIT 200), s AS (SELECT * FROM e WHERE id % 3 = 1 ORDER BY id LIMIT 200),
        sc AS (SELECT stddev_pop(x) + 1e-8 AS sx, stddev_pop(y) + 1e-8 AS sy FROM m),
        p AS (SELECT *, 1 AS member FROM m UNION ALL SELECT *, 0 FROM o),
        sco AS (SELECT p.id, member, -round(min(sqrt(power((p.x - s.x) / sx, 2) + power((p.y - s.y) / sy, 2))), 9) AS score FROM p, s, sc GROUP BY ALL),
        pairs AS (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc FROM sco a, sco b WHERE a.member = 1 AND b.member = 0),
        cut AS (SELECT t.score, avg((q.score >= t.score)::DOUBLE) FILTER (q.member = 1) AS tpr, avg((q.score >= t.score)::DOUBLE) FILTER (q.member = 0) AS fpr FROM (SELECT DISTINCT score FROM sco) t, sco q GROUP BY t.score)
        SELECT round(auc, 6) AS auc, round(greatest(0, max(tpr - fpr)), 6) AS advantage, round(coalesce(max(tpr) FILTER (fpr <= 0.01), 0), 6) AS tpr_at_fpr_001, CASE WHEN auc < 0.55 THEN 'low' WHEN auc < 0.65 THEN 'medium' ELSE 'high' END AS risk_level FROM cut, pairs GROUP BY auc""",
    "column_risk": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(si, 6) AS singleton_ratio, round(ov, 6) AS overlap, round(si * ov, 6) AS risk FROM (SELECT count_if(b = 1) / count_if(b > 0) AS si, count_if(a > 0 AND b > 0) / count_if(a > 0) AS ov FROM (SELECT count_if(p_partkey % 2 = 0) AS a, count_if(p_partkey % 2 = 1) AS b FROM part WHERE {c} IS NOT NULL GROUP BY {c}))"""
        for c in ("p_brand", "p_type", "p_retailprice")
    ),
    "privacy_verdict": f"""{_LINK}, l AS (SELECT count_if(dist < 0.5) / count(*) AS link FROM c), pr AS (SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0),
        so AS (SELECT count(pr.p_size) / count(*) AS so FROM (SELECT * FROM part WHERE p_partkey % 2 = 1) ps LEFT JOIN pr USING (p_brand, p_type, p_size))
        SELECT round(so, 6) AS singling_out, round(link, 6) AS linkability, NULL::DOUBLE AS inference, round(0.40 * so + 0.35 * link + 0.25, 6) AS overall_risk, CASE WHEN 0.40 * so + 0.35 * link + 0.25 <= 0.05 THEN 'low' WHEN 0.40 * so + 0.35 * link + 0.25 <= 0.15 THEN 'medium' WHEN 0.40 * so + 0.35 * link + 0.25 <= 0.30 THEN 'high' ELSE 'critical' END AS risk_level, false AS passed,
            CASE WHEN so <= 0.05 THEN 'low' WHEN so <= 0.15 THEN 'medium' WHEN so <= 0.30 THEN 'high' ELSE 'critical' END AS singling_out_level FROM so, l""",
}
