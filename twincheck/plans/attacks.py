"""Queries over the privacy attacks on all rows, with DuckDB SQL that compares all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import memorization_level
from ..operators import attacks, privacy
from .risks import _thirds
from .tabular import part_sides, rounded

NUMBERS, WORDS = ["p_size", "p_retailprice"], ["p_brand", "p_type"]
LEFT, RIGHT = (["o_totalprice"], ["o_orderstatus"]), (["o_custkey"], ["o_orderpriority"])
SECRETS = ["p_type", "p_retailprice"]


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return df.where("o_orderkey % 2 = 0"), df.where("o_orderkey % 2 = 1")


def singling_out_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attacks.singling_out(*part_sides(spark, sf_dir), "p_partkey", NUMBERS, WORDS))


def linkability_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attacks.linkability(*_orders(spark, sf_dir), "o_orderkey", LEFT, RIGHT))


def inference_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attacks.inference(*part_sides(spark, sf_dir), "p_partkey", NUMBERS, WORDS, SECRETS))


def membership_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["event_id", "user_id", "value", "event_type"]
    members, synth, others = (spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns).where(f"event_id % 3 = {k}") for k in range(3))
    got = attacks.membership(members, others, synth, "event_id", ["user_id", "value"], ["event_type"])
    return rounded(got.withColumn("risk_level", memorization_level(F.col("auc"))))


def linkability_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest-neighbour proxy on all rows of both sides."""
    return rounded(attacks.linked_rows(*_thirds(spark, sf_dir), ["user_id", "value"], "event_id"))


def attack_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three measured risks, the largest of each attack, and what they add up to."""
    so = singling_out_attack(spark, sf_dir).agg(F.max("risk").alias("singling_out"))
    link = linkability_attack(spark, sf_dir).agg(F.max("risk").alias("linkability"))
    told = inference_attack(spark, sf_dir).agg(F.max("risk").alias("inference"))
    return rounded(privacy.verdict(so.join(link).join(told)))  # one row each


QUERIES = {f.__name__: f for f in (singling_out_attack, linkability_attack, inference_attack, membership_shadows, linkability_all, attack_verdict)}

_Z = attacks.Z
_OUT = f"""attacks, successes, round(successes / attacks, 6) AS rate,
        round(greatest(0, (successes + {_Z * _Z / 2}) / (attacks + {_Z * _Z}) - {_Z} / (attacks + {_Z * _Z}) * sqrt(successes * (attacks - successes) / attacks + {_Z * _Z / 4})), 6) AS low,
        round(least(1, (successes + {_Z * _Z / 2}) / (attacks + {_Z * _Z}) + {_Z} / (attacks + {_Z * _Z}) * sqrt(successes * (attacks - successes) / attacks + {_Z * _Z / 4})), 6) AS high,
        round(baseline, 6) AS baseline, round(CASE WHEN baseline >= 1 THEN 0 ELSE least(1, greatest(0, (successes / attacks - baseline) / (1 - baseline))) END, 6) AS risk"""


def _cells(side: str) -> str:
    return " UNION ALL ".join([f"SELECT p_partkey AS id, '{c}' AS col, {c}::DOUBLE AS num, NULL::VARCHAR AS txt FROM {side}" for c in NUMBERS] + [f"SELECT p_partkey, '{c}', NULL, {c} FROM {side}" for c in WORDS])


_COLUMNS = "[" + ", ".join(f"'{c}'" for c in NUMBERS + WORDS) + "]"
_SINGLING = f"""s AS (SELECT * FROM part WHERE p_partkey % 2 = 1), r AS (SELECT * FROM part WHERE p_partkey % 2 = 0), sc AS ({_cells("s")}), rc AS ({_cells("r")}),
        med AS (SELECT col, num AS m FROM (SELECT col, num, row_number() OVER (PARTITION BY col ORDER BY num) AS k, count(*) OVER (PARTITION BY col) AS n FROM sc WHERE num IS NOT NULL) WHERE k = ceil(n / 2)),
        rare AS (SELECT col, '=' AS op, num, txt, min(id)::VARCHAR AS id FROM sc GROUP BY col, num, txt HAVING count(*) = 1
                 UNION ALL SELECT col, '<=', min(num), NULL, '' FROM sc WHERE num IS NOT NULL GROUP BY col UNION ALL SELECT col, '>=', max(num), NULL, '' FROM sc WHERE num IS NOT NULL GROUP BY col),
        u AS (SELECT 'univariate' AS mode, md5('0:' || col || ':' || op || ':' || id) AS pid, col, op, num, txt FROM rare ORDER BY pid LIMIT 1000),
        mr AS (SELECT p_partkey AS id FROM s ORDER BY md5('0:row:' || p_partkey) LIMIT 1000),
        mt AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.id ORDER BY md5('0:' || sc.id || ':' || col)) AS k FROM sc JOIN mr ON sc.id = mr.id) WHERE k <= 3),
        mu AS (SELECT 'multivariate' AS mode, md5('0:conjunction:' || id) AS pid, mt.col, CASE WHEN num > m THEN '>=' WHEN num IS NOT NULL THEN '<=' ELSE '=' END AS op, num, txt FROM mt LEFT JOIN med USING (col)),
        gr AS (SELECT p_partkey AS id, {_COLUMNS}[('0x' || substr(md5('0:column:' || p_partkey), 1, 8))::BIGINT % 4 + 1] AS col FROM s ORDER BY md5('0:guess:' || p_partkey) LIMIT 1000),
        g AS (SELECT 'guess' AS mode, md5('0:guess:' || sc.id) AS pid, sc.col, CASE WHEN num IS NULL THEN '=' ELSE ['=', '<=', '>='][('0x' || substr(md5('0:op:' || sc.id), 1, 8))::BIGINT % 3 + 1] END AS op, num, txt FROM sc JOIN gr ON sc.id = gr.id AND sc.col = gr.col),
        t AS (SELECT * FROM u UNION ALL SELECT * FROM mu UNION ALL SELECT * FROM g), size AS (SELECT mode, pid, count(*) AS terms FROM t GROUP BY ALL),
        hit AS (SELECT side, mode, pid, count(*) AS n FROM (SELECT side, mode, pid, c.id, count(*) AS met FROM t JOIN (SELECT 's' AS side, * FROM sc UNION ALL SELECT 'r', * FROM rc) c
                ON t.col = c.col AND (CASE t.op WHEN '=' THEN coalesce(c.num = t.num, c.txt = t.txt) WHEN '<=' THEN c.num <= t.num ELSE c.num >= t.num END) GROUP BY ALL) JOIN size USING (mode, pid) WHERE met = terms GROUP BY ALL),
        tried AS (SELECT mode, count(*) AS attacks, count_if(coalesce(h.n, 0) = 1)::BIGINT AS successes FROM size LEFT JOIN (SELECT mode, pid, n FROM hit WHERE side = 'r') h USING (mode, pid) WHERE mode <> 'multivariate' OR pid IN (SELECT pid FROM hit WHERE side = 's' AND mode = 'multivariate' AND n = 1) GROUP BY mode),
        so AS (SELECT m.mode, coalesce(attacks, 0) AS attacks, coalesce(successes, 0) AS successes, coalesce((SELECT successes / attacks FROM tried WHERE mode = 'guess'), 0) AS baseline FROM (VALUES ('univariate'), ('multivariate')) m(mode) LEFT JOIN tried USING (mode))"""


def _gap(column: str) -> str:
    return f"coalesce(abs(q.{column} - c.{column}) / nullif(w.{column}, 0), 0)"


def _near(name: str, numbers: list[str], words: list[str], key: str) -> str:
    """The ten nearest of s to each of q by Gower's distance."""
    d = " + ".join([_gap(c) for c in numbers] + [f"(q.{c} <> c.{c})::INT" for c in words])
    return f"{name} AS (SELECT * FROM (SELECT q.{key} AS id, c.{key} AS near_id, round(({d}) / {len(numbers) + len(words)}, 9) AS d, row_number() OVER (PARTITION BY q.{key} ORDER BY round(({d}) / {len(numbers) + len(words)}, 9), c.{key}) AS k FROM q, s c, w) WHERE k <= 10)"


_LINK = f"""o AS (SELECT * FROM orders), lr AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1), q AS (SELECT * FROM lr WHERE o_orderkey % 20 = 0),
        w AS (SELECT max(o_totalprice) - min(o_totalprice) AS o_totalprice, max(o_custkey) - min(o_custkey) AS o_custkey FROM (SELECT * FROM q UNION ALL SELECT * FROM s)),
        w1 AS (SELECT 1), {{a}}, {{b}},
        li AS (SELECT (SELECT count(*) FROM q) AS attacks, (SELECT count(DISTINCT a.id) FROM a JOIN b ON a.id = b.id AND a.near_id = b.near_id) AS successes, 1 - (SELECT list_reduce(list_transform(range(10), lambda i: greatest(n - 10 - i, 0) / greatest(n - i, 1)), lambda x, y: x * y) FROM (SELECT count(*) AS n FROM s)) AS baseline)"""
_INFER = f"""s AS (SELECT * FROM part WHERE p_partkey % 2 = 1), q AS (SELECT * FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 20 = 0),
        w AS (SELECT max(p_size) - min(p_size) AS p_size FROM (SELECT * FROM q UNION ALL SELECT * FROM s)), {_near("nn", ["p_size"], ["p_brand"], "p_partkey")},
        v AS (SELECT nn.id, round((1 - d) * 1e9)::BIGINT AS weight, p_type, p_retailprice FROM nn JOIN s ON near_id = p_partkey),
        said AS (SELECT id, arg_min(p_type, (-weight, p_type)) AS p_type FROM (SELECT id, p_type, sum(weight) AS weight FROM v GROUP BY ALL) GROUP BY id),
        num AS (SELECT id, sum(weight * p_retailprice) / sum(weight) AS x FROM v GROUP BY id),
        mode_ AS (SELECT p_type AS m FROM s GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1), mean_ AS (SELECT avg(p_retailprice) AS m FROM s),
        inf AS (SELECT 'p_type' AS secret, count(*) AS attacks, count_if(said.p_type = q.p_type)::BIGINT AS successes, avg((q.p_type = m)::INT) AS baseline FROM q LEFT JOIN said ON id = p_partkey, mode_
              UNION ALL SELECT 'p_retailprice', count(*), count_if(abs(x - p_retailprice) <= 0.05 * abs(p_retailprice))::BIGINT, avg((abs(m - p_retailprice) <= 0.05 * abs(p_retailprice))::INT) FROM q LEFT JOIN num ON id = p_partkey, mean_)"""
_LINK = _LINK.format(a=_near("a", *LEFT, "o_orderkey"), b=_near("b", *RIGHT, "o_orderkey")).replace("w1 AS (SELECT 1), ", "").replace("o AS (SELECT * FROM orders), ", "")
_RISK = "max(CASE WHEN baseline >= 1 THEN 0 ELSE least(1, greatest(0, (successes / attacks - baseline) / (1 - baseline))) END)"
_SUM = "0.40 * so + 0.35 * li + 0.25 * inf"

ORACLES = {
    "singling_out_attack": f"WITH {_SINGLING} SELECT mode, {_OUT} FROM so",
    "linkability_attack": f"WITH {_LINK} SELECT {_OUT} FROM li",
    "inference_attack": f"WITH {_INFER} SELECT secret, {_OUT} FROM inf",
    "membership_shadows": f"""WITH e AS (SELECT event_id AS id, user_id::DOUBLE AS x, value AS y, event_type AS t, event_id % 3 AS side, md5('0:' || event_id) AS h FROM events),
        w AS (SELECT max(x) - min(x) AS wx, max(y) - min(y) AS wy FROM e), p AS (SELECT * FROM e WHERE side <> 1),
        pairs AS (SELECT q.id, q.h, q.side AS member, c.side, c.h AS ch, round((abs(q.x - c.x) / wx + abs(q.y - c.y) / wy + (q.t <> c.t)::INT) / 3, 9) AS d FROM p q, e c, w WHERE q.id <> c.id),
        near AS (SELECT id, member, h, min(d) FILTER (side = 1) AS d, {", ".join(f"min(d) FILTER (side <> 1 AND substr(h, {i + 1}, 1) >= '8' AND substr(ch, {i + 1}, 1) < '8') AS d{i}" for i in range(10))} FROM pairs GROUP BY ALL),
        sco AS (SELECT member = 0 AS member, round(coalesce(list_avg(list_filter([{", ".join(f"d{i}" for i in range(10))}], lambda v: v IS NOT NULL)) - d, 0), 14) AS score FROM near),
        f AS (SELECT score, count_if(member) AS a, count_if(NOT member) AS b FROM sco GROUP BY 1), n AS (SELECT count_if(member) AS n, count_if(NOT member) AS m FROM sco),
        cum AS (SELECT a, b, sum(b) OVER (ORDER BY score) AS cb, sum(a) OVER (ORDER BY score DESC) / n AS tpr, sum(b) OVER (ORDER BY score DESC) / m AS fpr, n, m FROM f, n),
        auc AS (SELECT first(n)::BIGINT AS members, first(m)::BIGINT AS others, sum(a * (cb - b / 2)) / first(n) / first(m) AS auc, greatest(max(tpr - fpr), 0) AS advantage, coalesce(max(tpr) FILTER (fpr <= 0.01), 0) AS t FROM cum),
        er AS (SELECT *, sqrt((auc * (1 - auc) + (members - 1) * (auc / (2 - auc) - auc * auc) + (others - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (members * others)) AS e FROM auc)
        SELECT 10 AS shadows, members, others, round(auc, 6) AS auc, round(greatest(0, auc - {_Z} * e), 6) AS low, round(least(1, auc + {_Z} * e), 6) AS high, round(advantage, 6) AS advantage, round(t, 6) AS tpr_at_fpr_001, CASE WHEN auc < 0.55 THEN 'low' WHEN auc < 0.65 THEN 'medium' ELSE 'high' END AS risk_level FROM er""",
    "linkability_all": """WITH e AS (SELECT event_id AS id, user_id::DOUBLE AS x, value AS y FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND NOT isnan(value)),
        r AS (SELECT * FROM e WHERE id % 3 = 0), s AS (SELECT * FROM e WHERE id % 3 = 1), a AS (SELECT * FROM e WHERE id % 3 = 2 AND id % 20 = 0), sc AS (SELECT stddev_pop(x) + 1e-8 AS sx, stddev_pop(y) + 1e-8 AS sy FROM r),
        d AS (SELECT a.id, s.x, s.y, row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt(power((a.x - s.x) / sx, 2) + power((a.y - s.y) / sy, 2)), 9), s.id) AS k FROM a, s, sc),
        c AS (SELECT d.id, min(round(sqrt(power((d.x - r.x) / sx, 2) + power((d.y - r.y) / sy, 2)), 9)) AS dist FROM d, r, sc WHERE k = 1 GROUP BY d.id)
        SELECT count_if(dist < 0.5)::BIGINT AS linked, count(*) AS probes, round(count_if(dist < 0.5) / count(*), 6) AS risk FROM c""",
    "attack_verdict": f"""WITH x AS (WITH {_SINGLING} SELECT round({_RISK}, 6) AS so FROM so), y AS (WITH {_LINK} SELECT round({_RISK}, 6) AS li FROM li), z AS (WITH {_INFER} SELECT round({_RISK}, 6) AS inf FROM inf)
        SELECT so AS singling_out, li AS linkability, inf AS inference, round({_SUM}, 6) AS overall_risk, CASE WHEN {_SUM} <= 0.05 THEN 'low' WHEN {_SUM} <= 0.15 THEN 'medium' WHEN {_SUM} <= 0.30 THEN 'high' ELSE 'critical' END AS risk_level, so <= 0.05 AND li <= 0.10 AND inf <= 0.15 AS passed FROM x, y, z""",
}
