"""Queries over fitted models, sequences and joins within tolerances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, sequences, statistics
from .tabular import NUMERIC, distorted_orders, lineitems, part_sides, rounded

_TOLERANCES = {"p_size": 1.0, "p_retailprice": 25.0}


def mixture_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.mixture_likelihood(*lineitems(spark, sf_dir), NUMERIC, range(1, 4))


def svc_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.svc_detection(*distorted_orders(spark, sf_dir), ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])


def transfer_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.transfer(*lineitems(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount"], ["l_linestatus"], "l_returnflag")


def sequence_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a conversation's turns."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.char_length("text").alias("length"))
    return rounded(sequences.sequence_similarity(df.where("conv_id % 2 = 0"), df.where("conv_id % 2 = 1"), "conv_id", "length"))


def sequence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(sequences.sequence_similarity(df.where("user_id % 2 = 0"), df.where("user_id % 2 = 1"), "user_id", "value"))


def new_rows_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequences.new_rows_within(*part_sides(spark, sf_dir), _TOLERANCES, ["p_brand"]))


def midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lower and upper quartiles of the orders' prices, and the middle of their keys."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = df.count()
    found = [(c, at, sequences.order_statistic(df, c, k)) for c in ("o_orderkey", "o_totalprice") for at, k in (("first", 1), ("lower", -(-n // 4)), ("middle", -(-n // 2)), ("last", n))]
    return spark.createDataFrame([(c, at, float(v)) for c, at, v in found], "`column` string, place string, value double")


def anderson_darling_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardised statistic and its p-value."""
    return rounded(statistics.numeric_tests(*lineitems(spark, sf_dir), NUMERIC).select("column", "anderson_darling_t", "anderson_darling_p"), 4)


QUERIES = {f.__name__: f for f in (mixture_likelihood, svc_detection, transfer_classifiers, sequence_conversations, sequence_events, new_rows_within, midpoint, anderson_darling_tests)}


def _sequence_sql(table: str, key: str, value: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{s}' AS statistic, key, {s}_ AS v FROM q WHERE {s}_ IS NOT NULL" for s in sequences.STATISTICS)
    return f"""WITH q AS (SELECT {key} AS key, round(avg(v), 9) AS mean_, round(quantile_disc(v, 0.5), 9) AS median_, round(stddev_samp(v), 9) AS std_, round(min(v), 9) AS min_, round(max(v), 9) AS max_ FROM (SELECT {key}, ({value})::DOUBLE AS v FROM {table}) GROUP BY {key}),
        l AS ({long}), f AS (SELECT statistic, v, count_if(key % 2 = 0) AS a, count_if(key % 2 = 1) AS b FROM l GROUP BY ALL),
        c AS (SELECT statistic, sum(a) OVER (PARTITION BY statistic) AS n, sum(b) OVER (PARTITION BY statistic) AS m, sum(a) OVER (PARTITION BY statistic ORDER BY v) AS ca, sum(b) OVER (PARTITION BY statistic ORDER BY v) AS cb FROM f)
        SELECT statistic, first(n)::BIGINT AS n_real, first(m)::BIGINT AS n_synth, round(max(abs(ca / n - cb / m)), 6) AS ks, round(1 - max(abs(ca / n - cb / m)), 6) AS score FROM c GROUP BY statistic"""


ORACLES = {
    "sequence_conversations": _sequence_sql("conversations", "conv_id", "length(text)"),
    "sequence_events": _sequence_sql("events", "user_id", "value"),
    "new_rows_within": """WITH s AS (SELECT * FROM part WHERE p_partkey % 2 = 1), r AS (SELECT * FROM part WHERE p_partkey % 2 = 0),
        h AS (SELECT EXISTS (SELECT 1 FROM r WHERE r.p_brand = s.p_brand AND abs(r.p_size - s.p_size) <= 1 AND abs(r.p_retailprice - s.p_retailprice) <= 25) AS hit FROM s)
        SELECT count(*) AS n_synth, count_if(NOT hit)::BIGINT AS n_new, round(count_if(NOT hit) / count(*), 6) AS score FROM h""",
    "midpoint": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{at}' AS place, v::DOUBLE AS value FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS k, count(*) OVER () AS n FROM orders) WHERE k = {k}"""
        for c in ("o_orderkey", "o_totalprice")
        for at, k in (("first", "1"), ("lower", "ceil(n / 4)"), ("middle", "ceil(n / 2)"), ("last", "n"))
    ),
}
