"""Datasets in, reports out, and the calibration generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_CAP = 100_000
#: Share of noise that each calibration level mixes in; the last has none of the real data's shape.
LEVELS = {"ctgan_300_epochs": 0.0, "gaussian_copula": 0.02, "ctgan_10_epochs": 0.2, "tvae_5_epochs": 0.4, "random_noise": 1.0}


def load(spark: SparkSession, uri: str) -> DataFrame:
    """A Parquet or CSV dataset, by its extension; files without one count as Parquet."""
    if uri.lower().split("?")[0].endswith((".csv", ".csv.gz")):
        return spark.read.csv(uri, header=True, inferSchema=True)
    return spark.read.parquet(uri)


def capped(df: DataFrame, key: str, n: int = ROW_CAP, seed: int = 42) -> DataFrame:
    """The sampling operator: n rows by a hash of a unique key, the same at any partitioning. Ties go to the smaller key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def publish(df: DataFrame, path: str) -> None:
    """Append a report's rows as JSON values, one per event, as a message bus would carry them."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def record(df: DataFrame, path: str) -> None:
    """Append job rows; the latest row of a job counts, see latest()."""
    df.write.mode("append").parquet(path)


def latest(jobs: DataFrame, key: str = "job_id", order: str = "updated_at") -> DataFrame:
    """The latest row of each job: a partial aggregate, no sort."""
    return jobs.groupBy(key).agg(F.max_by(F.struct(*jobs.columns), order).alias("row")).select("row.*")


def calibration_real(spark: SparkSession, rows: int = 1000, seed: int = 42) -> DataFrame:
    """age, income, category and score of plausible people. Same seed and rows, same partitions: same data."""
    u = F.rand(seed + 2)
    return spark.range(0, rows, 1, 4).select(
        (18 + F.floor(F.rand(seed) * 62)).cast("long").alias("age"),
        F.exp(10.5 + 0.8 * F.randn(seed + 1)).alias("income"),
        F.when(u < 0.5, "A").when(u < 0.8, "B").otherwise("C").alias("category"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.65 + 0.15 * F.randn(seed + 3))).alias("score"),
    )


def calibration_synthetic(spark: SparkSession, level: str, rows: int = 1000, seed: int = 42) -> DataFrame:
    """The same columns at a quality level: uniform noise replaces a growing share of the values."""
    noise = LEVELS[level]
    base = calibration_real(spark, rows, seed + 100)
    mixed = lambda c, other, k: F.when(F.rand(seed + 200 + k) < noise, other).otherwise(F.col(c)).alias(c)
    letter = F.element_at(F.array(*map(F.lit, "ABCDE")), (F.floor(F.rand(seed + 303) * 5) + 1).cast("int"))
    return base.select(mixed("age", F.floor(F.rand(seed + 300) * 120).cast("long"), 0), mixed("income", F.rand(seed + 301) * 300_000, 1), mixed("category", letter, 2), mixed("score", F.rand(seed + 302), 3))
