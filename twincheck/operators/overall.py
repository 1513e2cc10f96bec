"""Overall scores from part scores, summaries of scores, and the life of jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clip01

# The weight of each part in an overall score, the caps of image scores, and the states that a job may go to.
WEIGHTS = {
    "image": {"fid": 0.40, "lpips": 0.30, "ssim": 0.20, "inception": 0.10},
    "video": {"lpips": 0.35, "flow": 0.30, "temporal": 0.25, "transitions": 0.10},
    "audio": {"mos": 0.25, "speaker": 0.30, "pitch": 0.20, "prosody": 0.15, "snr": 0.10},
    "text": {"bleu": 0.20, "rouge_l": 0.25, "cosine": 0.35, "coherence": 0.10, "perplexity": 0.10},
    "healthcare_with_bundles": {"fhir": 0.20, "clinical": 0.30, "codes": 0.20, "labs": 0.20, "medication": 0.10},
    "healthcare": {"clinical": 0.35, "codes": 0.25, "labs": 0.25, "medication": 0.15},
}
FID_CAP, INCEPTION_BASE = 300.0, 1000.0
NEXT_STATES = {"pending": ["running"], "running": ["completed", "failed"], "completed": [], "failed": []}


def fid_score(fid: Column) -> Column:
    """A missing distance counts as the worst."""
    return 1 - F.least(F.coalesce(fid, F.lit(FID_CAP)) / FID_CAP, F.lit(1.0))


def inception_part(mean: Column) -> Column:
    return clip01((F.coalesce(mean, F.lit(1.0)) - 1) / INCEPTION_BASE)


def listening_part(mos: Column) -> Column:
    return (F.coalesce(mos, F.lit(3.0)) - 1) / 4


def overall_score(kind: str, parts: dict[str, Column]) -> Column:
    """The weighted sum of a kind's parts, each within [0, 1]; a part that is not given or null counts as 0."""
    return reduce(lambda x, y: x + y, (w * F.coalesce(parts.get(name, F.lit(0.0)), F.lit(0.0)) for name, w in WEIGHTS[kind].items()))


def mean_of_present(*scores: Column) -> Column:
    """Mean of the scores that are not null; one half if none is. The clinical and the code score are such means."""
    held = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.when(F.size(held) == 0, F.lit(0.5)).otherwise(F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))


def summary(scores: DataFrame, column: str = "score") -> DataFrame:
    """(n, failed, min_score, max_score, mean_score) of score rows; a null score is a failure and enters no other figure."""
    c = F.col(column)
    return scores.agg(F.count(c).alias("n"), F.count_if(c.isNull()).alias("failed"), F.min(c).alias("min_score"), F.max(c).alias("max_score"), F.avg(c).alias("mean_score"))


def first_per_key(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key, as reports show of errors (20) and flags (10)."""
    w = Window.partitionBy(key).orderBy(*order)
    names = rows.columns
    return rows.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n).select(*names)


def transitions(jobs: DataFrame) -> DataFrame:
    """(before, status, n, legal) over jobs(job_id, updated_at, status): every change of a job's state, the first from null; only to pending it may be."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("updated_at"))
    legal = F.when(F.col("before").isNull(), F.col("status") == "pending")
    for state, after in NEXT_STATES.items():
        legal = legal.when(F.col("before") == state, F.col("status").isin(after) if after else F.lit(False))
    steps = jobs.select("status", before.alias("before")).groupBy("before", "status").agg(F.count(F.lit(1)).alias("n"))
    return steps.select("before", "status", "n", F.coalesce(legal, F.lit(False)).alias("legal"))


def certified(jobs: DataFrame) -> DataFrame:
    """The jobs that may have a certificate: those whose latest state is completed."""
    latest = jobs.groupBy("job_id").agg(F.max_by("status", "updated_at").alias("status"), F.max("updated_at").alias("updated_at"))
    return latest.where("status = 'completed'").select("job_id", "updated_at")


# The calibration's levels from worst to best, and the fidelity that each may have (both ends included).
EXPECTED = {"random_noise": (0.0, 0.30), "tvae_5_epochs": (0.30, 0.60), "ctgan_10_epochs": (0.50, 0.70), "gaussian_copula": (0.70, 0.90), "ctgan_300_epochs": (0.75, 1.00)}


def calibrated(levels: DataFrame) -> DataFrame:
    """(level, fidelity, expected_min, expected_max, in_range, ranking_verified) of levels(level, fidelity), one row per level.

    The ranking holds if no level scores below the next worse one. A missing fidelity is out of range and breaks it."""
    grid = levels.sparkSession.createDataFrame([(k, level, *ends) for k, (level, ends) in enumerate(EXPECTED.items())], "place int, level string, expected_min double, expected_max double")
    both = grid.join(levels, "level", "left")
    w = Window.partitionBy().orderBy("place")  # five rows
    falls = F.col("fidelity").isNull() | F.coalesce(F.col("fidelity") < F.lag("fidelity").over(w), F.lit(False))
    marked = both.withColumn("falls", falls)
    return marked.select("level", "fidelity", "expected_min", "expected_max", F.coalesce(F.col("fidelity").between(F.col("expected_min"), F.col("expected_max")), F.lit(False)).alias("in_range"), (~F.max("falls").over(Window.partitionBy())).alias("ranking_verified"))
