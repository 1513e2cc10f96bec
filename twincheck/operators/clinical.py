"""The clinical evaluation from two frames to one score: it finds its columns by name, measures each part and weighs them.

Defined results: a check whose columns are absent, or hold no value, has no row and enters no mean; a part without any check has
0.5 (clinical realism, codes), 0.8 (laboratory values) or 1 (medication). Bundles of no rows are as none given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialised
from . import frequency as fq
from . import health, overall
from .evaluation import kind_of

#: Plausible ages, the values a side needs before its distribution counts.
AGES = (0.0, 120.0)
LEAST = 11


def _first(df: DataFrame, named: dict[str, str] | None, *wanted: str) -> str | None:
    """The first column of the first of these clinical kinds that has one."""
    return next((c[0] for k in wanted if (c := health.columns_of(df, k, named))), None)


def _row(one: DataFrame, part: str, check: str, score) -> DataFrame:
    return one.select(F.lit(part).alias("part"), F.lit(check).alias("check"), score.cast("double").alias("score"))


def distribution_similarity(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(score): the mean of 1 - KS over the numeric columns of both sides with more than ten values on each; null without one."""
    numeric = lambda df: {c for c in df.columns if kind_of(df.schema[c].dataType) == "numeric"}
    both = [c for c in real.columns if c in numeric(real) & numeric(synth)]
    if not both:
        return real.sparkSession.createDataFrame([(None,)], "score double")
    found = fq.profile(fq.ordered(fq.frequency(real, synth, both)), LEAST)
    return found.agg(F.avg(1 - F.col("ks")).alias("score"))


def prefix_similarity(real: DataFrame, synth: DataFrame, column: str) -> DataFrame:
    """(score): 1 - total variation of the codes' first characters; a half if only the synthetic side has codes, null if it has none."""
    first = health.prefix(column)
    side = lambda df, sign: df.select(first.alias("p"), F.lit(sign).alias("sign")).where("p IS NOT NULL").groupBy("p", "sign").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("sign") * F.col("n") / F.sum("n").over(Window.partitionBy("sign"))  # a row per first character
    apart = side(real, 1).unionByName(side(synth, -1)).select("p", "sign", share.alias("share")).groupBy("p").agg(F.sum("share").alias("d"), F.min("sign").alias("sign"))
    return apart.agg(F.when(F.min("sign") < 0, 1 - 0.5 * F.sum(F.abs("d"))).alias("score"))


def checks(real: DataFrame, synth: DataFrame, named: dict[str, str] | None = None, bundles: DataFrame | None = None) -> DataFrame:
    """(part, check, score) of every check that found its columns; scores may be null."""
    out: list[DataFrame] = []
    age, high, low = (_first(synth, named, k) for k in ("age", "systolic_bp", "diastolic_bp"))
    if age and kind_of(synth.schema[age].dataType) == "numeric":
        out.append(_row(synth.agg(health.share_within(age, *AGES).alias("s")), "clinical", "age_plausibility", F.col("s")))
    if high and low:
        out.append(_row(health.greater(synth, high, low), "clinical", "systolic_above_diastolic", F.col("share")))
    out.append(_row(distribution_similarity(real, synth), "clinical", "distribution_similarity", F.col("score")))
    icd, cpt = _first(synth, named, "icd10", "diagnosis_code"), _first(synth, named, "cpt", "procedure_code")
    if icd:
        out.append(_row(health.codes(synth, icd, health.ICD10, upper=True), "codes", "icd10_validity", F.col("share")))
        if icd in real.columns:
            out.append(_row(prefix_similarity(real, synth, icd), "codes", "icd10_prefixes", F.col("score")))
    if cpt:
        out.append(_row(health.codes(synth, cpt, health.CPT, upper=False), "codes", "cpt_validity", F.col("share")))
    out.append(_row(health.labs(synth, named).where("lab = 'overall'"), "labs", "lab_plausibility", F.col("share")))
    out.append(_row(health.medication_safety(synth, named), "medication", "medication_safety", F.col("score")))
    if bundles is not None:
        out.append(_row(health.bundles(bundles).where("total + invalid > 0"), "fhir", "fhir_validation", F.col("score")))
    return reduce(DataFrame.unionByName, out)


def healthcare(real: DataFrame, synth: DataFrame, named: dict[str, str] | None = None, bundles: DataFrame | None = None) -> DataFrame:
    """(part, check, score): the checks with a score, then a row of check `score` for each part and for `overall`, their weighted sum.

    `named` gives columns a clinical kind, as health.columns_of takes it. Bundles, a frame with JSON in the column `bundle`, add the
    FHIR part and change the weights."""
    rows = materialised(checks(real, synth, named, bundles).where("score IS NOT NULL"))  # ten rows at most
    parts = ["clinical", "codes", "labs", "medication", "fhir"]
    one = rows.agg(*(F.coalesce(F.avg(F.when(F.col("part") == p, F.col("score"))), F.lit(0.5) if p in ("clinical", "codes") else F.lit(None).cast("double")).alias(p) for p in parts))
    weigh = lambda kind: overall.overall_score(kind, {p: F.col(p) for p in overall.WEIGHTS[kind]})
    total = F.when(F.col("fhir").isNull(), weigh("healthcare")).otherwise(weigh("healthcare_with_bundles"))
    cells = F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("score")) for p in parts), F.struct(F.lit("overall").alias("part"), total.alias("score")))
    whole = one.select(F.explode(cells).alias("x")).select("x.part", F.lit("score").alias("check"), "x.score").where("score IS NOT NULL")
    return rows.unionByName(whole)
