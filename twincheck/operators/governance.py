"""Contracts, regression against baselines, verdicts and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGRESSION_DROP = 0.05


def check_thresholds(thresholds: dict[str, float]) -> dict[str, float]:
    wrong = {k: v for k, v in thresholds.items() if not 0 <= v <= 1}
    if wrong:
        raise ValueError(f"thresholds outside [0, 1]: {wrong}")
    return thresholds


#: Assertion kinds of a contract: each turns its arguments into a column that is true for a violating row.
ASSERTIONS = {
    "not_null": lambda column: F.col(column).isNull(),
    "between": lambda column, low, high: F.col(column).isNotNull() & ~F.col(column).between(low, high),
    "in_set": lambda column, values: F.col(column).isNotNull() & ~F.col(column).isin(*values),
    "matches": lambda column, pattern: F.col(column).isNotNull() & ~F.col(column).rlike(pattern),
}


def run_contract(df: DataFrame, assertions: list[dict]) -> DataFrame:
    """(name, violations, passed, success_percent) of a contract, in one aggregate. "unique" assertions add one grouped pass each."""
    rows = [a for a in assertions if a["kind"] != "unique"]
    one = df.agg(*(F.count_if(F.coalesce(ASSERTIONS[a["kind"]](**a["args"]), F.lit(False))).alias(f"a{i}") for i, a in enumerate(rows)), F.lit(0).alias("none"))
    got = one.select(F.explode(F.array(F.struct(F.lit("").alias("name"), F.lit(0).cast("long").alias("violations")), *(F.struct(F.lit(a["name"]).alias("name"), F.col(f"a{i}").alias("violations")) for i, a in enumerate(rows)))).alias("x")).select("x.*").where("name <> ''")
    for a in assertions:
        if a["kind"] == "unique":
            twice = df.groupBy(*a["args"]["columns"]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            got = got.unionByName(twice.agg(F.lit(a["name"]).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))
    w = Window.partitionBy(F.lit(1))  # a row per assertion
    passed = F.col("violations") == 0
    return got.select("name", "violations", passed.alias("passed"), (100.0 * F.count_if(passed).over(w) / F.count(F.lit(1)).over(w)).alias("success_percent"))


def current_baselines(baselines: DataFrame) -> DataFrame:
    """Of recorded baselines (model_version, recorded_at, scores) the latest of each version."""
    return baselines.groupBy("model_version").agg(F.max_by("scores", "recorded_at").alias("scores"), F.max("recorded_at").alias("recorded_at"))


def regressions(scores: DataFrame, baseline: DataFrame, drop: float = REGRESSION_DROP) -> DataFrame:
    """(category, baseline, current, drop, regressed) of the categories that both have."""
    both = scores.select("category", F.col("score").alias("current")).join(F.broadcast(baseline.select("category", F.col("score").alias("baseline"))), "category")
    lost = F.round(F.col("baseline") - F.col("current"), 12)
    return both.select("category", "baseline", "current", lost.alias("drop"), (lost > drop).alias("regressed"))


def full_score(fidelity: Column, privacy_passed: Column, memorization_passed: Column, least: float = 0.82) -> list[Column]:
    """The combined score and its pass."""
    score = 0.6 * fidelity + 0.2 * privacy_passed.cast("double") + 0.2 * memorization_passed.cast("double")
    return [score.alias("overall_score"), ((fidelity >= least) & privacy_passed & memorization_passed).alias("passed")]


def worst_columns(scores: DataFrame, n: int = 20) -> DataFrame:
    """The n columns of lowest score; a missing score counts as 1."""
    return scores.select("column", F.coalesce("column_score", F.lit(1.0)).alias("score")).orderBy("score", "column").limit(n)


def score_histogram(scores: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n) of scores within [0, 1], every bin present."""
    own = scores.where(F.col("score").between(0, 1)).groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(own, "bin", "left").fillna(0, ["n"])


def report_json(report: DataFrame) -> DataFrame:
    """(report): all rows of a report of one row per metric as one JSON text."""
    return report.agg(F.to_json(F.struct(F.lit("1.0").alias("version"), F.sort_array(F.collect_list(F.struct(*report.columns))).alias("rows"))).alias("report"))


def executive_summary(report: DataFrame) -> DataFrame:
    """From (fidelity, singling_out, linkability, inference, auc): verdict, its explanation, and each part's pass.

    A missing value fails, as a missing risk counts as 1."""
    over = [F.when(F.coalesce(F.col(c), F.lit(1.0)) > most, f"{words} risk too high") for c, most, words in (("singling_out", 0.05, "singling-out"), ("linkability", 0.10, "linkability"), ("inference", 0.15, "inference"))]
    failing, auc = F.concat_ws(", ", *over), F.coalesce(F.col("auc"), F.lit(1.0))
    out = report.select("*", (F.coalesce(F.col("fidelity"), F.lit(0.0)) >= 0.82).alias("fidelity_passed"), (failing == "").alias("privacy_passed"), (auc < 0.60).alias("memorization_passed"))
    why = F.concat_ws(
        "; ",
        F.when(~F.col("fidelity_passed"), "Fidelity score below threshold (0.82)"),
        F.when(~F.col("privacy_passed"), F.concat(F.lit("Privacy thresholds failed: "), failing)),
        F.when(~F.col("memorization_passed"), F.format_string("Memorization AUC (%.3f) exceeds threshold (0.60)", auc)),
    )
    passed = F.col("fidelity_passed") & F.col("privacy_passed") & F.col("memorization_passed")
    return out.select(F.when(passed, "PASS").otherwise("FAIL").alias("verdict"), F.when(passed, "All fidelity, privacy, and memorization thresholds met.").otherwise(why).alias("explanation"), "fidelity_passed", "privacy_passed", "memorization_passed")


def dashboard(report: DataFrame) -> DataFrame:
    """(metric, score, threshold, passed) from (fidelity, overall_risk, auc): higher is better in every row; a missing score is null and fails."""
    rows = (("Overall Fidelity", F.col("fidelity"), 0.75), ("Privacy Safety", 1 - F.col("overall_risk"), 0.80), ("Memorization Resistance", 1 - F.col("auc"), 0.40))
    return report.select(F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), score.alias("score"), F.lit(least).alias("threshold"), F.coalesce(F.round(score, 12) >= least, F.lit(False)).alias("passed")) for name, score, least in rows))).alias("x")).select("x.*")
