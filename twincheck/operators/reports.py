"""Reports of validation jobs: scores per job, column breakdown, chart rows, report lines, statements by standard and certificates.

Every job's report is made by the same Spark job: nothing is collected, and texts are rows (a line, or a statement) until they are written.

Defined results: a null job is a job of its own. A column without a value on one side has no score; a job without any score has fidelity 0.
A job without synthetic rows has memorization 1 and privacy 0. A null value fills a template with nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a job must reach to comply.
LEAST_FIDELITY, LEAST_PRIVACY, MOST_MEMORIZATION = 0.75, 0.80, 0.10

#: Statements by standard, with {{ name }} where a value goes.
TEMPLATES = {
    "gdpr": """Data protection statement (GDPR Articles 25 and 35) for job {{ job_id }} of tenant {{ tenant_id }}
Validated: {{ validated_at }}. Certificate: {{ certificate }}
Likeness to the personal data: {{ fidelity }} (reached: {{ fidelity_passed }})
Protection against re-identification: {{ privacy }} (reached: {{ privacy_passed }})
Reproduction of personal records: {{ memorization }} (within bounds: {{ memorization_passed }})
Compliant: {{ passed }}
""",
    "hipaa": """De-identification evidence (45 CFR 164.514(b)(1), expert determination) for job {{ job_id }} of tenant {{ tenant_id }}
Validated: {{ validated_at }}. Certificate: {{ certificate }}
Column fidelity: {{ fidelity }} (reached: {{ fidelity_passed }})
Resistance to re-identification: {{ privacy }} (reached: {{ privacy_passed }})
Membership and copies: {{ memorization }} (within bounds: {{ memorization_passed }})
Compliant: {{ passed }}
""",
    "soc2": """Processing integrity statement (SOC 2, CC7) for job {{ job_id }} of tenant {{ tenant_id }}
Validated: {{ validated_at }}. Certificate: {{ certificate }}
CC7.1 quality gate: {{ fidelity_passed }} ({{ fidelity }})
CC7.2 privacy gate: {{ privacy_passed }} ({{ privacy }})
CC7.3 memorization gate: {{ memorization_passed }} ({{ memorization }})
Compliant: {{ passed }}
""",
}


def column_likeness(rows: DataFrame, job: str, synthetic: Column, columns: list[str]) -> DataFrame:
    """(job_id, column, score): 1 - total variation between the real and the synthetic values of each column within each job.

    One pass takes all jobs and columns; a value's counts meet their totals by a join, so no job is held in one task."""
    cells = rows.select(F.col(f"`{job}`").alias("job_id"), synthetic.alias("syn"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("x")).select("job_id", "syn", "x.*")
    counts = cells.where("value IS NOT NULL").groupBy("job_id", "column", "value").agg(F.count_if(~F.col("syn")).alias("a"), F.count_if("syn").alias("b"))
    totals = cells.groupBy("job_id", "column").agg(F.count_if(~F.col("syn") & F.col("value").isNotNull()).alias("n"), F.count_if(F.col("syn") & F.col("value").isNotNull()).alias("m"))
    far = F.abs(F.try_divide("a", "n") - F.try_divide("b", "m"))
    both = totals.alias("t").join(counts.alias("c"), F.col("t.job_id").eqNullSafe(F.col("c.job_id")) & (F.col("t.column") == F.col("c.column")), "left")
    return both.groupBy("t.job_id", "t.column").agg((1 - F.sum(far) / 2).alias("score"))


def job_scores(rows: DataFrame, job: str, synthetic: Column, columns: list[str], record: list[str]) -> DataFrame:
    """(job_id, fidelity, privacy, memorization) of every job in rows.

    fidelity: mean likeness of the columns. memorization: share of synthetic rows that repeat a real record (the columns of `record`, nulls equal).
    privacy: 1 - share of synthetic rows that repeat a record which only one real row has."""
    fidelity = column_likeness(rows, job, synthetic, columns).groupBy("job_id").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("fidelity"))
    held = rows.select(F.col(f"`{job}`").alias("job_id"), synthetic.alias("syn"), F.struct(*(F.col(f"`{c}`") for c in record)).alias("r")).groupBy("job_id", "r").agg(F.count_if(~F.col("syn")).alias("a"), F.count_if("syn").alias("b"))
    share = lambda hit: F.coalesce(F.try_divide(F.sum(F.when(hit, F.col("b")).otherwise(0)), F.sum("b")), F.lit(1.0))
    risks = held.groupBy("job_id").agg((1 - share(F.col("a") == 1)).alias("privacy"), share(F.col("a") > 0).alias("memorization"))
    return fidelity.alias("f").join(risks.alias("r"), F.col("f.job_id").eqNullSafe(F.col("r.job_id"))).select("f.job_id", "fidelity", "privacy", "memorization")


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template's text with each {{ name }} replaced by a column. Names without a column stay; what is put in is not searched again."""
    parts = re.split(r"\{\{ (\w+) \}\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("{{ %s }}" % p) for i, p in enumerate(parts)))


def shown(score: Column) -> Column:
    return F.round(score, 4).cast("decimal(12,4)").cast("string")


def statements(jobs: DataFrame, standards: tuple[str, ...] = tuple(TEMPLATES)) -> DataFrame:
    """(job_id, standard, passed, report) for jobs(job_id, tenant_id, validated_at, certificate, fidelity, privacy, memorization); a null score fails."""
    unknown = set(standards) - set(TEMPLATES)
    if unknown:
        raise ValueError(f"no such standard: {sorted(unknown)}")
    reached = {
        "fidelity_passed": F.coalesce(F.col("fidelity") >= LEAST_FIDELITY, F.lit(False)),
        "privacy_passed": F.coalesce(F.col("privacy") >= LEAST_PRIVACY, F.lit(False)),
        "memorization_passed": F.coalesce(F.col("memorization") <= MOST_MEMORIZATION, F.lit(False)),
    }
    passed = reached["fidelity_passed"] & reached["privacy_passed"] & reached["memorization_passed"]
    values = {c: F.col(c) for c in ("job_id", "tenant_id", "validated_at", "certificate")} | {c: shown(F.col(c)) for c in ("fidelity", "privacy", "memorization")} | reached | {"passed": passed}
    each = F.array(*(F.struct(F.lit(s).alias("standard"), fill(TEMPLATES[s], values).alias("report")) for s in standards))
    return jobs.select("job_id", passed.alias("passed"), F.explode(each).alias("x")).select("job_id", "x.standard", "passed", "x.report")


def report_lines(metrics: DataFrame, least: float = LEAST_FIDELITY) -> DataFrame:
    """(job_id, line, text): each job's plain-text report over metrics(job_id, metric, score), a line per metric, the worst first, after two heading lines.

    A missing score comes first and fails. A job's lines are numbered together: as many as it has metrics."""
    w = Window.partitionBy("job_id").orderBy(F.col("score").asc_nulls_first(), "metric")
    ok = F.coalesce(F.col("score") >= least, F.lit(False))
    name = F.coalesce(F.col("metric"), F.lit("unknown"))
    name = F.when(F.length(name) < 32, F.rpad(name, 32, " ")).otherwise(F.concat(name, F.lit(" ")))
    body = metrics.select("job_id", (F.row_number().over(w) + 2).alias("line"), F.concat(name, F.coalesce(shown(F.col("score")), F.lit("missing")), F.when(ok, "  PASS").otherwise("  FAIL")).alias("text"))
    heads = metrics.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("good"))
    head = F.array(F.struct(F.lit(1).alias("line"), F.concat(F.lit("Validation report of job "), F.coalesce(F.col("job_id").cast("string"), F.lit("unknown"))).alias("text")), F.struct(F.lit(2).alias("line"), F.concat(F.col("good").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" metrics reached")).alias("text")))
    return body.unionByName(heads.select("job_id", F.explode(head).alias("x")).select("job_id", "x.*"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file per job below `path` (job_id=...), its lines in order."""
    lines.repartition("job_id").sortWithinPartitions("job_id", "line").select("job_id", "text").write.mode("overwrite").partitionBy("job_id").text(path)


def issue_certificates(jobs: DataFrame, path: str) -> DataFrame:
    """(tenant_id, job_id, certificate): one JSON file per passing job below `path`, and where each lies. Jobs are those of statements()."""
    good = (F.col("fidelity") >= LEAST_FIDELITY) & (F.col("privacy") >= LEAST_PRIVACY) & (F.col("memorization") <= MOST_MEMORIZATION)
    sound = jobs.where(good & F.col("job_id").isNotNull() & F.col("tenant_id").isNotNull())
    body = F.to_json(F.struct("job_id", "tenant_id", "validated_at", "fidelity", "privacy", "memorization")).alias("value")
    sound.select("tenant_id", "job_id", body).repartition("tenant_id", "job_id").write.mode("overwrite").partitionBy("tenant_id", "job_id").text(path)
    types = dict(jobs.dtypes)
    held = jobs.sparkSession.read.schema(f"value string, tenant_id {types['tenant_id']}, job_id {types['job_id']}").text(path, wholetext=True)
    return held.select("tenant_id", "job_id", F.input_file_name().alias("certificate"))


def breakdown(numeric: DataFrame, categorical: DataFrame, metrics: tuple[list[str], list[str]]) -> DataFrame:
    """(place, column, kind, metrics..., column_score): every measured metric of every column, the worst column first; a metric of the other kind is null, a missing score counts as 1."""
    both = numeric.select("column", F.lit("numeric").alias("kind"), *metrics[0], "column_score").unionByName(categorical.select("column", F.lit("categorical").alias("kind"), *metrics[1], "column_score"), allowMissingColumns=True)
    place = F.row_number().over(Window.orderBy(F.coalesce("column_score", F.lit(1.0)), "column"))  # a row per column of the datasets
    return both.select(place.alias("place"), "*")


def chart(scores: DataFrame, bins: int = 10) -> DataFrame:
    """(part, label, low, high, value) for charts over scores(category, column, score): a bar per category (its mean), a histogram on [0, 1] with every bucket,
    and total, mean, least and greatest score. Null scores are left out; without any score the figures are 0."""
    held = scores.where("score IS NOT NULL")
    bars = held.groupBy("category").agg(F.avg("score").alias("value")).select(F.lit("category").alias("part"), F.col("category").alias("label"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "value")
    own = held.where("score BETWEEN 0 AND 1").groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(own, "bin", "left")
    buckets = grid.select(F.lit("histogram").alias("part"), F.format_string("%02d", "bin").alias("label"), (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    figures = held.agg(F.count("score").cast("double").alias("total"), zero(F.avg("score")).alias("mean"), zero(F.min("score")).alias("least"), zero(F.max("score")).alias("greatest"))
    rest = figures.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in figures.columns))).alias("x")).select(F.lit("figure").alias("part"), "x.label", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "x.value")
    return bars.unionByName(buckets).unionByName(rest)
