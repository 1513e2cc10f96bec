"""Clinical plausibility: ranges, codes, laboratory values, medication pairs and FHIR bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Critical bounds per laboratory value (inclusive), required FHIR fields, code formats, contraindicated pairs.
LAB_BOUNDS = {
    "glucose_mg_dl": (40.0, 500.0),
    "hba1c_percent": (2.0, 15.0),
    "creatinine_mg_dl": (0.2, 15.0),
    "sodium_meq_l": (100.0, 170.0),
    "potassium_meq_l": (2.0, 8.0),
    "hemoglobin_g_dl": (5.0, 25.0),
    "wbc_k_ul": (0.5, 100.0),
    "platelet_k_ul": (20.0, 2000.0),
    "alt_u_l": (0.0, 1000.0),
    "ast_u_l": (0.0, 1000.0),
    "total_cholesterol_mg_dl": (50.0, 600.0),
    "ldl_mg_dl": (10.0, 500.0),
    "bmi": (10.0, 70.0),
    "systolic_bp_mmhg": (60.0, 250.0),
    "diastolic_bp_mmhg": (30.0, 150.0),
    "heart_rate_bpm": (20.0, 250.0),
    "temperature_f": (90.0, 107.0),
    "oxygen_saturation_percent": (70.0, 100.0),
}
FHIR_FIELDS = {
    "Patient": ["id", "resourceType"],
    "Condition": ["id", "resourceType", "subject", "clinicalStatus"],
    "Observation": ["id", "resourceType", "status", "code", "subject"],
    "MedicationRequest": ["id", "resourceType", "status", "intent", "subject"],
    "Encounter": ["id", "resourceType", "status", "subject"],
    "DiagnosticReport": ["id", "resourceType", "status", "code", "subject"],
}
ICD10 = r"^[A-Z][0-9]{2}(\.[A-Z0-9]{1,4})?$"
CPT = r"^[0-9]{5}[FUMT]?$"


def number(c: str) -> Column:
    """The column as a number; text that is none becomes null."""
    return F.expr(f"try_cast(`{c}` AS DOUBLE)")


def share_within(c: str, low: float, high: float) -> Column:
    """Aggregate: the share of non-null values within bounds, both included."""
    v = number(c)
    return F.avg(F.when(v.isNotNull() & ~F.isnan(v), v.between(low, high).cast("double")))


def ranges(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, share) of every bounded column that df has, in one aggregate. LAB_BOUNDS gives the laboratory check."""
    own = {c: b for c, b in bounds.items() if c in df.columns}
    if not own:
        return df.sparkSession.createDataFrame([], "column string, share double")
    one = df.agg(*(share_within(c, *b).alias(f"r{i}") for i, (c, b) in enumerate(own.items())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("share")) for i, c in enumerate(own)))).alias("x")).select("x.*")


def greater(df: DataFrame, high: str, low: str) -> DataFrame:
    """(share) of rows with high > low among those that have both, as systolic and diastolic pressure."""
    a, b = number(high), number(low)
    return df.agg(F.avg(F.when(a.isNotNull() & b.isNotNull(), (a > b).cast("double"))).alias("share"))


def codes(df: DataFrame, column: str, pattern: str, upper: bool) -> DataFrame:
    """(n, valid, share) of codes that match a format as a whole, after trimming and, if asked, upper-casing."""
    c = F.trim(F.col(f"`{column}`").cast("string"))
    c = F.upper(c) if upper else c
    return df.where(F.col(f"`{column}`").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(c.rlike(pattern)).alias("valid")).withColumn("share", F.try_divide("valid", "n"))


def prefix(column: str) -> Column:
    return F.substring(F.col(f"`{column}`").cast("string"), 1, 1)


def pair_safety(df: DataFrame, patient: str, drug: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(patients, flags, score): flags count (patient, pair) combinations. The two flags per pair aggregate map-side; no list per patient."""
    name = F.lower(F.col(f"`{drug}`").cast("string"))
    has = lambda s: F.coalesce(F.max(name.contains(s)), F.lit(False))
    own = df.where(F.col(f"`{patient}`").isNotNull()).groupBy(patient).agg(*((has(a) & has(b)).cast("int").alias(f"f{i}") for i, (a, b) in enumerate(pairs)))
    got = own.agg(F.count(F.lit(1)).alias("patients"), F.coalesce(F.sum(sum((F.col(f"f{i}") for i in range(len(pairs))), F.lit(0))), F.lit(0)).alias("flags"))
    return got.withColumn("score", F.greatest(F.lit(0.0), 1 - 10 * F.coalesce(F.try_divide("flags", "patients"), F.lit(0.0))))


def bundles(df: DataFrame, column: str = "bundle") -> DataFrame:
    """(total, invalid, score) over the resources of FHIR bundles in JSON. A missing key makes a resource invalid; null values count as present. A malformed bundle adds one invalid resource."""
    sound = (F.get_json_object(column, "$.resourceType") == "Bundle") & F.get_json_object(column, "$.entry").startswith("[")
    rows = df.select(F.col(column), F.coalesce(sound, F.lit(False)).alias("sound"))
    inner = rows.where("sound").select(F.explode(F.from_json(F.get_json_object(column, "$.entry"), "array<struct<resource:string>>")).alias("e")).select(F.col("e.resource").alias("r"))
    need = F.create_map(*(x for k, v in FHIR_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    wanted = F.coalesce(F.try_element_at(need, F.coalesce(F.get_json_object("r", "$.resourceType"), F.lit(""))), F.array(F.lit("id"), F.lit("resourceType")))
    bad = F.size(F.array_except(wanted, F.coalesce(F.json_object_keys("r"), F.array().cast("array<string>")))) > 0
    a = inner.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("wrong"))
    b = rows.agg(F.count_if(~F.col("sound")).alias("broken"))
    return a.join(b).select("total", (F.col("wrong") + F.col("broken")).alias("invalid"), (1 - (F.col("wrong") + F.col("broken")) / F.greatest("total", F.lit(1))).alias("score"))


# Medications that must not meet in one patient, by parts of their names.
CONTRAINDICATED = [("warfarin", "aspirin"), ("warfarin", "ibuprofen"), ("maoi", "ssri"), ("maoi", "tramadol"), ("metformin", "contrast_dye"), ("sildenafil", "nitrate")]
NO_LABS = 0.8


def columns_of(df: DataFrame, kind: str, named: dict[str, str] | None = None) -> list[str]:
    """Columns of a clinical kind: those that `named` (column to kind) gives it, else those whose name contains it, underscores as spaces."""
    given = [c for c, k in (named or {}).items() if k == kind and c in df.columns]
    return given or [c for c in df.columns if kind.replace("_", " ").lower() in c.replace("_", " ").lower()]


def labs(df: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    """(lab, column, n, share within the critical bounds) of each laboratory value that has a column with numbers, and a row of lab
    `overall` with the mean share, 0.8 without any. One aggregate over df."""
    own = {lab: found[0] for lab in LAB_BOUNDS if (found := columns_of(df, lab, named))}
    kind = "lab string, column string, n long, share double"
    if not own:
        return df.sparkSession.createDataFrame([("overall", None, 0, NO_LABS)], kind)
    usable = lambda c: number(c).isNotNull() & ~F.isnan(number(c))
    one = df.agg(*(F.count_if(usable(c)).alias(f"n{i}") for i, c in enumerate(own.values())), *(share_within(c, *LAB_BOUNDS[lab]).alias(f"s{i}") for i, (lab, c) in enumerate(own.items())))
    cells = F.array(*(F.struct(F.lit(lab).alias("lab"), F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("share")) for i, (lab, c) in enumerate(own.items())))
    held = F.filter(cells, lambda x: x["n"] > 0)
    total = F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    mean = F.coalesce(F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, x: a + x["share"]), F.size(held)), F.lit(NO_LABS))
    whole = F.struct(F.lit("overall").alias("lab"), F.lit(None).cast("string").alias("column"), total.alias("n"), mean.alias("share"))
    return one.select(F.explode(F.concat(held, F.array(whole))).alias("x")).select("x.*")


def medication_safety(df: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    """pair_safety of the contraindicated pairs over the medication (else drug) and patient_id columns; no flag and score 1 if either is missing."""
    drug, patient = columns_of(df, "medication", named) or columns_of(df, "drug", named), columns_of(df, "patient_id", named)
    if not drug or not patient:
        return df.sparkSession.createDataFrame([(0, 0, 1.0)], "patients long, flags long, score double")
    return pair_safety(df, patient[0], drug[0], CONTRAINDICATED)
