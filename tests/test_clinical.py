"""Edge cases of the clinical evaluation."""

import pytest

from twincheck.operators import clinical


def got(df):
    return {(r["part"], r["check"]): r["score"] for r in df.collect()}


def test_without_clinical_columns(spark):
    df = spark.createDataFrame([("a",)], "x string")
    out = got(clinical.healthcare(df, df))
    assert out == {("labs", "lab_plausibility"): 0.8, ("medication", "medication_safety"): 1.0, ("clinical", "score"): 0.5, ("codes", "score"): 0.5, ("labs", "score"): 0.8, ("medication", "score"): 1.0, ("overall", "score"): pytest.approx(0.35 * 0.5 + 0.25 * 0.5 + 0.25 * 0.8 + 0.15)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "age int, systolic_bp int, diastolic_bp int, icd10 string, cpt string")
    out = got(clinical.healthcare(df, df, bundles=spark.createDataFrame([], "bundle string")))
    assert set(out) == {("labs", "lab_plausibility"), ("medication", "medication_safety"), *((p, "score") for p in ("clinical", "codes", "labs", "medication", "overall"))}


def test_columns_by_name_and_by_kind(spark):
    real = spark.createDataFrame([(float(i), "E11") for i in range(12)], "years double, dx string")
    synth = spark.createDataFrame([(float(i) if i < 6 else 200.0, "E11" if i < 6 else "I10") for i in range(12)], "years double, dx string")
    out = got(clinical.healthcare(real, synth, {"years": "age", "dx": "icd10"}))
    assert out["clinical", "age_plausibility"] == 0.5 and out["clinical", "distribution_similarity"] == 0.5
    assert out["codes", "icd10_validity"] == 1.0 and out["codes", "icd10_prefixes"] == 0.5 and out["codes", "score"] == 0.75
    few = got(clinical.healthcare(real.limit(5), synth, {"years": "age"}))
    assert ("clinical", "distribution_similarity") not in few


def test_codes_of_one_side_only(spark):
    codes = spark.createDataFrame([("E11",), (None,)], "icd10 string")
    none = spark.createDataFrame([(None,)], "icd10 string")
    assert clinical.prefix_similarity(none, codes, "icd10").first()[0] == 0.5
    assert clinical.prefix_similarity(codes, none, "icd10").first()[0] is None
    assert ("codes", "icd10_validity") not in got(clinical.healthcare(codes, none))


def test_bundles_change_the_weights(spark):
    df = spark.createDataFrame([("a",)], "x string")
    bad = spark.createDataFrame([("no json",), ('{"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "1"}}]}',)], "bundle string")
    out = got(clinical.healthcare(df, df, bundles=bad))
    assert out["fhir", "score"] == 0.0 and out["overall", "score"] == pytest.approx(0.3 * 0.5 + 0.2 * 0.5 + 0.2 * 0.8 + 0.1)
