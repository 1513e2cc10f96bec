"""Edge cases of the evaluator, the clinical column lookup and the calibration's flags."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from twincheck.operators import evaluation, health, similarity
from twincheck.operators import overall as ov


def test_kinds_and_problems(spark):
    real = spark.sql("SELECT 1 AS n, true AS b, 'x' AS t, 2.5 AS gone, 3 AS day")
    synth = spark.sql("SELECT '7' AS n, 0 AS b, 5 AS t, DATE'2020-01-01' AS day, 1 AS extra")
    assert evaluation.kinds(real, synth) == [("n", "numeric", None), ("b", "numeric", None), ("t", "categorical", None), ("gone", "numeric", "missing"), ("day", "numeric", "incompatible")]


def test_named_columns_that_a_side_lacks(spark):
    one, other = spark.sql("SELECT 1 AS n, 'x' AS t"), spark.sql("SELECT 1 AS n, DATE'2020-01-01' AS d")
    assert evaluation.kinds(one, other, ["d", "t", "gone", "n"]) == [("d", "datetime", "missing"), ("t", "categorical", "missing"), ("gone", "categorical", "missing"), ("n", "numeric", None)]


def test_times_are_numbers(spark):
    real = spark.sql("SELECT TIMESTAMP_NTZ'1970-01-01 00:00:01' AS a, DATE'1970-01-02' AS b, TIMESTAMP_NTZ'1969-12-31 23:59:59.5' AS c")
    synth = spark.sql("SELECT '1970-01-01 00:00:02' AS a, TIMESTAMP_NTZ'1970-01-03 00:00:00' AS b, 'no time' AS c")
    found = evaluation.kinds(real, synth)
    assert {k for _, k, _ in found} == {"datetime"}
    assert tuple(evaluation.comparable(real, found).first()) == (1e6, 86400e6, -5e5)
    assert tuple(evaluation.comparable(synth, found).first()) == (2e6, 2 * 86400e6, None)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3000, 4))
    data = base @ rng.normal(size=(4, 100)) + rng.normal(size=(3000, 100)) + 1e6
    data[rng.random(data.shape) < 0.1] = np.nan
    data[:, 7], data[:, 8] = 0.1, np.nan
    data[:5, 9] = np.inf
    names = [f"c|{k}" for k in range(100)]
    df = spark.createDataFrame(pd.DataFrame(data, columns=names)).repartition(5)
    got = {(r["a"], r["b"]): r for r in similarity.correlation_similarity(df, df, names).collect()}
    data[~np.isfinite(data)] = np.nan
    want = pd.DataFrame(data, columns=names).corr().to_numpy()
    assert len(got) == 4950
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        r = got[a, b]
        if {i, j} & {7, 8}:
            assert r["corr_real"] is None and r["score"] is None
        else:
            assert abs(r["corr_real"] - want[i, j]) < 1e-6 and r["score"] == 1.0


def test_contingency_keeps_names_and_nulls(spark):
    real = spark.createDataFrame([("x", None, "1"), ("x", "", "1"), (None, "q", "2")], "`a|b` string, c string, d string")
    synth = spark.createDataFrame([("x", None, "1"), ("x", None, "2")], "`a|b` string, c string, d string")
    got = {(r["a"], r["b"]): r["score"] for r in similarity.contingency_similarity(real, synth, ["a|b", "c", "d"]).collect()}
    assert got == {("a|b", "c"): pytest.approx(1 / 3), ("a|b", "d"): pytest.approx(0.5), ("c", "d"): pytest.approx(1 / 3)}
    assert similarity.contingency_similarity(real, synth, ["c"]).count() == 0


def by_place(df):
    return {(r["part"], r["metric"], r["column"], r["other"]): (r["status"], r["score"]) for r in df.collect()}


def test_whole_evaluation(spark):
    rows = [(i, float(i % 50), f"2024-01-{1 + i % 28:02d}", "ab"[i % 2], "pqr"[i % 3], 5.0, None) for i in range(400)]
    kind = "id long, x double, day string, c string, d string, same double, void string"
    real = spark.createDataFrame(rows, kind).withColumn("day", evaluation.F.to_date("day"))
    got = by_place(evaluation.evaluate_all(real, real.drop("d"), key="id", columns=["x", "day", "c", "d", "same", "void"]))
    assert got["marginal", "ks_complement", "day", ""] == ("scored", 1.0)
    assert got["marginal", "tv_complement", "d", ""] == ("missing", None)
    assert got["marginal", "tv_complement", "void", ""] == ("empty", None)
    assert got["pairwise", "correlation", "x", "day"] == ("scored", 1.0)
    assert got["pairwise", "correlation", "x", "same"] == ("undefined", None)
    assert got["pairwise", "contingency", "c", "void"] == ("scored", 1.0)
    assert got["table_level", "new_row_synthesis", "", ""] == ("scored", 0.0)
    assert got["table_level", "logistic_detection", "", ""] == ("empty", None)  # no row without a null
    assert got["quality", "column_shapes", "", ""] == got["quality", "pair_trends", "", ""] == got["overall", "score", "", ""] == ("scored", 1.0)
    assert got["table_level", "score", "", ""] == ("scored", 0.0)


def test_detection_within_the_evaluation(spark):
    real = spark.createDataFrame([(i, float(i % 97), "ab"[i % 2]) for i in range(600)], "id long, x double, c string")
    far = real.selectExpr("id", "x + 1000 AS x", "c")
    got = by_place(evaluation.evaluate_all(real, far, most=500, key="id"))
    assert got["table_level", "logistic_detection", "", ""][1] < 0.05 and got["table_level", "new_row_synthesis", "", ""] == ("scored", 1.0)
    assert got["marginal", "ks_complement", "x", ""] == ("scored", 0.0) and ("marginal", "ks_complement", "id", "") not in got
    near = by_place(evaluation.evaluate_all(real, real.selectExpr("id", "x + 0.4 AS x", "c"), ["x", "c"], detect=False, tolerances={"x": 0.5}))
    assert near["table_level", "new_row_synthesis", "", ""] == ("scored", 0.0) and ("table_level", "logistic_detection", "", "") not in near
    with pytest.raises(ValueError):
        evaluation.evaluate_all(real, far, most=5)


def test_whole_evaluation_of_empty_and_of_disjoint_tables(spark):
    empty = spark.createDataFrame([], "x double, c string, d string")
    got = by_place(evaluation.evaluate_all(empty, empty))
    assert {s for s, _ in got.values()} == {"empty"} and got["overall", "score", "", ""] == ("empty", 0.0)
    got = by_place(evaluation.evaluate_all(empty, spark.createDataFrame([(1,)], "z int")))
    assert {s for (p, m, *_), (s, _) in got.items() if m != "score" and p != "quality"} == {"missing"}


def test_evaluate_names_what_it_cannot_score(spark):
    real = spark.createDataFrame([(1.0, "a", None), (2.0, "b", None), (None, None, None)], "x double, c string, e double")
    got = {(r["column"], r["kind"]): (r["status"], r["score"]) for r in evaluation.evaluate(real, real).collect()}
    assert got["x", "numeric"][0] == got["c", "categorical"][0] == "scored" and got["e", "numeric"] == ("empty", None)
    assert abs(got["", "table"][1] - (got["x", "numeric"][1] + got["c", "categorical"][1]) / 2) < 1e-12
    assert got["c", "categorical"][1] > 0.999


def test_evaluate_of_empty_and_of_disjoint_tables(spark):
    empty = spark.createDataFrame([], "x double, c string")
    assert {r["column"]: (r["status"], r["score"]) for r in evaluation.evaluate(empty, empty).collect()} == {"x": ("empty", None), "c": ("empty", None), "": ("empty", 0.0)}
    other = spark.createDataFrame([(1,)], "z int")
    assert {r["status"] for r in evaluation.evaluate(empty, other).where("kind <> 'table'").collect()} == {"missing"}


def test_clinical_columns(spark):
    df = spark.createDataFrame([(250.0, "p", "n/a")], "Total_Cholesterol_mg_dl double, who string, bmi string")
    assert health.columns_of(df, "total_cholesterol_mg_dl") == ["Total_Cholesterol_mg_dl"]
    assert health.columns_of(df, "patient_id", {"who": "patient_id", "absent": "patient_id"}) == ["who"]
    assert [tuple(r) for r in health.labs(df).collect()] == [("total_cholesterol_mg_dl", "Total_Cholesterol_mg_dl", 1, 1.0), ("overall", None, 1, 1.0)]
    assert [tuple(r) for r in health.labs(df.select("who")).collect()] == [("overall", None, 0, 0.8)]
    assert [tuple(r) for r in health.labs(df.select("bmi")).collect()] == [("overall", None, 0, 0.8)]
    assert [tuple(r) for r in health.medication_safety(df).collect()] == [(0, 0, 1.0)]


def test_medications_of_one_patient(spark):
    df = spark.createDataFrame([(1, "Warfarin"), (1, "ASPIRIN 100"), (2, "warfarin"), (3, None)], "patient_id int, drug string")
    assert tuple(health.medication_safety(df).first()) == (3, 1, 0.0)


def test_calibration_flags(spark):
    scores = dict(zip(ov.EXPECTED, [0.2, 0.5, 0.6, 0.8, 0.9], strict=True))
    rows = lambda held: {r["level"]: (r["in_range"], r["ranking_verified"]) for r in ov.calibrated(spark.createDataFrame(list(held.items()), "level string, fidelity double")).collect()}
    assert set(rows(scores).values()) == {(True, True)}
    assert rows(scores | {"gaussian_copula": 0.95})["gaussian_copula"] == (False, False)
    del scores["random_noise"]
    assert rows(scores)["random_noise"] == (False, False)
