"""Edge cases: nulls, NaN, constants, empty sides, and values checked by hand."""

import math
import os

import numpy as np

from twincheck.functions.scores import upper_gamma
from twincheck.operators import frequency as fq
from twincheck.operators import governance, health, media, privacy, similarity, statistics, text
from twincheck.sources import datasets


def two(spark, a, b, schema="x double"):
    return spark.createDataFrame([(v,) for v in a], schema), spark.createDataFrame([(v,) for v in b], schema)


def test_nulls_and_nan_are_left_out(spark):
    got = fq.numeric_scores(*two(spark, [1.0, 2.0, None, math.nan], [1.0, 2.0, None]), ["x"]).first()
    assert (got["n_real"], got["n_synth"], got["ks"], got["column_score"]) == (2, 2, 0.0, 1.0)


def test_constant_column(spark):
    got = fq.numeric_scores(*two(spark, [3.0] * 4, [3.0] * 5), ["x"]).first()
    assert got["column_score"] == 1.0 and got["kl"] == 0.0


def test_empty_side_gives_no_row(spark):
    assert fq.numeric_scores(*two(spark, [1.0], []), ["x"]).count() == 0


def test_ks_and_wasserstein_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(0, 1, 500), 1), np.round(rng.normal(0.3, 1.2, 400), 1)
    got = fq.numeric_scores(*two(spark, a.tolist(), b.tolist()), ["x"]).first()
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (a, b))
    assert math.isclose(got["ks"], np.abs(fa - fb).max())
    assert math.isclose(got["wasserstein"], (np.abs(fa - fb)[:-1] * np.diff(grid)).sum())
    assert math.isclose(got["q25_real"], np.quantile(a, 0.25), abs_tol=1e-12)


def test_chi_squared_tail():
    assert math.isclose(upper_gamma(0.5, 3.841458820694124 / 2), 0.05, rel_tol=1e-9)
    assert math.isclose(upper_gamma(5, 18.307038053275146 / 2), 0.05, rel_tol=1e-9)


def test_categories(spark):
    got = fq.categorical_scores(*two(spark, ["a", "a", "b", None], ["a", "c"], "x string"), ["x"]).first()
    assert math.isclose(got["tv_distance"], 0.5) and got["coverage"] == 0.5 and got["adherence"] == 0.5 and got["dof"] == 2


def test_shift_is_rejected(spark):
    got = statistics.numeric_tests(*two(spark, [float(i) for i in range(200)], [float(i + 150) for i in range(200)]), ["x"])
    assert got.first()["ks_pvalue"] < 1e-6


def test_new_rows_nulls_are_equal(spark):
    got = similarity.new_rows(*two(spark, [None, 1.0], [None, 2.0]), ["x"]).first()
    assert (got["n_synth"], got["n_new"]) == (2, 1)


def test_singling_out(spark):
    got = privacy.singling_out(*two(spark, [1.0, None], [1.0, None, 5.0, 5.0]), ["x"]).first()
    assert (got["matched"], got["total"], got["risk"]) == (2, 4, 0.5)
    assert privacy.singling_out(*two(spark, [1.0], []), ["x"]).first()["risk"] == 0.0


def test_verdict_without_a_risk_fails(spark):
    got = privacy.verdict(spark.createDataFrame([(0.0, 0.0, None)], "singling_out double, linkability double, inference double")).first()
    assert not got["passed"] and got["overall_risk"] == 0.25


def test_subsequence():
    assert text.subsequence("a b c d".split(), "b d x".split()) == 2
    assert text.subsequence([], ["a"]) == 0


def test_fhir(spark):
    rows = [('{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":null}},{"resource":{"resourceType":"Condition","id":"1"}},{"resource":{"id":"2"}}]}',), ("nonsense",), (None,)]
    got = health.bundles(spark.createDataFrame(rows, "bundle string")).first()
    assert (got["total"], got["invalid"]) == (3, 4)


def test_frechet_of_equal_sides_is_zero(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(v.tolist(),) for v in rng.normal(size=(50, 4))], "v array<double>")
    mean, cov = media.covariance(df, "v", 4)
    data = np.array([r["v"] for r in df.collect()])
    assert np.allclose(mean, data.mean(axis=0)) and np.allclose(cov, np.cov(data.T))
    assert media.frechet(df, df, "v", 4).first()["distance"] < 1e-6


def test_listening_score_of_a_tone(spark):
    t = np.arange(16_000) / 16_000
    df = spark.createDataFrame([(1, (0.5 * np.sin(2 * np.pi * 440 * t)).tolist()), (2, [0.1] * 10)], "pos long, v array<double>")
    got = media.listening_score(df).collect()
    assert len(got) == 1 and got[0]["mos"] > 3.9


def test_contract_thresholds():
    assert governance.check_thresholds({"fidelity": 0.5}) == {"fidelity": 0.5}
    try:
        governance.check_thresholds({"fidelity": 1.5})
    except ValueError:
        return
    raise AssertionError


def test_load_cap_and_latest(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    df.write.csv(str(tmp_path / "a.csv"), header=True)
    back = datasets.load(spark, str(tmp_path / "a.csv"))
    one, two_ = (sorted(r["k"] for r in datasets.capped(x, "k", 10).collect()) for x in (df.repartition(7), df.coalesce(1)))
    assert back.count() == 100 and one == two_ and len(one) == 10
    datasets.record(spark.createDataFrame([("a", 1, "running"), ("a", 2, "done")], "job_id string, updated_at long, status string"), str(tmp_path / "jobs"))
    assert [r["status"] for r in datasets.latest(spark.read.parquet(str(tmp_path / "jobs"))).collect()] == ["done"]
    datasets.publish(df, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out")


def test_frames_after_the_first_hundreds_count(spark):
    real = spark.createDataFrame([(i, [10.0, 20.0, 30.0]) for i in range(1, 302)], "pos long, v array<double>")
    synth = spark.createDataFrame([(i, [10.0, 20.0, 30.0] if i < 301 else [250.0, -10.0, -40.0]) for i in range(1, 302)], "pos long, v array<double>")
    assert media.frame_error(real, synth).first()["mse"] > 0
    assert media.flow_consistency(real, synth).first()["score"] < 1
    assert media.temporal_coherence(real, synth).first()["score"] < 1
    assert media.scene_cuts(real, synth).first()["n_synth"] == 1
    assert text.coherence(synth).first()["coherence"] < text.coherence(real).first()["coherence"]


def test_no_row_or_column_is_left_out(spark):
    names = [f"c{i}" for i in range(12)]
    schema = "k long, " + ", ".join(f"{c} double" for c in names)
    real = spark.createDataFrame([(i, *[float(i % (3 + j)) for j in range(12)]) for i in range(60)], schema)
    last = real.withColumn("c11", -real.c11 - 1)
    assert privacy.singling_out(real, last, names).first()["matched"] == 0
    assert similarity.correlation_similarity(real, last, names).count() == 66
    assert similarity.contingency_similarity(real, last, names[:7]).count() == 21
    own, other = spark.createDataFrame([(5000, 1.0)], "k long, x double"), spark.range(1, 5001).selectExpr("id AS k", "if(id > 4999, 1.0D, 2.0D) AS x")
    got = privacy.verbatim(own, other, ["x"], "k").first()
    assert (got["matched"], got["total"]) == (1, 5000)


def test_detection_scores_every_fold(spark, monkeypatch):
    scored, plain = [], similarity.BinaryClassificationEvaluator.evaluate
    monkeypatch.setattr(similarity.BinaryClassificationEvaluator, "evaluate", lambda self, df: scored.append((df.count(), plain(self, df))) or scored[-1][1])
    got = similarity.logistic_detection(*two(spark, [float(i % 50) for i in range(150)], [float(i % 50) + 0.5 for i in range(150)]), ["x"]).first()
    assert sum(n for n, _ in scored) == 300 and len(scored) == 3
    assert math.isclose(got["auc"], sum(a for _, a in scored) / 3)
