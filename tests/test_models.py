"""Fitted models on data whose answer is known; sequences, tolerance joins and order statistics against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twincheck.operators import fits, models, privacy, sequences, similarity, statistics


def points(spark, rows, names="a b"):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{c} double" for c in names.split()))


def test_mixture_finds_known_parameters(spark):
    rng = np.random.default_rng(0)
    weights, means = np.array([0.3, 0.7]), np.array([[0.0, 100.0], [5.0, 160.0]])
    spread = np.array([[[1.0, 3.0], [3.0, 25.0]], [[2.0, -4.0], [-4.0, 16.0]]])

    def draw(n):
        which = rng.random(n) < weights[0]
        return np.where(which[:, None], rng.multivariate_normal(means[0], spread[0], n), rng.multivariate_normal(means[1], spread[1], n))

    real, synth = draw(3000), draw(3000)
    got = models.mixture_likelihood(points(spark, real), points(spark, synth), ["a", "b"], range(1, 3), rounds=30).first()
    truth = models.log_density(synth, weights, means, spread).mean()
    assert got["components"] == 2 and abs(got["synth_log_likelihood"] - truth) < 0.03 and (got["n_real"], got["n_synth"]) == (3000, 3000)


def test_mixture_density_is_the_normal_density():
    x = np.array([[0.5], [-2.0]])
    want = np.log(0.25 * np.exp(-0.5 * x**2) / math.sqrt(2 * math.pi) + 0.75 * np.exp(-0.5 * (x - 1) ** 2 / 4) / math.sqrt(8 * math.pi))
    got = models.log_density(x, np.array([0.25, 0.75]), np.array([[0.0], [1.0]]), np.array([[[1.0]], [[4.0]]]))
    assert np.allclose(got, want[:, 0])


def test_mixture_of_nothing_constants_and_missing_values(spark):
    none = models.mixture_likelihood(points(spark, []), points(spark, [(1, 2)]), ["a", "b"]).first()
    assert (none["components"], none["n_real"], none["n_synth"], none["synth_log_likelihood"]) == (None, 0, 1, None)
    rows = [(1.0, float(i % 7)) for i in range(60)] + [(float("nan"), 1.0)]
    got = models.mixture_likelihood(points(spark, rows), points(spark, []), ["a", "b"], range(1, 2)).first()
    assert got["n_real"] == 60 and math.isfinite(got["real_log_likelihood"]) and got["synth_log_likelihood"] is None


def ring(n, radius, seed):
    rng = np.random.default_rng(seed)
    angle = rng.uniform(0, 2 * math.pi, n)
    return np.stack([np.cos(angle), np.sin(angle)], axis=1) * radius + rng.normal(scale=0.1, size=(n, 2))


def test_kernel_classifier_parts_rings_that_a_linear_one_cannot(spark):
    inner, outer = points(spark, ring(300, 1, 1)).coalesce(1), points(spark, ring(300, 2, 2)).coalesce(1)
    assert models.svc_detection(inner, outer, ["a", "b"], [], features=64).first()["auc"] > 0.97
    assert similarity.logistic_detection(inner, outer, ["a", "b"]).first()["auc"] < 0.65


def test_fourier_features_approach_the_kernel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "i int, x array<double>")
    z = np.array([r["z"] for r in df.select("i", models.fourier(F.col("x"), 3, 0.3, 4096).alias("z")).orderBy("i").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_classifiers_carry_over_or_not(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2))
    label = np.where(x[:, 0] > 0.3 * x[:, 1], "hi", "lo")
    rows = [(float(a), float(b), "w", y) for (a, b), y in zip(x, label, strict=True)]
    make = lambda r: spark.createDataFrame(r, "a double, b double, c string, y string")
    got = models.transfer(make(rows[:450]), make(rows[450:]), ["a", "b"], ["c"], "y").collect()
    assert {r["model"] for r in got} == {"boosted_trees", "decision_tree", "logistic_regression", "perceptron"} and len(got) == 8
    assert all(sum(r["n"] for r in got if r["model"] == m) == 450 for m in {r["model"] for r in got})
    assert min(r["f1"] for r in got if r["model"] in ("boosted_trees", "decision_tree")) > 0.85
    for r in got:
        p, c = r["precision"], r["recall"]
        assert math.isclose(r["f1"], 2 * p * c / (p + c) if p + c else 0.0, abs_tol=1e-9)
    assert models.transfer(make(rows[:10]), make([(0.0, 0.0, "w", "lo")] * 5), ["a", "b"], ["c"], "y").collect() == []
    with pytest.raises(ValueError):
        models.transfer(make(rows[:10]), make([(0.0, 0.0, "w", str(i)) for i in range(101)]), ["a", "b"], ["c"], "y")


def test_sequences(spark):
    rows = [("a", v) for v in (1.0, 2.0, 4.0, None, float("nan"))] + [("b", 5.0), (None, 1.0)]
    got = {r["key"]: tuple(r)[1:] for r in sequences.sequence_statistics(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": (round(7 / 3, 9), 2.0, round(float(np.std([1, 2, 4], ddof=1)), 9), 1.0, 4.0), "b": (5.0, 5.0, None, 5.0, 5.0)}
    one, other = (spark.createDataFrame([(k, float(v)) for k in range(3) for v in vs], "k int, v double") for vs in ((1, 2, 3), (7, 8, 9)))
    assert {r["statistic"]: r["score"] for r in sequences.sequence_similarity(one, other, "k", "v").collect()} == {"mean": 0.0, "median": 0.0, "std": 1.0, "min": 0.0, "max": 0.0}


@pytest.mark.parametrize("columns", [1, 2, 4])
def test_tolerance_join(spark, columns):
    rng = np.random.default_rng(columns)
    names = ["p", "q", "r", "s"][:columns]
    eps, span = dict(zip(names, (0.5, 0.25, 1.0, 0.3), strict=False)), {1: 60, 2: 5, 4: 3}[columns]

    def side(n):
        v = np.round(rng.uniform(-span, span, (n, columns)) * 8) / 8  # many exact gaps of a tolerance
        v[: n // 3] = v[0]  # a third are alike
        v[n // 3 : n // 2] = v[0] + rng.uniform(-0.6, 0.6, (n // 2 - n // 3, columns))  # a crowd in few cells
        rows = [[None if rng.random() < 0.05 else float(x) for x in r] for r in v]
        return [(*r, ["x", "y", None][rng.integers(0, 3)]) for r in rows]

    real, synth = side(240), side(200)
    schema = ", ".join(f"{c} double" for c in names) + ", k string"
    near = lambda a, b: a[-1] == b[-1] and all((x is None and y is None) or (x is not None and y is not None and abs(x - y) <= e) for x, y, e in zip(a, b, eps.values(), strict=False))
    want = sum(not any(near(s, r) for r in real) for s in synth)
    got = sequences.new_rows_within(spark.createDataFrame(real, schema), spark.createDataFrame(synth, schema), eps, ["k"]).first()
    assert (got["n_synth"], got["n_new"]) == (200, want) and 0 < want < 200


def test_tolerance_join_edges(spark):
    schema = "p double, k string"
    real = spark.createDataFrame([(1.0, "x"), (float("nan"), "x"), (None, "z")], schema)
    synth = spark.createDataFrame([(1.0, "x"), (1.5, "x"), (1.6, "x"), (None, "x"), (float("nan"), "z"), (1.0, "z")], schema)
    assert tuple(sequences.new_rows_within(real, synth, {"p": 0.5}, ["k"]).first())[:2] == (6, 2)
    assert tuple(sequences.new_rows_within(real, synth, {"p": 0.0}, ["k"]).first())[:2] == (6, 3)
    assert tuple(sequences.new_rows_within(real, synth.limit(0), {"p": 0.5}, ["k"]).first()) == (0, 0, None)
    assert tuple(sequences.new_rows_within(real.limit(0), synth, {"p": 0.5}, []).first()) == (6, 6, 1.0)
    plan = sequences.matches_within(synth, real, {"p": 0.5}, ["k"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_midpoint_of_two_million_keys(spark):
    df = spark.range(2_000_000).select((F.xxhash64("id") % 1_000_003 * 7).alias("k"))
    n = df.where("k IS NOT NULL").count()
    by = sorted(r["k"] for r in df.collect())
    for k in (1, n // 2, n // 2 + 1, n):
        assert sequences.order_statistic(df, "k", k) == by[k - 1]
    low, high = privacy.halves(spark.range(2_000_001).select((F.col("id") * 3).alias("k")), "k")
    assert (low.count(), high.count()) == (1_000_001, 1_000_000)


@pytest.mark.parametrize("values", [[5.0], [1e300, -1e300, 0.0, 1e-300, 3.0], [1e16, 1e16 + 2, 1e16 + 4, 1e16 + 4], [float("inf"), -float("inf"), 1.0, 2.0, None, float("nan")], [0.1] * 4 + [0.2]])
def test_order_statistics_of_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    own = sorted(v for v in values if v is not None and v == v)
    assert [sequences.order_statistic(df, "v", k + 1) for k in range(len(own))] == own
    assert sequences.order_statistic(df, "v", len(own) + 1) is None and sequences.order_statistic(df, "v", 0) is None


def test_order_statistics_of_wide_longs(spark):
    own = sorted([-(2**63), 2**63 - 1, 2**62, 2**62 + 1, 2**62 + 2, 0, -5])
    df = spark.createDataFrame([(v,) for v in own], "v long")
    assert [sequences.order_statistic(df, "v", k + 1) for k in range(len(own))] == own


def test_anderson_darling_p_value():
    at = np.sum(statistics.CRITICAL, axis=0)
    for t, level in zip(at[1:-1], statistics.LEVELS[1:-1], strict=True):
        assert abs(math.log(statistics.anderson_darling_p(float(t))) - math.log(level)) < 0.12  # the parabola runs near the table
    ps = [statistics.anderson_darling_p(t) for t in np.linspace(-2, 8, 60).tolist()]
    assert ps == sorted(ps, reverse=True) and ps[0] == 0.25 and ps[-1] == 0.001
    assert math.isnan(statistics.anderson_darling_p(float("nan")))


def test_fits_hold_bounded_partitions(spark):
    """Rows of one partition are dealt to as many as their number asks for, none lost."""
    got = models.dealt(spark.range(1000).coalesce(1), 100)
    assert got.rdd.getNumPartitions() >= 10 and got.count() == got.distinct().count() == 1000


def test_detection_stores_no_features(spark, monkeypatch):
    """Only columns, label, fold and count are written; a row of features is many times as wide."""
    kept, plain = [], models.materialised
    monkeypatch.setattr(models, "materialised", lambda df: kept.append(plain(df)) or kept[-1])
    real = spark.range(300).selectExpr("cast(id % 10 as double) a")
    models.svc_detection(real, real.selectExpr("a + 1 a"), ["a"], [], features=32)
    assert kept and max(r["n"] for d in kept for r in d.selectExpr("size(x) n").collect()) == 1
    assert sum(d.count() for d in kept) < 30  # equal rows once


def test_mixture_counts_equal_rows(spark, monkeypatch):
    """A mixture of rows that repeat is fitted on each once, with the same density as plain numbers give."""
    kept, plain = [], models.materialised
    monkeypatch.setattr(models, "materialised", lambda df: kept.append(plain(df)) or kept[-1])
    values = [0.0] * 300 + [1.0] * 100 + [5.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = models.mixture_likelihood(df, df, ["a"], range(1, 2)).first()
    m = sum(values) / 450
    s2 = sum((v - m) ** 2 for v in values) / 450
    assert got["n_real"] == 450 and abs(got["real_log_likelihood"] + 0.5 * (np.log(2 * np.pi * s2) + 1)) < 1e-9
    assert kept[0].count() == 3


def jobs(spark, name, run):
    """Spark jobs that run() takes, and its result."""
    spark.sparkContext.setJobGroup(name, name)
    got = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), got


def test_mixture_reads_rows_few_times(spark):
    """Rows of no clear mixture, on which expectation-maximisation is slow: all numbers of components share few readings, and the fit is no worse than many plain rounds."""
    rng = np.random.default_rng(7)
    x = rng.uniform(size=(4000, 2))
    df = points(spark, np.stack([x[:, 0], x[:, 0] * x[:, 1]], axis=1))
    n, got = jobs(spark, "mixture", lambda: models.mixture_likelihood(df, df, ["a", "b"], range(1, 4)).first())
    assert n < 80
    z = np.array([tuple(r) for r in df.collect()]).T
    width = z.std(axis=1)
    z = (z - z.mean(axis=1)[:, None]) / width[:, None]
    mixture = models.started(z, np.ones(4000), 3, 1, 1)
    for _ in range(100):
        mixture = models.maximised(mixture, models.expected(z, np.ones(4000), mixture))
    assert got["components"] == 3 and got["real_log_likelihood"] > models.log_density(z.T, *mixture).mean() - np.log(width).sum() - 1e-3


def test_round_of_a_mixture_is_the_textbook_one():
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(2, 50)) * [[1], [3]], rng.integers(1, 4, 50).astype(float)
    mixture = np.array([0.3, 0.7]), np.array([[0.0, 1.0], [1.0, -1.0]]), np.array([[[1.0, 0.2], [0.2, 2.0]], [[2.0, 0.0], [0.0, 1.0]]])
    sums = sum(models.expected(x[:, p], w[p], mixture) for p in (slice(0, 20), slice(20, 50)))
    each = np.exp(np.array([models.log_density(x.T, np.ones(1), mixture[1][[k]], mixture[2][[k]]) for k in range(2)])) * mixture[0][:, None]
    r = each / each.sum(axis=0) * w
    weights, means, covariances = models.maximised(mixture, sums)
    assert math.isclose(sums[0], w @ np.log(each.sum(axis=0))) and np.allclose(weights, r.sum(axis=1) / w.sum())
    for k in range(2):
        m = x @ r[k] / r[k].sum()
        assert np.allclose(means[k], m) and np.allclose(covariances[k], ((x - m[:, None]) * r[k]) @ (x - m[:, None]).T / r[k].sum())


def test_mixture_of_fewer_different_rows_than_components(spark):
    got = models.mixture_likelihood(points(spark, [(1, 2)] * 9 + [(3, 4)]), points(spark, [(1, 2)]), ["a", "b"], range(1, 4)).first()
    assert (got["n_real"], got["n_synth"]) == (10, 1) and math.isfinite(got["real_log_likelihood"]) and math.isfinite(got["synth_log_likelihood"])


@pytest.mark.parametrize("classes", [2, 3])
def test_slopes_of_the_classifiers(classes):
    """Slopes against differences, and parts of the rows against all at once."""
    rng = np.random.default_rng(classes)
    x, truth, w = rng.normal(size=(4, 30)), rng.integers(0, classes, 30), rng.integers(1, 4, 30).astype(float)
    for model in (models.Softmax(4, classes, 0.1), models.Perceptron(4, classes, 5)):
        at = model.start(rng) + rng.normal(scale=0.1, size=model.size)
        value = lambda p, m=model: m.objective(p, m.sums(p, x, truth, w), w.sum())
        assert np.allclose(model.sums(at, x, truth, w), sum(model.sums(at, x[:, p], truth[p], w[p]) for p in (slice(0, 9), slice(9, 30))))
        slope = value(at)[1]
        for i in range(model.size):
            step = np.zeros(model.size)
            step[i] = 1e-5
            assert abs((value(at + step)[0] - value(at - step)[0]) / 2e-5 - slope[i]) < 1e-7


def test_descent_finds_the_least():
    def bowl(p, sums):
        return float(sums[0]), sums[1:]

    scale = np.array([1.0, 30.0, 400.0])
    ask = lambda points: {k: np.append(scale @ (p - 2) ** 2 + ((p - 2) ** 4).sum(), 2 * scale * (p - 2) + 4 * (p - 2) ** 3) for k, p in points.items()}
    got = fits.together({k: fits.descent(np.full(3, float(k)), bowl, 100, 1e-12) for k in (-5, 0, 2)}, ask)
    assert all(np.allclose(p, 2, atol=1e-4) for p in got.values())


def test_classifiers_try_every_row_once(spark):
    """Words and labels that synthetic rows lack are counted too."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 2))
    df = spark.createDataFrame([(float(a), float(b), "uvw"[i % 3], "hi" if a > 0 else "lo" if b > 0 else "mid") for i, (a, b) in enumerate(x)], "a double, b double, c string, y string")
    real = df.unionByName(spark.createDataFrame([(1.0, 1.0, "new", "other")], df.schema))
    got = models.transfer(real, df, ["a", "b"], ["c"], "y").collect()
    assert len(got) == 16 and {r["n"] for r in got if r["label"] == "other"} == {1} and {r["f1"] for r in got if r["label"] == "other"} == {0.0}
    assert min(r["f1"] for r in got if r["label"] != "other" and r["model"] in ("boosted_trees", "decision_tree", "perceptron")) > 0.9
    for m in {r["model"] for r in got}:  # every real row has one prediction
        assert round(sum(r["n"] * r["recall"] / r["precision"] for r in got if r["model"] == m and r["precision"])) == 6001


def test_cells_are_bounded(spark, monkeypatch):
    """20,000 different numbers make no more than BINS cells a word and label."""
    kept, plain = [], models.materialised
    monkeypatch.setattr(models, "materialised", lambda df: kept.append(plain(df)) or kept[-1])
    df = spark.range(20000).selectExpr("cast(id as double) a", "if(id % 2 = 0, 'x', 'y') y")
    models.transfer(df, df, ["a"], [], "y").collect()
    assert kept and all(d.count() <= 2 * models.BINS for d in kept) and all(d.agg(F.sum("w")).first()[0] == 20000 for d in kept)


def test_area_counts_pairs():
    rng = np.random.default_rng(10)
    above, below = rng.integers(0, 3, 9).astype(float), rng.integers(0, 3, 9).astype(float)
    one, other = np.repeat(range(9), above.astype(int)), np.repeat(range(9), below.astype(int))
    assert math.isclose(models.area(above, below), np.mean((one[:, None] > other) + 0.5 * (one[:, None] == other)))
    assert models.area(above, below * 0) is None


def test_detection_fits_folds_in_shared_rounds(spark):
    """Different rows with a word that tells sides apart in part: few jobs, and the area that the word's frequencies give at best."""
    rng = np.random.default_rng(11)
    make = lambda n, odds: spark.createDataFrame([(float(v), "p" if u < odds else "q") for v, u in zip(rng.normal(size=n), rng.random(n), strict=True)], "a double, c string")
    real, synth = make(3000, 0.7), make(3000, 0.3)
    n, got = jobs(spark, "detection", lambda: models.svc_detection(real, synth, ["a"], ["c"], features=64).first())
    assert n < 60 and abs(got["auc"] - 0.7) < 0.03
    assert models.svc_detection(real, synth.limit(0), ["a"], ["c"], features=8).first()["auc"] is None
    assert models.svc_detection(real.limit(0), synth.limit(0), ["a"], ["c"], features=8).first()["auc"] is None
    only = lambda df: df.selectExpr("c", "cast(cast(10 * a as int) as string) d")
    assert abs(models.svc_detection(only(real), only(synth), [], ["c", "d"], features=256).first()["auc"] - 0.7) < 0.06
