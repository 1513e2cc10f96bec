"""Privacy attacks and the neighbour join against brute force, and on data that leaks or doesn't."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twincheck.operators import attacks
from twincheck.operators import neighbours as nb

SCHEMA = "id long, a double, b double, c string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def mixed(n, seed, start=0):
    r = np.random.default_rng(seed)
    pick = lambda values: [values[i] for i in r.integers(0, len(values), n)]
    return [(start + i, a, float(b), c) for i, (a, b, c) in enumerate(zip(pick([None, 1.0, 2.0, 3.5, float("nan")]), r.normal(size=n), pick(["x", "y", "|", None]), strict=True))]


def missing(x):
    return x is None or x != x


def gower(p, q, width):
    total = 0.0
    for i in (1, 2):
        total += float(missing(p[i]) != missing(q[i])) if missing(p[i]) or missing(q[i]) else (abs(p[i] - q[i]) / width[i] if width[i] else 0.0)
    return round((total + (p[3] != q[3])) / 3, 9)


def widths(*sides):
    out = {}
    for i in (1, 2):
        v = [r[i] for s in sides for r in s if not missing(r[i])]
        out[i] = max(v) - min(v) if v else 0
    return out


@pytest.fixture
def apart(spark):
    """Every group in the partition of its own hash."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_in_blocks(spark, apart, k):
    q, s = mixed(60, 1), mixed(300, 2) + [(1000 + i, 2.0, 0.1, "x") for i in range(150)]  # a third are alike
    got = nb.neighbours(frame(spark, q), frame(spark, s), "id", ["a", "b"], ["c"], k, block_rows=40, query_rows=13, pivots=9).collect()
    w = widths(q, s)
    want = {(p[0], n, i, d) for p in q for n, (d, i) in enumerate(sorted((gower(p, x, w), x[0]) for x in s)[:k], 1)}
    assert {(r["id"], r["rank"], r["near_id"], r["distance"]) for r in got} == want and len(got) == len(want)


def test_neighbours_on_few_rows_and_kinds(spark):
    q = frame(spark, [(1, None, None, None), (2, 1.0, 1.0, "x")])
    assert nb.neighbours(q, frame(spark, []), "id", ["a"], ["c"], 3).collect() == []
    assert nb.neighbours(frame(spark, []), q, "id", ["a"], ["c"], 3).collect() == []
    only = nb.neighbours(q, q, "id", [], ["c"], 3).orderBy("id", "rank").collect()
    assert [(r["id"], r["near_id"], r["distance"]) for r in only] == [(1, 1, 0.0), (1, 2, 1.0), (2, 2, 0.0), (2, 1, 1.0)]
    flat = nb.neighbours(q, frame(spark, [(5, 1.0, 1.0, "x"), (6, 1.0, 1.0, "x")]), "id", ["a"], [], 1).collect()
    assert {(r["id"], r["near_id"], r["distance"]) for r in flat} == {(1, 5, 1.0), (2, 5, 0.0)}


def test_wilson_interval(spark):
    ends = [e.alias(k) for e, k in zip(attacks.wilson(F.col("x"), F.col("n")), ("lo", "hi"), strict=True)]
    r = spark.range(1).selectExpr("3 AS x", "10 AS n").select(*ends).first()
    z = 1.959963984540054
    for end in (r["lo"], r["hi"]):  # the ends solve (p - x/n)^2 = z^2 p(1-p)/n
        assert math.isclose((end - 0.3) ** 2, z * z * end * (1 - end) / 10, rel_tol=1e-9)
    assert tuple(spark.range(1).selectExpr("0 AS x", "0 AS n").select(*ends).first()) == (None, None)


def met(row, terms):
    at = {"a": 1, "b": 2, "c": 3}
    for column, op, value, word in terms:
        x = row[at[column]]
        x = None if missing(x) else x
        want = value if column != "c" else word
        if op == "null":
            ok = x is None
        else:
            ok = x is not None and {"=": lambda: x == want, "<=": lambda: x <= want, ">=": lambda: x >= want}[op]()
        if not ok:
            return False
    return True


def test_predicates_are_counted_on_all_rows(spark):
    rows = mixed(5000, 3) + [(9000, float("inf"), -float("inf"), ""), (9001, -float("inf"), float("inf"), "z")]
    values = [1.0, 2.0, 0.0, -1.5, 3.5, float("inf")]
    r = np.random.default_rng(4)
    preds = []
    for i in range(150):
        terms = []
        for c in r.permutation(["a", "b", "c"])[: r.integers(1, 4)].tolist():
            op = ["=", "<=", ">=", "null"][r.integers(0, 4)] if c != "c" else ["=", "null"][r.integers(0, 2)]
            terms.append((c, op, None if c == "c" or op == "null" else values[r.integers(0, 6)], None if c != "c" or op == "null" else ["x", "y", "|", "z", "absent"][r.integers(0, 5)]))
        preds.append((str(i), terms))
    p = spark.createDataFrame(preds, f"pid string, {attacks._TERMS}")
    got = {x["pid"]: x["matches"] for x in attacks.count_matches(frame(spark, rows), p, ["a", "b"], ["c"]).collect()}
    assert got == {i: sum(met(row, terms) for row in rows) for i, terms in preds}
    assert all(x["matches"] == 0 for x in attacks.count_matches(frame(spark, []), p, ["a", "b"], ["c"]).collect())


def people(n, seed, start=0):
    r = np.random.default_rng(seed)
    return [(start + i, float(x), float(y), f"c{int(z)}") for i, (x, y, z) in enumerate(zip(r.lognormal(size=n), r.normal(size=n) * 10, r.integers(0, 4, n), strict=True))]


def test_a_leaking_release_is_singled_out_and_a_fresh_one_is_not(spark):
    real = people(400, 5)
    leak = [(10_000 + i, *r[1:]) for i, r in enumerate(real)]
    risk = {r["mode"]: r for r in attacks.singling_out(frame(spark, real), frame(spark, leak), "id", ["a", "b"], ["c"], n=200).collect()}
    assert risk["univariate"]["attacks"] == 200 and risk["univariate"]["rate"] > 0.95 and risk["multivariate"]["rate"] > 0.95
    fresh = {r["mode"]: r for r in attacks.singling_out(frame(spark, real), frame(spark, people(400, 6, 20_000)), "id", ["a", "b"], ["c"], n=200).collect()}
    assert fresh["univariate"]["rate"] < 0.1 and fresh["multivariate"]["rate"] < risk["multivariate"]["rate"] / 2
    assert fresh["univariate"]["low"] <= fresh["univariate"]["rate"] <= fresh["univariate"]["high"]


def test_no_rows_and_no_rare_values(spark):
    alike = [(i, 1.0, 1.0, "x") for i in range(50)]
    got = {r["mode"]: r for r in attacks.singling_out(frame(spark, alike), frame(spark, alike), "id", ["a", "b"], ["c"]).collect()}
    assert got["univariate"]["successes"] == 0 and got["multivariate"]["attacks"] == 0 and got["multivariate"]["rate"] is None
    none = attacks.singling_out(frame(spark, []), frame(spark, []), "id", ["a", "b"], ["c"]).collect()
    assert [(r["attacks"], r["risk"]) for r in none] == [(0, None), (0, None)]


def test_linkability_and_inference(spark):
    real = people(600, 7)
    leak = [(10_001 + i, *r[1:]) for i, r in enumerate(real)]
    link = attacks.linkability(frame(spark, real), frame(spark, leak), "id", (["a"], []), (["b"], ["c"]), k=3, every=4).first()
    assert link["attacks"] == 150 and link["rate"] == 1.0 and link["baseline"] < 0.05 and link["risk"] == 1.0
    fresh = attacks.linkability(frame(spark, real), frame(spark, people(600, 8, 30_000)), "id", (["a"], []), (["b"], ["c"]), k=3, every=4).first()
    assert fresh["risk"] < 0.15
    told = {r["secret"]: r for r in attacks.inference(frame(spark, real), frame(spark, leak), "id", ["a", "b"], ["c"], ["c", "b"], k=1, every=4).collect()}
    assert told["c"]["rate"] > 0.95 and told["b"]["rate"] > 0.95 and told["c"]["risk"] > 0.9
    unknown = {r["secret"]: r for r in attacks.inference(frame(spark, real), frame(spark, people(600, 9, 40_000)), "id", ["a", "b"], ["c"], ["c"], k=1, every=4).collect()}
    assert unknown["c"]["risk"] < 0.2
    assert attacks.default_secrets(["a", "b", "c", "d"]) == ["b", "c", "d"]


def test_members_of_a_leaking_release_are_told(spark, apart):
    members, others = people(250, 10), people(250, 11, 1000)
    r = np.random.default_rng(12)
    leak = [(5000 + i, a + 1e-4 * float(r.normal()), b, c) for i, (_, a, b, c) in enumerate(members)]
    got = attacks.membership(frame(spark, members), frame(spark, others), frame(spark, leak), "id", ["a", "b"], ["c"], block_rows=60, query_rows=50).first()
    assert got["auc"] > 0.9 and got["low"] < got["auc"] < got["high"] and got["tpr_at_fpr_001"] > 0.05
    fresh = attacks.membership(frame(spark, members), frame(spark, others), frame(spark, people(250, 13, 5000)), "id", ["a", "b"], ["c"]).first()
    assert fresh["low"] < 0.5 < fresh["high"]
    with pytest.raises(ValueError):
        attacks.membership(frame(spark, members), frame(spark, others), frame(spark, leak), "id", ["a"], [], shadows=33)


def test_membership_equals_its_definition(spark, apart):
    members, others, synth = people(40, 14), people(30, 15, 100), people(50, 16, 200)
    got = attacks.membership(frame(spark, members), frame(spark, others), frame(spark, synth), "id", ["a", "b"], ["c"], shadows=4, block_rows=9, query_rows=7).first()
    rows = members + others
    w = widths(rows, synth)
    half = {r[0]: [hashlib.md5(f"0:{r[0]}".encode()).hexdigest()[i] < "8" for i in range(4)] for r in rows}
    score = {}
    for r in rows:
        away = [min(gower(r, x, w) for x in rows if half[x[0]][i]) for i in range(4) if not half[r[0]][i]]
        score[r[0]] = round(np.mean(away) - min(gower(r, x, w) for x in synth), 14) if away else 0.0
    pairs = [(score[m[0]], score[o[0]]) for m in members for o in others]
    auc = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs])
    assert math.isclose(got["auc"], auc, abs_tol=1e-9) and (got["members"], got["others"]) == (40, 30)


def test_linked_rows(spark, apart):
    real, aux = people(120, 17), people(80, 18, 500)
    synth = people(100, 19, 1000)
    got = attacks.linked_rows(frame(spark, real), frame(spark, synth), frame(spark, aux), ["a", "b"], "id", every=3, block_rows=20, query_rows=11).first()
    sd = pd.DataFrame(real)[[1, 2]].std(ddof=0) + 1e-8
    d = lambda p, q: round(math.sqrt(sum(((p[i] - q[i]) / sd[i]) ** 2 for i in (1, 2))), 9)
    probes = [p for p in aux if p[0] % 3 == 0]
    near = [min(synth, key=lambda x, p=p: (d(p, x), x[0])) for p in probes]
    assert (got["linked"], got["probes"]) == (sum(min(d(x, r) for r in real) < 0.5 for x in near), len(probes))


def test_leaves_spare_distances(monkeypatch):
    """Inside a block few of the distances are taken, and the nearest are those of all pairs."""
    r = np.random.default_rng(3)
    sx, qx, sc, qc = r.random((20_000, 2)), r.random((500, 2)), r.integers(0, 3, (20_000, 1)), r.integers(0, 3, (500, 1))
    whole = np.round(nb.distances(qx, qc, sx, sc, "gower"), nb.DIGITS)
    taken, plain = [], nb.distances
    monkeypatch.setattr(nb, "distances", lambda *a: taken.append(len(a[0]) * len(a[2])) or plain(*a))
    q, s, d = nb.nearest(qx, qc, sx, sc, np.arange(len(sx)), 3, np.full(len(qx), np.inf), "gower")
    assert sum(taken) < whole.size / 10
    order = np.argsort(whole, axis=1, kind="stable")[:, :3]
    assert (q == np.repeat(np.arange(500), 3)).all() and (s == order.ravel()).all() and (d == np.take_along_axis(whole, order, axis=1).ravel()).all()


def test_nearest_of_parts_against_all_pairs(spark, apart):
    """One search for all parts, with parts that nobody is in, alike candidates and queries that want nothing."""
    q, s = mixed(50, 5), mixed(200, 6, 1000) + [(5000 + i, 1.0, 0.2, "y") for i in range(100)]
    scale = nb.ranges([frame(spark, q), frame(spark, s)], ["a", "b"])
    asked = nb.encode(frame(spark, q), "id", scale, ["c"]).withColumn("want", F.col("id") % 16)
    held = nb.encode(frame(spark, s), "id", scale, ["c"]).withColumn("mask", F.col("id") % 8)
    got = {(r["id"], r["part"]): r["distance"] for r in nb.nearest_of_parts(asked, held, block_rows=30, query_rows=11, pivots=20).collect()}
    w = widths(q, s)
    assert got == {(p[0], i): min(gower(p, x, w) for x in s if x[0] % 8 >> i & 1) for p in q for i in range(3) if p[0] % 16 >> i & 1}
