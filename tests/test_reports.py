"""Job reports against plain computations, and their texts and files."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twincheck.operators import reports, statistics

ROWS = [  # job, synthetic, a, b
    ("x", False, "p", 1), ("x", False, "p", 1), ("x", False, "q", 2), ("x", True, "p", 1), ("x", True, "q", 2), ("x", True, "q", 2), ("x", True, None, 3),
    ("y", False, "p", 1), ("y", False, None, 1), (None, False, "p", None), (None, True, "p", None), ("z", True, "p", 1),
]


def plain(rows):
    """{job: (fidelity, privacy, memorization)} by the definition."""
    out = {}
    for job in {r[0] for r in rows}:
        real, syn = ([r[2:] for r in rows if r[0] == job and r[1] == s] for s in (False, True))
        likes = []
        for c in (0, 1):
            a, b = (Counter(str(r[c]) for r in side if r[c] is not None) for side in (real, syn))
            if a and b:
                likes.append(1 - sum(abs(a[v] / a.total() - b[v] / b.total()) for v in a | b) / 2)
        held = Counter(real)
        share = lambda f: sum(map(f, syn)) / len(syn) if syn else 1.0  # noqa: E731, B023
        out[job] = (sum(likes) / len(likes) if likes else 0.0, 1 - share(lambda r: held[r] == 1), share(lambda r: held[r] > 0))  # noqa: B023
    return out


def test_job_scores_equal_the_definition(spark):
    df = spark.createDataFrame(ROWS, "job string, syn boolean, a string, b int")
    got = {r.job_id: (r.fidelity, r.privacy, r.memorization) for r in reports.job_scores(df, "job", F.col("syn"), ["a", "b"], ["a", "b"]).collect()}
    want = plain(ROWS)
    assert got.keys() == want.keys() and len(got) == 4
    assert all(math.isclose(x, y, abs_tol=1e-12) for job in want for x, y in zip(got[job], want[job], strict=True)), (got, want)
    assert reports.job_scores(df.limit(0), "job", F.col("syn"), ["a"], ["a"]).count() == 0


def test_templates_keep_unknown_names_and_search_values_once(spark):
    df = spark.createDataFrame([("{{ b }}", None)], "a string, b string")
    assert df.select(reports.fill("{{ a }}-{{ b }}-{{ c }}-{{a}}", {"a": F.col("a"), "b": F.col("b")}).alias("t")).head().t == "{{ b }}--{{ c }}-{{a}}"


JOBS = [("01", "t1", "d", None, 0.9, 0.85, 0.05), ("02", "t1", "d", "c", 0.9, 0.85, 0.11), ("03", "t2", "d", None, None, 0.9, 0.0), (None, "t2", "d", None, 0.75, 0.80, 0.10)]
SCHEMA = "job_id string, tenant_id string, validated_at string, certificate string, fidelity double, privacy double, memorization double"


def test_statements_by_standard(spark):
    got = {(r.job_id, r.standard): r for r in reports.statements(spark.createDataFrame(JOBS, SCHEMA)).collect()}
    assert len(got) == 12 and {k[0] for k, r in got.items() if r.passed} == {"01", None}
    text = got["02", "soc2"].report
    assert "CC7.3 memorization gate: false (0.1100)" in text and text.endswith("Compliant: false\n") and "{{" not in text
    with pytest.raises(ValueError):
        reports.statements(spark.createDataFrame(JOBS, SCHEMA), ("iso",))


def test_certificates_for_passing_jobs_alone(spark, tmp_path):
    rows = reports.issue_certificates(spark.createDataFrame(JOBS, SCHEMA), str(tmp_path / "c")).collect()
    assert [(r.tenant_id, r.job_id) for r in rows] == [("t1", "01")]
    assert json.loads(spark.read.text(rows[0].certificate).head().value)["privacy"] == 0.85
    none = spark.createDataFrame([], SCHEMA)
    assert reports.issue_certificates(none, str(tmp_path / "none")).count() == 0


def test_report_lines_in_order_and_as_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "m" * 40, 0.8), ("a", "low", 0.1), ("a", "gone", None), ("b", "one", 0.75)], "job_id string, metric string, score double")
    lines = reports.report_lines(df)
    got = [r.text for r in lines.where("job_id = 'a'").orderBy("line").collect()]
    assert got == ["Validation report of job a", "1 of 3 metrics reached", "gone".ljust(32) + "missing  FAIL", "low".ljust(32) + "0.1000  FAIL", "m" * 40 + " 0.8000  PASS"]
    reports.write_lines(lines, str(tmp_path / "r"))
    (written,) = (tmp_path / "r" / "job_id=a").glob("*.txt")
    assert written.read_text().splitlines() == got


def test_chart_of_no_scores(spark):
    got = reports.chart(spark.createDataFrame([("k", "c", None)], "category string, column string, score double")).collect()
    assert len(got) == 14 and all(r.value == 0 for r in got)


def test_single_tests_take_few_rows(spark):
    real, synth = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, c string"), spark.createDataFrame([(1.0, "a")], "x double, c string")
    assert statistics.ks_only(real, synth, ["x"]).head().ks == 0.5
    assert statistics.chi2_only(real, synth, ["c"]).head().dof == 1
