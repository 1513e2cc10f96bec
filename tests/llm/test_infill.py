"""Fill-in-the-middle against its definition, character by character."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twincheck.llm import infill

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "a", "word", " ", "\n\n", "é" * 200, "ab1" * 3000, "x" * 5000, "one <P> two", "a<S", "<M>", "<P", "tail <", "P> head", "\U0001f600 smile \U0001f600" * 40, "a b" * 64, "Z" + "." * 63, "." * 64, "." * 65, "." * 128, "long Text, " * 40_000]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def want(doc_id, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    a, b, z = ("".join(units[i:j]) for i, j in ((0, lo), (lo, hi), (hi, n)))
    form, out = ("spm", f"<S>{z}<P>{a}<M>{b}") if h[3] % 100 < 20 else ("psm", f"<P>{a}<S>{z}<M>{b}")
    return doc_id, n, form, len(a), len(b), sha(out), sha(t)


def clash(spark, rows):
    """Columns named like the operator's own."""
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, "f") for i, t in rows], "doc_id long, text string, n int, key string, times long, low int, form string")


def test_every_kind_of_text(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    got = infill.digests(clash(spark, rows))
    assert Counter(map(tuple, got.collect())) == Counter(want(*r) for r in rows)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}


def test_repeated_rows_ids_and_null_ids(spark):
    rows = [(None, "no id here"), (None, "no id here"), (7, "same id"), (7, "same id, other text"), *[(9, "many copies of one row")] * 500, (9, None), (9, "")]
    assert Counter(map(tuple, infill.digests(clash(spark, rows)).collect())) == Counter(want(*r) for r in rows)


def test_empty_table(spark):
    assert infill.digests(clash(spark, [])).collect() == []


def test_whole_table_and_real_outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, infill.digests(docs).collect())) == Counter(want(*r) for r in rows)
    done = infill.transform(docs).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == r["text"] for r in done) and len(done) == len(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_other_seeds_restore(spark, seed):
    docs = clash(spark, list(enumerate(TEXTS)))
    done = infill.transform(docs, seed).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == r["text"] for r in done) and len(done) == len(TEXTS)
