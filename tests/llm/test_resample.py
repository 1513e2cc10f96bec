"""Importance resampling against its definition, and the suffix arrays against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from twincheck.llm import resample
from twincheck.llm.common import buffers

SF = "/root/testdata/sf0.001"


def words(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def grams(t, depth=1):
    w = words(t)
    return [" ".join(w[i : i + k]) for k in range(1, depth + 1) for i in range(len(w) - k + 1)]


def bucket(f, b=10_000):
    return zlib.crc32(f.encode()) % b


def want(docs, target, depth=1):
    s, t = (Counter(bucket(f) for x in side for f in grams(x, depth)) for side in ([x for _, x in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda f: math.floor(1000 * math.log((t[bucket(f)] + 1) * (ns + 10_000) / ((s[bucket(f)] + 1) * (nt + 10_000))))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, grams(x, depth)))
        rows.append([i, len(grams(x, depth)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in rows)


def clash(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "b", "p") for i, t in rows], "doc_id long, text string, n int, weight long, score long, bin string, part string")


def goal(spark, texts):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "item_id long, text string, bucket int")


@pytest.mark.parametrize("depth", [1, 3])
@pytest.mark.parametrize("most", [1, 7, 40, 1 << 20])
def test_features_are_all_runs_of_words(depth, most):
    texts = ["", "one", "One two, three-four FIVE", "a b a b a b c", "  .. ", "été d'été à l'été", "x" * 60, "w0 w1 " * 30, "end"]
    data, at = buffers(pa.array([t.encode() for t in texts], pa.binary()))
    got = Counter()
    for k, row, b in resample.features(data, at, depth, 10_000, most):
        got.update(zip([k] * len(row), row.tolist(), b.tolist(), strict=True))
    assert got == Counter((f.count(" ") + 1, i, bucket(f)) for i, t in enumerate(texts) for f in grams(t, depth))


def test_suffix_array_and_lcp():
    ids, row = np.array([0, 1, 0, 1, 2, 0, 1, 2, 0], dtype=np.int32), np.array([0, 0, 0, 0, 0, 1, 1, 1, 1])
    order, lcp = resample.suffix_array(ids, row, 3)
    runs = [tuple(ids[a : a + 3][row[a : a + 3] == row[a]].tolist()) for a in order.tolist()]
    assert runs == sorted(runs)
    for a, b, n in zip(runs, runs[1:], lcp[1:].tolist(), strict=False):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("depth", [1, 2])
def test_whole_table(spark, depth):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = resample.resample(docs, target, depth=depth).collect()
    assert Counter(map(tuple, got)) == want([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], depth)


def test_edges_ties_and_repeated_rows(spark):
    long = "lorem ipsum Dolor, sit 12 amet " * 5
    rows = [(1, None), (2, ""), (3, " .,! "), (4, "too few words"), (None, long), (None, long), (5, long + "é" * 3000), (6, "word " * 200_000), *[(i, long) for i in range(10, 60)], *[(70, long)] * 300]
    target = ["lorem ipsum", None, "", "other words"]
    assert Counter(map(tuple, resample.resample(clash(spark, rows), goal(spark, target)).collect())) == want(rows, target)
    assert Counter(map(tuple, resample.resample(clash(spark, rows), goal(spark, [])).collect())) == want(rows, [])


def test_empty_table(spark):
    assert resample.resample(clash(spark, []), goal(spark, ["a"])).collect() == []
    assert [r["rank"] for r in resample.resample(clash(spark, [(1, "a b")]), goal(spark, ["a"])).collect()] == [None]
