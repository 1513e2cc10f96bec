"""Exact top-k by metric trees against comparing all pairs."""

import math
from collections import Counter

import numpy as np
import pytest

from twincheck.llm import mtree


def floor64(v):
    return [math.floor(64 * x) for x in v]


def want(rows, k=20, every=20):
    own = [(i, floor64(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(own):
        if i is None or i % every:
            continue
        score = lambda v: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, v, strict=False))))
        found = sorted(((-score(v), j is None, j or 0) for b, (j, v) in enumerate(own) if b != a))[:k]
        out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(found, 1)]
    return Counter(out)


def frame(spark, rows):
    """Columns named like the operator's own."""
    return spark.createDataFrame([(i, v, 1, 2, 3, "b") for i, v in rows], "vec_id long, embedding array<double>, region int, part int, times long, vector string")


def clustered(seed, n, dim, centres=8, spread=0.02):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_tree_finds_what_all_pairs_find(spread):
    v = np.floor(64 * clustered(1, 3000, 8, spread=spread)) + 0.0
    v[500:900] = v[0]  # many copies
    ids = np.random.default_rng(2).permutation(3000)
    sphere = mtree.Sphere(float(np.einsum("ij,ij->i", v, v).max()))
    tree = mtree.Tree(ids, np.ones(3000, dtype=np.int64), v, sphere, leaf=16, fan=4)
    total = 0
    for a in range(0, 3000, 50):
        own = tree.own(int(ids[a]), v[a])
        score, rows, done = tree.search(v[a], 20, -mtree.NO_ID - 1, own)
        s = (v @ v[a]).astype(np.int64)
        best = sorted((-s[b], ids[b]) for b in range(3000) if b != a)[:20]
        assert sorted(zip((-score).tolist(), tree.ids[rows].tolist(), strict=True)) == best
        total += done
    if spread < 1:
        assert total < 0.5 * 60 * 3000  # bounds spare most distances where vectors lie in clusters


def test_covering_radii_and_parent_distances_hold():
    v = np.floor(64 * clustered(3, 500, 6))
    sphere = mtree.Sphere(float(np.einsum("ij,ij->i", v, v).max()))
    tree = mtree.Tree(np.arange(500), np.ones(500, dtype=np.int64), v, sphere, leaf=8, fan=3)
    v = tree.vectors.astype(float)  # in the order of the leaves
    last = sphere.last(v)

    def below(at):
        _, first, end, centres, _, pages = tree.pages[at]
        return list(range(first, end)) if centres is None else [r for p in pages.tolist() for r in below(p)]

    assert sorted(below(0)) == list(range(500))
    todo = [(0, tree.centre)]
    while todo:
        at, centre = todo.pop()
        parent, first, stop, centres, radii, pages = tree.pages[at]
        end = sphere.last(centre[None])[0]
        if centres is None:
            assert np.allclose(parent, sphere.between(v[first:stop], last[first:stop], centre, end))
            continue
        assert np.allclose(parent, sphere.between(centres, sphere.last(centres), centre, end))
        for c, r, p in zip(centres, radii, pages.tolist(), strict=True):
            own = below(p)
            assert sphere.between(v[own], last[own], c, sphere.last(c[None])[0]).max() <= r + 1e-9
            todo.append((p, c))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_shards_regions_and_blocks(spark, spread):
    v = clustered(4, 700, 5, spread=spread)
    rows = [(int(i), x) for i, x in enumerate(v.tolist())] + [(int(i), v[3].tolist()) for i in range(700, 1050)]  # a third are copies of one vector
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # every group in the partition of its own hash
    try:
        got = mtree.top_k(frame(spark, rows), shard_rows=60, roots=6, block=7).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(map(tuple, got)) == want(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, -0.5]), (20, [1.0, -0.5]), (1, [1.0]), (2, []), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (-40, [0.3, 0.2, 0.1]), (None, [2.0, 2.0]), (None, [2.0, 2.0]),
        (60, [0.5, 0.5]), (60, [0.5, 0.5]), (60, [0.25, 0.5]), (80, [-0.0, -1e-9]), (100, None), *[(7, [9.0, 9.0])] * 30,
    ]
    assert Counter(map(tuple, mtree.top_k(frame(spark, rows)).collect())) == want(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**40 + i), float(-(2**39)), 0.5 * i]) for i in range(0, 45)] + [(100, [1e300, 0.0, 0.0])]
    assert Counter(map(tuple, mtree.top_k(frame(spark, rows), k=5).collect())) == want(rows, k=5)


def test_fewer_than_k_and_empty(spark):
    assert Counter(map(tuple, mtree.top_k(frame(spark, [(20, [1.0])])).collect())) == Counter()
    rows = [(20, [1.0]), (21, [2.0]), (40, [3.0])]
    assert Counter(map(tuple, mtree.top_k(frame(spark, rows)).collect())) == want(rows)
    assert mtree.top_k(frame(spark, [])).collect() == []
    assert mtree.top_k(frame(spark, [(20, None)])).collect() == []
