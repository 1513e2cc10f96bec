"""N-gram overlap of paired texts against plain counting."""

import math
import random
from collections import Counter

from twincheck.operators import text


def plain(real, synth, n):
    split = lambda x: [w for w in text.SPACE.split((x or "").lower()) if w]
    a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (split(real), split(synth)))
    return (a & b).total(), a.total(), b.total()


CASES = [("", ""), (None, "a b"), ("a b", None), ("  \n\t", "a"), ("a", "A"), ("a b c a b c a b", "c a b a b c"), ("a|b c", "a b|c"), ("x " * 5000, "x " * 7000), (" a b", "a b")]


def test_overlaps_equal_plain_counting(spark):
    rng = random.Random(7)
    cases = CASES + [tuple(" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in "rs") for _ in range(40)]
    real = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)] + [(1000, "only here")], "pos long, text string")
    synth = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(cases)] + [(1001, "only there")], "pos long, text string")
    got = {(r.pos, r.n): (r.hit, r.nr, r.ns) for r in text.overlaps(real, synth, (1, 2, 3, 4)).collect()}
    assert got == {(i, n): plain(*case, n) for i, case in enumerate(cases) for n in (1, 2, 3, 4)}
    totals = {n: [sum(x) for x in zip(*(plain(*case, n) for case in cases), strict=True)] for n in (1, 2, 3, 4)}
    brevity = min(1.0, math.exp(1 - totals[1][1] / totals[1][2]))
    for row in text.bleu(real, synth).collect():
        assert [row.matched, row.total] == [totals[row.n][0], totals[row.n][2]]
        want = brevity * math.exp(sum(math.log(totals[k][0] / totals[k][2]) for k in range(1, row.n + 1)) / row.n)
        assert math.isclose(row.bleu, want)


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], "pos long, text string")
    assert text.bleu(none, none).count() == 0 and text.rouge(none, none).count() == 0


def test_few_pairs_at_once(spark):
    """Pairs of texts go to Python in small batches, not in Arrow batches of 10,000 whole texts."""
    df = spark.createDataFrame([(1, "a b c")], "pos long, text string")
    plan = text.overlaps(df, df, (1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
