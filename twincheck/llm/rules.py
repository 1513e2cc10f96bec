"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes for quality (1), against it (-1) or abstains (0). How often each combination of votes
occurs is one aggregate of at most 3^rules rows; expectation-maximisation on these counts estimates,
per rule, how likely its votes are in good and in bad documents, and the share of good ones. A document's
posterior probability of being good is then a sum of looked-up log-odds, and documents of at least
`THRESHOLD` are kept, unless one of the two base rules fails them.

Repeated words are counted by hashes of 8-word windows. Only documents in which a window hash occurs
twice go through the step that merges their places.

Defined results: a null text has no words; it fails the base rule. Repeated rows are judged each on its own.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

SYMBOLS = r"[#*$%&|<>]"
GRAM = 8
THRESHOLD = 0.5
ROUNDS = 60
#: A vote against lowers the log-odds by this much at least: rules are taken to be better than chance. Abstaining says nothing.
LEAST_ODDS = 1.0
#: Pseudo-counts of every vote in either class.
SMOOTH = 1.0


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, n: int = GRAM) -> Column:
    """Words inside n-word windows that occur twice or more in the array, the first occurrence included."""

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(rows: Column) -> Column:
            last = F.size(rows) - 1
            twin = lambda x, i: ((i > 0) & (F.get(rows, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(rows, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(rows, twin), lambda x: x["i"]))

        def total(at: Column) -> Column:
            gap = lambda x, i: F.when(i + 1 < F.size(at), F.least(F.lit(n), F.get(at, i + 1) - x)).otherwise(F.lit(n))
            return F.aggregate(F.transform(at, gap), F.lit(0), lambda a, x: a + x)

        return let(let(ranked, places), total)

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (n - 1)), lambda i: F.xxhash64(*(F.element_at(hashes, i + k) for k in range(n))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))

    return F.when(F.size(words) < n + 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    count = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")
    return text.select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated"), F.size(F.array_distinct(w)).cast("long").alias("distinct"))).alias("w"),
        F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        count(r"[A-Z]+").alias("upper"),
        count(r"[!?]+").alias("marks"),
        count(r"[.,]+").alias("stops"),
    ).select("doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.repeated").alias("n_repeat_words"), "upper", "marks", "stops", F.col("w.distinct").alias("distinct"))


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule's vote. Shares are by word or by character."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < 20),
        "word_size": vote((chars / n).between(3, 9), ~(chars / n).between(2, 14)),
        "symbols": vote(F.col("n_symbols") / n < 0.02, F.col("n_symbols") / n > 0.1),
        "capitals": vote(F.col("upper") / chars < 0.1, F.col("upper") / chars > 0.3),
        "marks": vote(F.col("marks") / n < 0.05, F.col("marks") / n > 0.3),
        "lines": vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") >= 3),
        "repeats": vote(F.col("n_repeat_words") / n < 0.05, F.col("n_repeat_words") / n > 0.2),
        "variety": vote(F.col("distinct") / n > 0.3, (F.col("distinct") / n < 0.1) & (F.col("n_words") < 2000)),
        "stops": vote((F.col("stops") / n).between(0.03, 0.4), (F.col("n_words") >= 20) & ((F.col("stops") / n < 0.005) | (F.col("stops") / n > 0.6))),
    }


def estimate(counts: dict[tuple[int, ...], int], n: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """EM over vote combinations. Returns the log-odds of a good document, and per rule the log-odds that each vote adds.

    It starts with documents as bad that have a vote against them, as rules vote so seldom by chance."""
    p = {v: 0.05 if min(v, default=0) < 0 else 0.95 for v in counts}
    prior, odds = 0.0, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(n)]
    for _ in range(rounds):
        good = sum(p[v] * c for v, c in counts.items())
        bad = sum((1 - p[v]) * c for v, c in counts.items())
        prior = math.log((good + SMOOTH) / (bad + SMOOTH))
        for k in range(n):
            g, b = ({x: SMOOTH + sum(w(v) * c for v, c in counts.items() if v[k] == x) for x in (-1, 1)} for w in (lambda v: p[v], lambda v: 1 - p[v]))
            ratio = {x: math.log(g[x] / (g[-1] + g[1])) - math.log(b[x] / (b[-1] + b[1])) for x in (-1, 1)}
            odds[k] |= {-1: min(-LEAST_ODDS, ratio[-1]), 1: max(0.0, ratio[1])}
        p = {v: 1 / (1 + math.exp(-max(-40.0, min(40.0, prior + sum(odds[k][x] for k, x in enumerate(v)))))) for v in counts}
    return prior, odds


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and quality (the posterior) of every row."""
    found = measures(docs)
    own = rules()
    voted = stored(found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(c.alias(f"vote_{k}") for k, c in own.items())))
    names = [f"vote_{k}" for k in own]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # what the base rules reject is decided; the rest shows how the rules agree
    counts = {tuple(r[:-1]): r[-1] for r in voted.where(~failed).groupBy(*names).count().collect()}  # at most 3^rules rows
    prior, odds = estimate(counts, len(names))
    z = F.lit(prior)
    for name, o in zip(names, odds, strict=True):
        z = z + F.when(F.col(name) == 1, F.lit(o[1])).when(F.col(name) == -1, F.lit(o[-1])).otherwise(F.lit(o[0]))
    quality = 1 / (1 + F.exp(-z))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), quality.alias("quality"))
