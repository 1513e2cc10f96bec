"""Text metrics over (pos, text) corpora: the position pairs a synthetic text with its real one.

Tokens are lower-cased runs of other characters than the regular expression class \\s of ASCII."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine
from ..plans.storage import materialised

WINDOW = 3
UNKNOWN = 1e-8
SPACE = re.compile(r"[ \t\n\x0B\f\r]+")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def positioned(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """df with pos 1, 2, ... in the order of a unique key. Ranges of the key are numbered on their own and shifted by what comes before."""
    ranged = materialised(df.select(F.col(key).alias("__key"), *columns).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    heads = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # a row per partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    return ranged.join(F.broadcast(heads), "__part").select((F.col("__before") + own).alias("pos"), *columns)


def shared_grams(real: str, synth: str, most: int) -> list[tuple[int, int, int]]:
    """(hit, nr, ns) for n = 1 to most: n-grams that two lower-cased texts share (the lesser count of each) and that each has.

    An n-gram is numbered by its first n-1 words' number and its last word's."""
    first, second = (SPACE.sub(" ", x).strip(" ").split(" ") if x and SPACE.sub("", x) else [] for x in (real, synth))
    numbers: dict[str, int] = {}
    words = [np.array([numbers.setdefault(w, len(numbers)) for w in x], dtype=np.int64) for x in (first, second)]
    found, grams, kinds = [], words, max(len(numbers), 1)
    for n in range(1, most + 1):
        if n > 1:
            longer = [g[: max(len(w) - n + 1, 0)] * len(numbers) + w[n - 1 :] for g, w in zip(grams, words, strict=True)]
            known, numbered = np.unique(np.concatenate(longer), return_inverse=True)
            grams, kinds = [numbered[: len(longer[0])], numbered[len(longer[0]) :]], max(len(known), 1)
        r, s = (np.bincount(g, minlength=kinds) for g in grams)
        found.append((int(np.minimum(r, s).sum()), len(grams[0]), len(grams[1])))
    return found


def overlaps(real: DataFrame, synth: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(pos, n, hit, nr, ns): shared n-grams (the lesser count of each), and n-grams of the real and of the synthetic text of a position that both have.

    The texts of a position meet once, by its number, and are counted there: no n-gram is shuffled, and a task holds one pair's numbers at a time.
    Every position has a row for every n, of zeros if no text is long enough. A null text has no words; positions are unique."""
    most = max(sizes)

    def run(r: str, s: str) -> list[tuple[int, int, int, int]]:
        return [(n, *counts) for n, counts in enumerate(shared_grams(r, s, most), 1)]

    count = F.udf(run, "array<struct<n:int,hit:long,nr:long,ns:long>>", useArrow=False)  # a hundred pairs of texts at once in Python, an Arrow batch would be 10,000
    pairs = real.select("pos", F.lower("text").alias("r")).join(synth.select("pos", F.lower("text").alias("s")), "pos")
    counted = pairs.select("pos", count("r", "s").alias("c"))
    return counted.select("pos", F.explode("c").alias("x")).select("pos", "x.*").where(F.col("n").isin(*sizes))


def bleu(real: DataFrame, synth: DataFrame, most: int = 4) -> DataFrame:
    """(n, matched, total, bleu): corpus BLEU-n of the synthetic texts against the real text of the same position, uniform weights up to n.

    Without a common position there is no row."""
    sums = overlaps(real, synth, tuple(range(1, most + 1))).groupBy("n").agg(F.sum("hit").alias("matched"), F.sum("ns").alias("total"), F.sum("nr").alias("r"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # a row per n
    r, s = F.first("r").over(w), F.first("total").over(w)  # words, as n = 1 comes first
    brevity = F.when(s > r, 1.0).otherwise(F.exp(1 - F.try_divide(r, s)))
    log = F.when(F.col("matched") > 0, F.ln(F.col("matched") / F.col("total")))
    score = F.when(F.count_if(F.col("matched") == 0).over(w) > 0, 0.0).otherwise(brevity * F.exp(F.avg(log).over(w)))
    return sums.select("n", "matched", "total", score.alias("bleu"))


def rouge(real: DataFrame, synth: DataFrame, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(n, precision, recall, f1): means over pairs of n-gram overlap, without a stemmer. Without a common position there is no row."""
    p, q = F.coalesce(F.try_divide("hit", "ns"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "nr"), F.lit(0.0))
    f1 = F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)
    return overlaps(real, synth, sizes).groupBy("n").agg(F.avg(p).alias("precision"), F.avg(q).alias("recall"), F.avg(f1).alias("f1"))


def subsequence(x, y) -> int:
    """Length of the longest common subsequence of two token lists, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(x)) - 1
    v = full
    for w in y:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def common_subsequence(a: str, b: str) -> Column:
    return F.udf(subsequence, "long", useArrow=False)(a, b)


def rouge_l(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(precision, recall, f1): means over pairs by longest common subsequence."""
    pairs = real.select("pos", tokens(F.col("text")).alias("r")).join(synth.select("pos", tokens(F.col("text")).alias("s")), "pos")
    got = pairs.select(common_subsequence("r", "s").alias("l"), F.size("r").alias("nr"), F.size("s").alias("ns"))
    p, q = F.coalesce(F.try_divide("l", "ns"), F.lit(0.0)), F.coalesce(F.try_divide("l", "nr"), F.lit(0.0))
    return got.agg(F.avg(p).alias("precision"), F.avg(q).alias("recall"), F.avg(F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)).alias("f1"))


def perplexity(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(h_real, h_synth, score): unigram cross-entropies in bits under the real corpus, which smooths by one; unknown words cost 1e-8."""

    def words(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias(name))

    both = materialised(words(real, "r").join(words(synth, "s"), "w", "full").fillna(0, ["r", "s"]))
    totals = both.agg(F.sum("r").alias("N"), F.count_if(F.col("r") > 0).alias("V"), F.sum("s").alias("M"))
    cost = -F.log2(F.when(F.col("r") > 0, (F.col("r") + 1) / (F.col("N") + F.col("V"))).otherwise(UNKNOWN))
    h = both.join(F.broadcast(totals)).groupBy("N", "M").agg(F.sum(F.col("r") * cost).alias("hr"), F.sum(F.col("s") * cost).alias("hs"))
    h = h.select(F.coalesce(F.try_divide("hr", "N"), F.lit(0.0)).alias("h_real"), F.coalesce(F.try_divide("hs", "M"), F.lit(0.0)).alias("h_synth"))
    return h.withColumn("score", F.when(F.col("h_real") <= 0, 1.0).otherwise(1 - F.least(F.abs(F.col("h_synth") / F.nullif("h_real", F.lit(0.0)) - 1), F.lit(1.0))))


def paired_cosine(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(mean, std, min, max, pairs) of the cosines of (pos, v) vectors at equal positions."""
    c = real.select("pos", F.col("v").alias("r")).join(synth.select("pos", F.col("v").alias("s")), "pos").select(cosine(F.col("r"), F.col("s")).alias("c"))
    return c.agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.min("c").alias("min"), F.max("c").alias("max"), F.count("c").alias("pairs"))


def coherence(corpus: DataFrame, most: int | None = None) -> DataFrame:
    """(coherence): mean of max(0, mean of the three unit vectors before . the next), over all positions or the first `most`; 1 for fewer than four."""
    own = corpus if most is None else corpus.where(F.col("pos") <= most)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + 1e-8
    unit = own.select("pos", F.transform("v", lambda x: x.cast("double") / length).alias("u"))
    back = [unit.select((F.col("pos") + k).alias("pos"), F.col("u").alias(f"b{k}")) for k in range(1, WINDOW + 1)]
    joined = unit
    for b in back:
        joined = joined.join(b, "pos")
    dots = sum((F.aggregate(F.zip_with("u", f"b{k}", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for k in range(1, WINDOW + 1)), F.lit(0.0)) / WINDOW
    return joined.agg(F.coalesce(F.avg(F.greatest(dots, F.lit(0.0))), F.lit(1.0)).alias("coherence"))
