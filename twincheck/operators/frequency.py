"""The frequency table of two datasets, and what all column metrics derive from it.

One aggregate with map-side combine turns both sides into (column, value, n_real, n_synth). `ordered` adds cumulative
counts without a task that sees a whole column: rows are range-partitioned by (column, value), each range sums its own, and
the ranges' totals, one row per range, are summed up in turn.

Null and NaN values are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clip01, entropy_term, ks_pvalue
from ..plans.storage import materialised

BINS = 50
EPSILON = 1e-10
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def frequency(real: DataFrame, synth: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """(column, value, n_real, n_synth) of the columns that both sides have. kind: the common type, double or string."""

    def side(df: DataFrame, r: int, s: int) -> DataFrame:
        cell = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns)))
        long = df.select(cell.alias("cell")).select("cell.*").where("value IS NOT NULL")
        long = long.where(~F.isnan("value")) if kind == "double" else long
        return long.select("column", "value", F.lit(r).alias("r"), F.lit(s).alias("s"))

    both = side(real, 1, 0).unionByName(side(synth, 0, 1))
    return both.groupBy("column", "value").agg(F.sum("r").alias("n_real"), F.sum("s").alias("n_synth"))


def ordered(freq: DataFrame) -> DataFrame:
    """freq with cumulative counts (cum_*), totals (total_*), means (mean_*), the joint range (lo, hi) and the next value of the column."""
    ranged = materialised(freq.repartitionByRange("column", "value").withColumn("bucket", F.spark_partition_id()))
    sums = [F.sum(c).alias(c) for c in ("n_real", "n_synth")] + [F.sum(F.col("value") * F.col(c)).alias(f"sum_{c}") for c in ("n_real", "n_synth")]
    heads = ranged.groupBy("column", "bucket").agg(*sums, F.min("value").alias("first"), F.max("value").alias("last"))
    order = Window.partitionBy("column").orderBy("bucket")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("column")
    heads = heads.select(
        "column",
        "bucket",
        F.lead("first").over(order).alias("next_first"),
        F.min("first").over(whole).alias("lo"),
        F.max("last").over(whole).alias("hi"),
        *(F.coalesce(F.sum(f"n_{s}").over(before), F.lit(0)).alias(f"before_{s}") for s in ("real", "synth")),
        *(F.sum(f"n_{s}").over(whole).alias(f"total_{s}") for s in ("real", "synth")),
        *((F.try_divide(F.sum(f"sum_n_{s}").over(whole), F.sum(f"n_{s}").over(whole))).alias(f"mean_{s}") for s in ("real", "synth")),
    )
    w = Window.partitionBy("column", "bucket").orderBy("value")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    # heads: a row per range and column at most
    return ranged.join(F.broadcast(heads), ["column", "bucket"]).select(
        "column", "value", "n_real", "n_synth", "total_real", "total_synth", "mean_real", "mean_synth", "lo", "hi",
        *((F.col(f"before_{s}") + F.sum(f"n_{s}").over(up_to)).alias(f"cum_{s}") for s in ("real", "synth")),
        F.coalesce(F.lead("value").over(w), F.col("next_first")).alias("next_value"),
    )


def profile(cumulative: DataFrame, least: int = 1) -> DataFrame:
    """Per column: counts, KS, Wasserstein-1, moments, quantiles and the Anderson-Darling sum. Columns with fewer than `least` values on a side are left out."""
    n, m = F.col("total_real"), F.col("total_synth")
    big, l = n + m, F.col("n_real") + F.col("n_synth")
    gap = F.abs(F.col("cum_real") / n - F.col("cum_synth") / m)
    mid = F.col("cum_real") + F.col("cum_synth") - l / 2
    spread = mid * (big - mid) - big * l / 4
    inner = lambda s: F.pow(big * (F.col(f"cum_{s}") - F.col(f"n_{s}") / 2) - F.col(f"total_{s}") * mid, F.lit(2)) / F.col(f"total_{s}")
    aggs = [
        F.max(gap).alias("ks"),
        F.sum(F.when(F.col("next_value").isNotNull(), gap * (F.col("next_value") - F.col("value"))).otherwise(0.0)).alias("wasserstein"),
        (F.sum(F.when(spread > 0, l / big * (inner("real") + inner("synth")) / spread).otherwise(0.0)) * F.first((big - 1) / big)).alias("a2"),
        F.sum(F.when((F.col("value") >= F.col("lo_real")) & (F.col("value") <= F.col("hi_real")), F.col("n_synth")).otherwise(0)).alias("n_inside"),
        F.first("lo_real").alias("lo_real"), F.first("hi_real").alias("hi_real"), F.first("lo_synth").alias("lo_synth"), F.first("hi_synth").alias("hi_synth"),
    ]
    for s in ("real", "synth"):
        off = F.col("value") - F.col(f"mean_{s}")
        aggs += [F.first(f"mean_{s}").alias(f"mean_{s}")] + [(F.sum(F.pow(off, F.lit(k)) * F.col(f"n_{s}")) / F.first(f"total_{s}")).alias(f"m{k}_{s}") for k in (2, 3, 4)]
        for q in QUANTILES:
            rank = F.floor((F.col(f"total_{s}") - 1) * F.lit(q))
            at = lambda r, s=s: F.min(F.when(F.col(f"cum_{s}") > r, F.col("value")))
            low, high = at(rank), at(F.least(rank + 1, F.col(f"total_{s}") - 1))
            share = F.first((F.col(f"total_{s}") - 1) * F.lit(q) - rank)
            aggs.append((low + (high - low) * share).alias(f"q{int(q * 100)}_{s}"))
    bounds = cumulative.groupBy("column").agg(*(f(F.when(F.col(f"n_{s}") > 0, F.col("value"))).alias(f"{k}_{s}") for s in ("real", "synth") for k, f in (("lo", F.min), ("hi", F.max))))
    return cumulative.where((n >= least) & (m >= least)).join(F.broadcast(bounds), "column").groupBy("column", F.col("total_real").alias("n_real"), F.col("total_synth").alias("n_synth")).agg(*aggs)


def histogram(freq: DataFrame, bins: int = BINS) -> DataFrame:
    """(column, bin, h_real, h_synth, constant): equal widths over the joint range, every bin present; the last bin holds the upper end."""
    ends = freq.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = freq.join(F.broadcast(ends), "column").groupBy("column", place.alias("bin")).agg(F.sum("n_real").alias("h_real"), F.sum("n_synth").alias("h_synth"))
    grid = ends.select("column", (F.col("lo") == F.col("hi")).alias("constant"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["column", "bin"], "left").fillna(0, ["h_real", "h_synth"])


def divergence(hist: DataFrame, bins: int = BINS) -> DataFrame:
    """(column, kl, js) of smoothed histograms; a constant column diverges by 0."""
    w = Window.partitionBy("column")  # `bins` rows
    p, q = ((F.col(f"h_{s}") + EPSILON) / (F.sum(f"h_{s}").over(w) + bins * EPSILON) for s in ("real", "synth"))
    shares = hist.select("column", "constant", p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    p, q, m = F.col("p"), F.col("q"), F.col("m")
    got = shares.groupBy("column", "constant").agg(F.sum(entropy_term(p, q)).alias("kl"), (0.5 * F.sum(entropy_term(p, m)) + 0.5 * F.sum(entropy_term(q, m))).alias("js"))
    return got.select("column", *(F.when(F.col("constant"), 0.0).otherwise(F.col(c)).alias(c) for c in ("kl", "js")))


def numeric_scores(real: DataFrame, synth: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """One row per numeric column: distances, moments and the column's weighted score."""
    freq = materialised(frequency(real, synth, columns))
    found = profile(ordered(freq), least).join(F.broadcast(divergence(histogram(freq))), "column")
    width = F.col("hi_real") - F.col("lo_real")
    std = {s: F.sqrt(f"m2_{s}") for s in ("real", "synth")}
    shape = lambda k, s: F.col(f"m{k}_{s}") / F.nullif(F.pow(std[s], F.lit(k)), F.lit(0.0)) - (3 if k == 4 else 0)
    scale = std["real"] + 1e-8

    def close(k: int, by: float):
        a, b = shape(k, "real"), shape(k, "synth")
        return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(1 - clip01(F.abs(a - b) / by))

    stats = 0.35 * (1 - clip01(F.abs(F.col("mean_real") - F.col("mean_synth")) / scale)) + 0.35 * (1 - clip01(F.abs(std["real"] - std["synth"]) / scale)) + 0.15 * close(3, 5.0) + 0.15 * close(4, 10.0)
    off = sum((clip01(F.abs(F.col(f"q{int(q * 100)}_real") - F.col(f"q{int(q * 100)}_synth")) / (F.abs(F.col(f"q{int(q * 100)}_real")) + 1e-8)) for q in QUANTILES), F.lit(0.0)) / len(QUANTILES)
    scored = found.select(
        "*",
        F.when(width > 0, F.greatest(F.lit(0.0), 1 - F.col("wasserstein") / F.nullif(width, F.lit(0.0)))).otherwise(1.0).alias("wasserstein_score"),
        (1 - clip01(F.col("kl") / 10)).alias("kl_score"),
        (1 - F.col("ks")).alias("ks_score"),
        ks_pvalue(F.col("ks"), F.col("n_real"), F.col("n_synth")).alias("ks_pvalue"),
        stats.alias("statistics_score"),
        (1 - off).alias("quantile_similarity"),
        std["real"].alias("std_real"),
        std["synth"].alias("std_synth"),
        (F.col("n_inside") / F.col("n_synth")).alias("boundary_adherence"),
    )
    return scored.withColumn("column_score", 0.35 * F.col("wasserstein_score") + 0.25 * F.col("kl_score") + 0.25 * F.col("statistics_score") + 0.15 * F.col("ks_score"))


def categorical_scores(real: DataFrame, synth: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """One row per categorical column: TV, JS, coverage, adherence, chi-squared and the weighted score.

    Everything is a plain aggregate over the frequency table and its per-column totals."""
    return category_distances(frequency(real, synth, columns, "string"), least)


def category_distances(freq: DataFrame, least: int = 1) -> DataFrame:
    """As categorical_scores, of a table (column, value, n_real, n_synth)."""
    freq = materialised(freq)
    totals = freq.groupBy("column").agg(F.sum("n_real").alias("N"), F.sum("n_synth").alias("M"), F.count(F.lit(1)).alias("k"))
    rows = freq.join(F.broadcast(totals), "column").where((F.col("N") >= least) & (F.col("M") >= least))  # totals: a row per column
    a, b, n, m, k = (F.col(c) for c in ("n_real", "n_synth", "N", "M", "k"))
    p, q = a / n, b / m
    sp, sq = (p + EPSILON) / (1 + k * EPSILON), (q + EPSILON) / (1 + k * EPSILON)
    mid = (sp + sq) / 2
    row = a + b

    def off(seen, total):
        """Squared deviation over the expected count; with one degree of freedom after the continuity correction."""
        expected = row * total / (n + m)
        gap = F.abs(seen - expected)
        return F.pow(F.when(k == 2, F.greatest(F.lit(0.0), gap - 0.5)).otherwise(gap), F.lit(2)) / expected

    out = rows.groupBy("column", n.alias("total_real"), m.alias("total_synth"), k.alias("n_categories")).agg(
        (0.5 * F.sum(F.abs(p - q))).alias("tv_distance"),
        (0.5 * F.sum(entropy_term(sp, mid)) + 0.5 * F.sum(entropy_term(sq, mid))).alias("js_divergence"),
        F.count_if(a > 0).alias("unique_real"),
        F.count_if(b > 0).alias("unique_synth"),
        (F.count_if((a > 0) & (b > 0)) / F.count_if(a > 0)).alias("coverage"),
        (F.sum(F.when(a > 0, b).otherwise(0)) / F.first("M")).alias("adherence"),
        F.sum(F.when(k > 1, off(a, n) + off(b, m)).otherwise(0.0)).alias("chi2"),
        F.count_if(b == 1).alias("singletons_synth"),
    )
    js = 1 - clip01(F.col("js_divergence"))
    return out.select("*", (1 - F.col("tv_distance")).alias("tv_score"), js.alias("js_score"), (F.col("n_categories") - 1).alias("dof")).withColumn("column_score", 0.4 * F.col("tv_score") + 0.4 * F.col("js_score") + 0.2 * F.col("coverage"))
