"""Similarity of sequences, a join within tolerances, and exact order statistics."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialised
from . import frequency as fq

STATISTICS = ("mean", "median", "std", "min", "max")
#: Columns that span the grid of a tolerance join: a row looks into 3^GRID cells.
GRID = 3
#: Bins of a round of selection, and values that end it.
BINS = 4096


def sequence_statistics(df: DataFrame, key: str, value: str) -> DataFrame:
    """A row per sequence: mean, lower median, sample deviation, least and largest value, to nine decimals.

    Sketches of bounded size give the medians, so that a sequence may hold any share of the rows: exact up to 10,000 different values, within a rank share of 1/10,000 beyond."""
    v = F.nanvl(F.col(f"`{value}`").cast("double"), F.lit(None).cast("double"))
    found = df.select(F.col(f"`{key}`").alias("key"), v.alias("v")).where("key IS NOT NULL AND v IS NOT NULL").groupBy("key")
    aggs = (F.avg("v"), F.percentile_approx("v", 0.5, 10_000), F.stddev_samp("v"), F.min("v"), F.max("v"))
    return found.agg(*(F.round(a, 9).alias(s) for s, a in zip(STATISTICS, aggs, strict=True)))


def sequence_similarity(real: DataFrame, synth: DataFrame, key: str, value: str) -> DataFrame:
    """(statistic, n_real, n_synth, ks, score): how alike the sides' sequences are in each statistic; one without values on a side is left out."""
    freq = fq.frequency(*(sequence_statistics(d, key, value) for d in (real, synth)), list(STATISTICS))
    return fq.profile(fq.ordered(freq)).select(F.col("column").alias("statistic"), "n_real", "n_synth", "ks", (1 - F.col("ks")).alias("score"))


def matches_within(synth: DataFrame, real: DataFrame, tolerances: dict[str, float], equal: list[str]) -> DataFrame:
    """The different rows of synth by the columns, with `n`, how often they occur, and `hit`: does a real row agree on `equal` and lie within the tolerance in every number?

    Real rows fall into cells a little wider than the tolerances. Cells keep the box of their rows, so most rows are settled by boxes: all of
    a box is near, or all but one column of it, whose end is a real value. What is left compares with the rows of the cells in question.
    Null (and NaN) agrees with null only. A tolerance of 0 is equality."""
    exact = [c for c, e in tolerances.items() if e <= 0]
    near = {c: e for c, e in tolerances.items() if e > 0}
    grid = list(near)[:GRID]
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))

    def side(df: DataFrame) -> DataFrame:
        text = [F.coalesce(v.cast("string"), F.lit("\0")) for v in (*(F.col(f"`{c}`") for c in equal), *map(number, exact))] + [number(c).isNull().cast("string") for c in near]
        return df.select(F.to_json(F.array(*text)).alias("same"), *(number(c).alias(f"v{i}") for i, c in enumerate(near)))

    values = [f"v{i}" for i in range(len(near))]
    cell = lambda i: F.coalesce(F.floor(F.col(f"v{i}") / (near[grid[i]] * 1.0001)), F.lit(0)).cast("long")
    cells = [f"g{i}" for i in range(len(grid))]
    r = materialised(side(real).distinct().select("*", *(cell(i).alias(g) for i, g in enumerate(cells))))
    s = materialised(side(synth).groupBy("same", *values).agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.struct("same", *values)))
    boxes = r.groupBy("same", *cells).agg(F.count(F.lit(1)).alias("rows"), *(f(v).alias(f"{k}_{v}") for v in values for k, f in (("lo", F.min), ("hi", F.max))))
    around = F.inline(F.array(*(F.struct(*((cell(i) + o).alias(g) for i, (g, o) in enumerate(zip(cells, steps, strict=True)))) for steps in product((-1, 0, 1), repeat=len(grid))))) if grid else F.lit(0)
    looked = s.select("row", "same", *values, around).join(boxes, ["same", *cells])
    limits = list(near.values())
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    inside = [zero(F.greatest(F.abs(F.col(v) - F.col(f"lo_{v}")), F.abs(F.col(v) - F.col(f"hi_{v}")))) <= e for v, e in zip(values, limits, strict=True)]
    reached = [zero(F.when(F.col(v) < F.col(f"lo_{v}"), F.abs(F.col(v) - F.col(f"lo_{v}"))).when(F.col(v) > F.col(f"hi_{v}"), F.abs(F.col(v) - F.col(f"hi_{v}"))).otherwise(0.0)) <= e for v, e in zip(values, limits, strict=True)]
    ended = [(F.col(v) <= F.col(f"lo_{v}")) | (F.col(v) >= F.col(f"hi_{v}")) for v in values]  # the nearest point of the box is a real value
    for e in reached:
        looked = looked.where(e)
    open_ = sum(((~i).cast("int") for i in inside), F.lit(0))
    sure = (open_ == 0) | ((open_ == 1) & _all([i | e for i, e in zip(inside, ended, strict=True)]))
    looked = materialised(looked.select("row", "same", *values, *cells, sure.alias("sure")))
    settled = looked.groupBy("row").agg(F.max("sure").alias("sure"))
    asked = looked.join(settled.where("NOT sure").select("row"), "row", "left_semi")
    close = [zero(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}"))) <= e for v, e in zip(values, limits, strict=True)]
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ["same", *cells]]
    found = asked.alias("a").join(r.alias("b"), _all([*same, *close]), "left_semi").select("row").unionByName(settled.where("sure").select("row")).distinct()
    return s.join(found.withColumn("hit", F.lit(True)), "row", "left").select("row", "n", F.coalesce("hit", F.lit(False)).alias("hit"))


def _all(terms: list):
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def new_rows_within(real: DataFrame, synth: DataFrame, tolerances: dict[str, float], equal: list[str]) -> DataFrame:
    """(n_synth, n_new, score): the share of synthetic rows that no real row comes near."""
    found = matches_within(synth, real, tolerances, equal).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_synth"), F.coalesce(F.sum(F.when(~F.col("hit"), F.col("n"))), F.lit(0)).alias("n_new"))
    return found.withColumn("score", F.try_divide("n_new", "n_synth"))


def order_statistic(df: DataFrame, column: str, k: int):
    """The k-th smallest (from 1) of the non-null values of a numeric column, exact; None beyond their number.

    Each round counts the values in BINS bins between the ends and goes on in the bin of the k-th; the driver sees the bins only."""
    v = F.col(f"`{column}`")
    whole = df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = df.select(v.alias("v")).where(v.isNotNull() if whole else v.isNotNull() & ~F.isnan(v))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not 1 <= k <= ends["n"]:
        return None
    lo, hi = ends["lo"], ends["hi"]
    alike = False
    while lo != hi:
        own = rows.where((F.col("v") >= lo) & (F.col("v") <= hi))
        if whole:
            place = F.floor((F.col("v").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")).cast("double") / ((int(hi) - int(lo)) / BINS))
        elif math.isinf(lo) or math.isinf(hi):
            place = F.when(F.col("v") == float("inf"), 1).when(F.col("v") == -float("inf"), -1).otherwise(0)
        elif alike or hi / BINS - lo / BINS <= 0:  # so near together that few doubles lie between them
            place = F.col("v")
        else:
            width = hi / BINS - lo / BINS
            place = F.floor(F.col("v") / width - F.lit(lo / width))
        bins = own.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()  # about BINS rows
        alike = len(bins) == 1
        for b in bins:
            if k <= b["n"]:
                lo, hi = b["lo"], b["hi"]
                break
            k -= b["n"]
    return lo
