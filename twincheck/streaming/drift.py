"""A drift monitor for streams: per time window and category, shares against a fixed reference. An addition; batch datasets need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, ts: str = "ts", category: str = "event_type", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, category, n) by tumbling windows; streaming input gets a watermark."""
    own = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    own = own.withWatermark("__ts", late) if events.isStreaming else own
    return own.groupBy(F.window("__ts", width).alias("w"), F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "category", "n")


def drift(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """(start, tv_distance) of each window's shares from reference(category, share)."""
    shares = counts.groupBy("start").agg(F.sum("n").alias("total"))
    grid = shares.join(F.broadcast(reference)).join(counts, ["start", "category"], "left")
    known = grid.groupBy("start").agg(F.sum(F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("share"))).alias("a"))
    new = counts.join(F.broadcast(reference), "category", "left_anti").join(shares, "start").groupBy("start").agg(F.sum(F.col("n") / F.col("total")).alias("b"))
    return known.join(new, "start", "left").select("start", (0.5 * (F.col("a") + F.coalesce("b", F.lit(0.0)))).alias("tv_distance"))
