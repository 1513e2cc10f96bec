"""Vector, frame and waveform metrics over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clip01, cosine, mean_of

CUT = 20.0


def covariance(df: DataFrame, column: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of vectors of `dim` values: one aggregate of dim^2 sums per task, by Arrow batches."""

    def run(batches):
        n, s, p = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            for rows in np.array_split(np.array(batch.column(0).drop_null().to_pylist(), dtype=np.float64).reshape(-1, dim), max(1, len(batch) // 4096)):
                n += len(rows)
                s += rows.sum(axis=0)
                p += rows.T @ rows
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([p.ravel().tolist()])], names=["n", "s", "p"])

    parts = df.select(F.col(column).cast("array<double>")).mapInArrow(run, "n long, s array<double>, p array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "p")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").toPandas()  # dim + dim^2 rows
    n, x = int(flat["n"].iloc[0]), flat["x"].to_numpy()
    mean = x[:dim] / n
    return mean, (x[dim:].reshape(dim, dim) - n * np.outer(mean, mean)) / (n - 1)


def frechet(real: DataFrame, synth: DataFrame, column: str, dim: int) -> DataFrame:
    """(distance): |difference of means|^2 + trace of S + T - 2 (S T)^(1/2), not below 0."""
    (m, s), (n, t) = (covariance(d, column, dim) for d in (real, synth))
    value, vector = np.linalg.eigh(s)
    root = (vector * np.sqrt(np.maximum(value, 0))) @ vector.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ t @ root), 0)).sum()
    return real.sparkSession.createDataFrame([(max(0.0, float(((m - n) ** 2).sum() + np.trace(s) + np.trace(t) - 2 * cross)),)], "distance double")


def _abs_mean(a: Column, b: Column) -> Column:
    return mean_of(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def first_positions(df: DataFrame, most: int | None) -> DataFrame:
    return df if most is None else df.where(F.col("pos") <= most)


def frame_pairs(real: DataFrame, synth: DataFrame, most: int | None = None) -> DataFrame:
    """(pos, r, s) of the frames (pos from 1) of two videos; of the first `most` if given."""
    real, synth = first_positions(real, most), first_positions(synth, most)
    return real.select("pos", F.col("v").alias("r")).join(synth.select("pos", F.col("v").alias("s")), "pos")


def steps(video: DataFrame, most: int | None = None) -> DataFrame:
    """(pos, change, cos) between a frame and the one before: an equi-join on the position."""
    own = first_positions(video, most)
    back = own.select((F.col("pos") + 1).alias("pos"), F.col("v").alias("b"))
    return own.join(back, "pos").select("pos", _abs_mean(F.col("v"), F.col("b")).alias("change"), cosine(F.col("v"), F.col("b")).alias("cos"))


def frame_error(real: DataFrame, synth: DataFrame, most: int | None = None) -> DataFrame:
    """(mse): mean squared difference of paired frames, values / 255."""
    sq = mean_of(F.zip_with("r", "s", lambda x, y: F.pow((x.cast("double") - y.cast("double")) / 255, F.lit(2))))
    return frame_pairs(real, synth, most).agg(F.avg(sq).alias("mse"))


def flow_consistency(real: DataFrame, synth: DataFrame, most: int | None = None) -> DataFrame:
    """(score): 1 - mean relative difference of the changes between frames; 0.5 without any."""
    both = steps(real, most).select("pos", F.col("change").alias("r")).join(steps(synth, most).select("pos", F.col("change").alias("s")), "pos")
    return both.agg(F.coalesce(1 - F.avg(clip01(F.abs(F.col("s") / (F.col("r") + 1e-8) - 1))), F.lit(0.5)).alias("score"))


def temporal_coherence(real: DataFrame, synth: DataFrame, most: int | None = None) -> DataFrame:
    """(coherence_real, coherence_synth, score)."""
    r, s = (steps(d, most).agg(F.coalesce(F.avg(F.greatest("cos", F.lit(0.0))), F.lit(1.0)).alias(n)) for d, n in ((real, "coherence_real"), (synth, "coherence_synth")))
    return r.join(s).withColumn("score", 1 - F.abs(F.col("coherence_real") - F.col("coherence_synth")))


def scene_cuts(real: DataFrame, synth: DataFrame, threshold: float = CUT, most: int | None = None) -> DataFrame:
    """(n_real, n_synth, matched, score): cuts match at one frame's distance; F1, or 1 without cuts on either side."""
    r, s = (steps(d, most).where(F.col("change") > threshold).select("pos") for d in (real, synth))
    near = s.select(F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos")).distinct()
    n = r.agg(F.count(F.lit(1)).alias("n_real")).join(s.agg(F.count(F.lit(1)).alias("n_synth"))).join(r.join(near, "pos", "left_semi").agg(F.count(F.lit(1)).alias("matched")))
    p, q = F.col("matched") / F.greatest("n_synth", F.lit(1)), F.col("matched") / F.greatest("n_real", F.lit(1))
    return n.withColumn("score", F.when((F.col("n_real") == 0) & (F.col("n_synth") == 0), 1.0).otherwise(2 * p * q / (p + q + 1e-8)))


def waveform_correlation(real: DataFrame, synth: DataFrame, least: int = 100) -> DataFrame:
    """(pairs, correlation): mean normalised dot product of paired (pos, v) waveforms on their common length."""
    both = real.select("pos", F.col("v").alias("r")).join(synth.select("pos", F.col("v").alias("s")), "pos").withColumn("n", F.least(F.size("r"), F.size("s"))).where(F.col("n") >= least)
    return both.select(cosine(F.slice("r", F.lit(1), F.col("n")), F.slice("s", F.lit(1), F.col("n"))).alias("c")).agg(F.count("c").alias("pairs"), F.avg("c").alias("correlation"))


def snr_db(v: Column, least: int = 100) -> Column:
    """Signal-to-noise ratio; the noise floor is the root mean square of the quietest tenth."""
    rms = lambda a: F.sqrt(mean_of(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    floor = rms(F.slice(F.sort_array(F.transform(v, lambda x: F.abs(x))), F.lit(1), F.greatest(F.floor(F.size(v) / 10), F.lit(1)).cast("int")))
    return F.when(F.size(v) < least, 0.0).when(floor < 1e-8, 60.0).otherwise(20 * F.log10(rms(v) / F.nullif(floor, F.lit(0.0)) + 1e-8))


def snr_similarity(real: DataFrame, synth: DataFrame, least: int = 100) -> DataFrame:
    """(mean_difference, score) over paired waveforms: 30 dB of difference score 0."""
    both = real.select("pos", snr_db(F.col("v"), least).alias("r")).join(synth.select("pos", snr_db(F.col("v"), least).alias("s")), "pos")
    return both.agg(F.avg(F.abs(F.col("r") - F.col("s"))).alias("mean_difference")).withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("mean_difference") / 30))


def listening_score(waves: DataFrame, rate: int = 16_000) -> DataFrame:
    """(pos, mos): estimate in [1, 5] from spectral flatness, silence, clipping and energy above 4 kHz. Clips under half a second are left out."""

    def one(v: np.ndarray) -> float:
        size = np.abs(np.fft.rfft(v)) + 1e-8
        flat = np.exp(np.log(size).mean()) / size.mean()
        power = size**2
        high = power[np.fft.rfftfreq(len(v), 1 / rate) > 4000].sum() / (power.sum() + 1e-8)
        wide, hop = rate // 40, rate // 100
        at = np.arange(0, len(v) - wide + 1, hop)
        total = np.concatenate([[0.0], np.cumsum(v**2)])
        quiet = (np.sqrt(np.maximum(total[at + wide] - total[at], 0) / wide) < 0.01).mean()
        clipped = (np.abs(v) > 0.99).mean()
        return float(np.clip(4 - 1.5 * flat - 0.5 * quiet - 3 * clipped - 2 * max(0.0, high - 0.4), 1, 5))

    @F.pandas_udf("double")
    def mos(v: pd.Series) -> pd.Series:
        return v.map(lambda x: one(np.asarray(x, dtype=np.float64)))

    return waves.where(F.size("v") >= rate // 2).select("pos", mos("v").alias("mos"))


def inception_score(probabilities: DataFrame, splits: int = 10) -> DataFrame:
    """(mean, std, n_splits) over class probabilities (pos, v): exp of the mean divergence of rows from their split's mean.

    Splits are equal runs of positions; rows past the last whole one are left out. 1 and 0 without any split."""
    size = F.floor(F.col("n") / splits)
    counted = probabilities.join(F.broadcast(probabilities.agg(F.count(F.lit(1)).alias("n")))).where(F.col("pos") <= size * splits)
    cells = counted.select(F.floor(F.try_divide(F.col("pos") - 1, size)).alias("split"), F.posexplode("v").alias("k", "p"))
    shares = cells.groupBy("split", "k").agg(F.avg("p").alias("m"), F.avg(F.col("p") * F.ln(F.col("p") + 1e-8)).alias("own"))
    each = shares.groupBy("split").agg(F.exp(F.sum(F.col("own") - F.col("m") * F.ln(F.col("m") + 1e-8))).alias("s"))
    return each.agg(F.coalesce(F.avg("s"), F.lit(1.0)).alias("mean"), F.coalesce(F.stddev_pop("s"), F.lit(0.0)).alias("std"), F.count("s").alias("n_splits"))


def prosody(real: DataFrame, synth: DataFrame, rate: int = 16_000, most: int | None = None) -> DataFrame:
    """(energy_correlation, rate_similarity, score) of paired (pos, v) waveforms, the first `most` if given: 0.6 of the correlation of
    their energy envelopes (25 ms each 10 ms) and 0.4 of the ratio of their zero-crossing rates. A part without any pair is 0.5."""
    frame, hop = int(0.025 * rate), int(0.010 * rate)
    both = frame_pairs(real, synth, most).withColumn("n", F.least(F.size("r"), F.size("s"))).where((F.col("n") >= 2 * frame) & (F.col("n") >= frame + 9 * hop))

    def envelope(v: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.col("n") - frame + 1, F.lit(hop)), lambda i: F.sqrt(mean_of(F.transform(F.slice(v, i, F.lit(frame)), lambda x: x.cast("double") * x.cast("double")))))

    def crossings(v: str) -> Column:
        return mean_of(F.zip_with(F.slice(v, F.lit(2), F.col("n") - 1), F.slice(v, F.lit(1), F.col("n") - 1), lambda x, y: F.abs(F.signum(x.cast("double")) - F.signum(y.cast("double"))))) / 2

    zr, zs = crossings("r"), crossings("s")
    cells = both.select("pos", (F.least(zr, zs) / (F.greatest(zr, zs) + 1e-8)).alias("rate"), F.explode(F.arrays_zip(envelope("r").alias("r"), envelope("s").alias("s"))).alias("x"))
    each = cells.groupBy("pos").agg(F.corr("x.r", "x.s").alias("c"), F.first("rate").alias("rate"))
    found = each.agg(F.coalesce(F.avg(F.when(~F.isnan("c"), F.greatest("c", F.lit(0.0)))), F.lit(0.5)).alias("energy_correlation"), F.coalesce(F.avg("rate"), F.lit(0.5)).alias("rate_similarity"))
    return found.withColumn("score", 0.6 * F.col("energy_correlation") + 0.4 * F.col("rate_similarity"))


def structural_similarity(real: DataFrame, synth: DataFrame, shape: tuple[int, int, int], most: int | None = None, window: int = 7, span: float = 255.0) -> DataFrame:
    """(mean, std, pairs) of the SSIM (Wang et al., 2004) of paired images (pos, v), the first `most` if given, v flat by height, width and
    channel as `shape` says: uniform windows, sample covariances. Images of another size, or smaller than a window, are left out."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2

    def box(x: np.ndarray) -> np.ndarray:
        total = np.pad(x, ((1, 0), (1, 0), (0, 0))).cumsum(axis=0).cumsum(axis=1)
        return (total[window:, window:] - total[:-window, window:] - total[window:, :-window] + total[:-window, :-window]) / window**2

    def one(a, b) -> float:
        x, y = (np.asarray(v, dtype=np.float64).reshape(shape) for v in (a, b))
        mx, my, unbiased = box(x), box(y), window**2 / (window**2 - 1)
        vx, vy, vxy = (unbiased * (box(p * q) - mp * mq) for p, q, mp, mq in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
        return float(((2 * mx * my + c1) * (2 * vxy + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    pixels = shape[0] * shape[1] * shape[2]
    both = frame_pairs(real, synth, most).where((F.size("r") == pixels) & (F.size("s") == pixels) & F.lit(min(shape[:2]) >= window))
    return both.select(similarity("r", "s").alias("s")).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("s"), F.lit(0.0)).alias("std"), F.count("s").alias("pairs"))
