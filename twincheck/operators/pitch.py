"""Pitch contours of waveforms and how far paired ones are apart.

Each frame's normalised autocorrelation, by FFT, gives a few candidate periods; a path through all frames, by dynamic programming, weighs their
strengths against jumps of pitch and changes between voiced and unvoiced. One waveform is one row; frames go in runs of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clip01
from .media import frame_pairs

#: The range of pitch in Hz (C2 to C7), the shortest waveform in seconds, and the deviation in Hz that scores 0.
LOWEST, HIGHEST, LEAST_SECONDS, ZERO_AT = 65.406, 2093.005, 0.5, 100.0
#: Candidates of a frame, the strength of being unvoiced, and the costs of an octave's jump, of a change of voicing and of an octave's lower pitch.
CANDIDATES, UNVOICED, JUMP, CHANGE, OCTAVE = 6, 0.5, 0.35, 0.14, 0.02
RUN = 512
#: Pairs of a task where waveforms are made after pairing: small columns would else go to few tasks.
PAIRS = 128


def candidates(x: np.ndarray, rate: float, low: float, high: float, frame: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and strengths of each frame's strongest peaks, strength -inf where there are fewer."""
    n = 1 + (len(x) - frame) // hop
    first, last = max(2, int(rate / high)), min(frame - 2, int(math.ceil(rate / low)))
    hz, strength = np.zeros((n, CANDIDATES)), np.full((n, CANDIDATES), -np.inf)
    if last <= first:
        return hz, strength
    lag = np.arange(first - 1, last + 2)
    size = 1 << (2 * frame - 1).bit_length()
    for i in range(0, n, RUN):
        f = np.lib.stride_tricks.sliding_window_view(x, frame)[i * hop : (min(i + RUN, n) - 1) * hop + 1 : hop]
        f = f - f.mean(axis=1, keepdims=True)
        r = np.fft.irfft(np.abs(np.fft.rfft(f, size)) ** 2, size)[:, lag]
        energy = np.concatenate([np.zeros((len(f), 1)), np.cumsum(f * f, axis=1)], axis=1)
        both = energy[:, frame - lag] * (energy[:, -1:] - energy[:, lag])
        r = np.where(both > 1e-12, r / np.sqrt(np.maximum(both, 1e-12)), 0.0)
        left, mid, right = r[:, :-2], r[:, 1:-1], r[:, 2:]
        bend = 2 * mid - left - right
        shift = np.where(bend > 1e-12, (right - left) / np.where(bend > 1e-12, 2 * bend, 1), 0.0)
        period = lag[1:-1] + shift
        height = np.where((mid > left) & (mid >= right) & (mid > 0), mid + (right - left) * shift / 4 - OCTAVE * np.log2(np.maximum(period * high / rate, 1e-9)), -np.inf)
        at = np.argsort(-height, axis=1)[:, :CANDIDATES]
        k = at.shape[1]
        strength[i : i + len(f), :k] = np.take_along_axis(height, at, axis=1)
        hz[i : i + len(f), :k] = rate / np.take_along_axis(period, at, axis=1)
    return hz, strength


def contour(x: np.ndarray, rate: float, low: float = LOWEST, high: float = HIGHEST, frame: int | None = None, hop: int | None = None) -> np.ndarray:
    """Pitch in Hz of each frame, NaN where it is unvoiced. Frames hold four of the longest periods."""
    frame = frame or int(4 * rate / low)
    hop = hop or max(1, frame // 4)
    x = np.nan_to_num(np.asarray(x, dtype=float), posinf=0.0, neginf=0.0)
    if len(x) < frame:
        return np.zeros(0)
    hz, strength = candidates(x, rate, low, high, frame, hop)
    n = len(hz)
    octave = np.log2(np.where(hz > 0, hz, 1.0))
    total = np.append(strength[0], UNVOICED)
    back = np.zeros((n, CANDIDATES + 1), dtype=int)
    for t in range(1, n):
        cost = np.full((CANDIDATES + 1, CANDIDATES + 1), CHANGE)
        cost[:-1, :-1] = JUMP * np.abs(octave[t][:, None] - octave[t - 1])
        cost[-1, -1] = 0.0
        reach = total - cost
        back[t] = reach.argmax(axis=1)
        total = reach.max(axis=1) + np.append(strength[t], UNVOICED)
    out, state = np.full(n, np.nan), int(total.argmax())
    for t in range(n - 1, -1, -1):
        if state < CANDIDATES:
            out[t] = hz[t, state]
        state = back[t, state]
    return out


def pitch_matching(real: DataFrame, synth: DataFrame, rate: int = 16_000, most: int | None = None, low: float = LOWEST, high: float = HIGHEST, seconds: float = LEAST_SECONDS, wave: Callable[[Column], Column] | None = None) -> DataFrame:
    """(mean_deviation_hz, pairs, score) of paired (pos, v) waveforms, the first `most` if given: mean distance of the pitch in frames that both sides voice.

    A pair is cut to the shorter side; pairs under `seconds`, or without such a frame, are left out. Without any pair the score is 0.5.
    `wave` makes a waveform of a v once its pair has met, so that smaller columns are shuffled."""

    def gap(r: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(r, s, strict=True):
            n = 0 if a is None or b is None else min(len(a), len(b))
            if n < int(seconds * rate) or not n:
                out.append(None)
                continue
            off = np.abs(contour(np.asarray(a)[:n], rate, low, high) - contour(np.asarray(b)[:n], rate, low, high))
            out.append(float(np.nanmean(off)) if np.isfinite(off).any() else None)
        return pd.Series(out, dtype="float64")

    both = frame_pairs(real, synth, most)
    if wave:
        both = both.repartition(max(1, -(-real.count() // PAIRS))).select(wave(F.col("r")).alias("r"), wave(F.col("s")).alias("s"))
    else:  # a filter on made waveforms would make them before the deal
        both = both.where(F.least(F.size("r"), F.size("s")) >= int(seconds * rate))
    doubles = lambda c: F.col(c).cast("array<double>")
    each = both.select(F.pandas_udf(gap, "double")(doubles("r"), doubles("s")).alias("d")).where("d IS NOT NULL AND NOT isnan(d)")
    found = each.agg(F.avg("d").alias("mean_deviation_hz"), F.count("d").alias("pairs"))
    return found.withColumn("score", F.when(F.col("pairs") == 0, 0.5).otherwise(clip01(1 - F.col("mean_deviation_hz") / ZERO_AT)))
