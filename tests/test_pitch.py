"""Pitch of tones, glides, mixtures and noise."""

import math

import numpy as np
from pyspark.sql import functions as F

from twincheck.operators.pitch import contour, pitch_matching

RATE = 16_000
T = np.arange(RATE) / RATE


def test_tones_give_their_frequency():
    for hz in (80.0, 220.0, 441.5, 1000.0, 1900.0):
        got = contour(np.sin(2 * np.pi * hz * T), RATE)
        assert len(got) > 50 and np.nanmax(np.abs(got - hz)) < 0.01 * hz and not np.isnan(got).any()


def test_overtones_do_not_hide_the_fundamental():
    x = sum(np.sin(2 * np.pi * 150 * k * T + k) / k for k in range(1, 6)) + 0.02 * np.random.default_rng(0).normal(size=RATE)
    assert np.nanmax(np.abs(contour(x, RATE) - 150)) < 2


def test_a_glide_is_followed():
    x = np.sin(2 * np.pi * np.cumsum(200 + 200 * T) / RATE)
    got = contour(x, RATE)
    frame = int(4 * RATE / 65.406)
    want = 200 + 200 * (np.arange(len(got)) * (frame // 4) + frame / 2) / RATE
    assert np.abs(got - want).max() < 8


def test_noise_and_silence_are_unvoiced():
    assert np.isnan(contour(np.random.default_rng(1).normal(size=RATE), RATE)).mean() > 0.9
    assert np.isnan(contour(np.zeros(RATE), RATE)).all()
    assert len(contour(np.ones(10), RATE)) == 0


def test_matching(spark):
    tone = lambda hz, n=RATE: np.sin(2 * np.pi * hz * np.arange(n) / RATE).tolist()
    make = lambda waves: spark.createDataFrame(list(enumerate(waves, 1)), "pos int, v array<double>")
    real = make([tone(200), tone(300), tone(400, 1000), [0.0] * RATE])
    got = pitch_matching(real, make([tone(220), tone(300), tone(100), tone(100)])).first()
    assert got["pairs"] == 2 and abs(got["mean_deviation_hz"] - 10) < 0.5 and abs(got["score"] - 0.9) < 0.01
    assert tuple(pitch_matching(real, make([])).first()) == (None, 0, 0.5)


def test_waveforms_are_made_after_pairing(spark):
    """Waveforms made from small columns give what ready ones give, and no exchange carries them."""
    wave = lambda v: F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda t: F.sin(t * (v * 2 * math.pi / 4000)))
    real, synth = (spark.createDataFrame([(i, hz + 10.0 * i) for i in range(1, 4)], "pos long, v double") for hz in (150.0, 190.0))
    got = pitch_matching(real, synth, rate=4000, wave=wave)
    ready = [d.select("pos", wave(F.col("v")).alias("v")) for d in (real, synth)]
    assert got.first() == pitch_matching(*ready, rate=4000).first() and got.first()["pairs"] == 3
