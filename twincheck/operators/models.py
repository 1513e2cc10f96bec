"""Similarity by fitted models: density of a mixture, a kernel classifier's confusion, and classifiers that learn from synthetic rows.

Models are fitted by Spark on all rows of their side; rows with a missing value in a used column are left out."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, materialised
from . import fits

#: Random Fourier features, and the hashed width of columns before them.
FEATURES, WIDTH = 256, 64
MAX_CLASSES = 100
#: Bins of a column in trees.
BINS = 32
#: Bins of a fold's scores.
SCORES = 1 << 14
#: Mixtures tried on a sample before the best is fitted on all rows.
STARTS = 16
#: Rows of a partition that a fit of trees holds.
NARROW_ROWS = 1 << 18


def number(c: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def scales(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations (1 for a constant column): one aggregate."""
    row = df.agg(*(f(number(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))]), np.array([row[f"s{i}"] or 1.0 for i in range(len(columns))])


def merged(df: DataFrame) -> tuple[DataFrame, int, int]:
    """df, its rows, and those before: equal rows become one with a weight w that says how many, if that saves half of them."""
    n, different = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*df.columns))).first()
    if not n or 2 * different > n:
        return df, n, n
    counted = materialised(df.groupBy(*df.columns).agg(F.count(F.lit(1)).cast("double").alias("w")))
    return counted, counted.count(), n


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df, stored, in partitions of about `rows` rows: what a fit keeps of a partition is bounded, however large the files are."""
    df = materialised(df)
    return df.repartition(max(df.rdd.getNumPartitions(), -(-df.count() // rows)))


def axes(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared widths and directions of a covariance. Flat directions count as 1e-9 wide."""
    value, vector = np.linalg.eigh(covariance)
    return np.maximum(value, 1e-9), vector


def log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """Of each row of x under a Gaussian mixture. Flat directions of a covariance count as 1e-9 wide."""
    parts = []
    for w, m, c in zip(weights, means, covariances, strict=True):
        value, vector = axes(c)
        z = (x - m) @ vector / np.sqrt(value)
        parts.append(math.log(max(w, 1e-300)) - 0.5 * ((z * z).sum(axis=1) + np.log(value).sum() + x.shape[1] * math.log(2 * math.pi)))
    parts = np.array(parts)
    top = parts.max(axis=0)
    return top + np.log(np.exp(parts - top).sum(axis=0))


def expected(x: np.ndarray, w: np.ndarray, mixture: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What a round of expectation-maximisation sums over columns x of weight w: their log density, and for each component the weight, vector and products of its share, turned and scaled by its covariance."""
    weights, means, covariances = mixture
    d, parts, turned = len(x), np.empty((len(weights), x.shape[1])), []
    for k, (a, m, c) in enumerate(zip(weights, means, covariances, strict=True)):
        value, vector = axes(c)
        z = (vector / np.sqrt(value)).T @ (x - m[:, None])
        turned.append(z)
        parts[k] = math.log(max(a, 1e-300)) - 0.5 * (np.einsum("ij,ij->j", z, z) + np.log(value).sum() + d * math.log(2 * math.pi))
    top = parts.max(axis=0)
    share = np.exp(parts - top)
    whole = share.sum(axis=0)
    share *= w / whole
    return np.concatenate([[w @ (np.log(whole) + top)], *(np.concatenate([[r.sum()], z @ r, ((z * r) @ z.T).ravel()]) for z, r in zip(turned, share, strict=True))])


def maximised(mixture: tuple[np.ndarray, np.ndarray, np.ndarray], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mixture that a round's sums lead to. A component without rows stays where it is."""
    weights, means, covariances = (np.array(a) for a in mixture)
    d = means.shape[1]
    found = sums[1:].reshape(len(weights), 1 + d + d * d)
    for k, own in enumerate(found):
        weights[k] = own[0] / found[:, 0].sum()
        if own[0] > 1e-9:
            value, vector = axes(covariances[k])
            back, s = vector * np.sqrt(value), own[1 : 1 + d] / own[0]
            means[k] = means[k] + back @ s
            covariances[k] = back @ (own[1 + d :].reshape(d, d) / own[0] - np.outer(s, s)) @ back.T
    return weights, means, covariances


def ahead(a: tuple, b: tuple, c: tuple) -> tuple:
    """Where three successive mixtures lead to (squared extrapolation); the last, if that is no mixture."""
    flat = [np.concatenate([np.log(np.maximum(m[0], 1e-300)), m[1].ravel(), m[2].ravel()]) for m in (a, b, c)]
    k, d = a[1].shape
    r, v = flat[1] - flat[0], flat[2] - 2 * flat[1] + flat[0]
    far = max(1.0, np.linalg.norm(r) / max(np.linalg.norm(v), 1e-300))
    t = flat[0] + 2 * far * r + far * far * v
    if not np.isfinite(t).all() or t[:k].max() > 700:
        return c
    weights, covariances = np.exp(t[:k]), t[k + k * d :].reshape(k, d, d)
    return (weights / weights.sum(), t[k : k + k * d].reshape(k, d), covariances) if np.linalg.eigvalsh(covariances).min() > 1e-9 else c


def mixing(mixture: tuple, n: float, rounds: int, tolerance: float) -> Generator[tuple, np.ndarray, tuple]:
    """Rounds of expectation-maximisation over n rows, every second one extrapolated, until a pair adds no more than `tolerance` to the mean log density; returns that and the mixture that has it."""
    kept, trail, plain, before = (-math.inf, mixture), [mixture], None, -math.inf
    for _ in range(rounds + 1):
        sums = yield trail[-1]
        likelihood = sums[0] / n
        if plain is not None and not likelihood >= kept[0]:
            trail, plain = [plain], None  # leapt too far
            continue
        kept = likelihood, trail[-1]
        if len(trail) == 1:
            if likelihood - before <= tolerance:
                break
            before = likelihood
        trail.append(maximised(trail[-1], sums))
        plain = None
        if len(trail) == 3:
            plain, trail = trail[2], [ahead(*trail)]
    return kept


def started(x: np.ndarray, w: np.ndarray, k: int, seed: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mixture of k components fitted on a sample: the best of STARTS, carried on. A start parts the rows by the nearest of k drawn ones."""
    rng, n = np.random.default_rng(seed), w.sum()
    fit = lambda mixture, rounds: fits.together({0: mixing(mixture, n, rounds, 1e-8)}, lambda points: {0: expected(x, w, points[0])})[0]
    found = []
    for _ in range(STARTS if k > 1 else 1):
        centers = x[:, rng.choice(x.shape[1], k, p=w / n)]
        near = ((x[:, None] - centers[:, :, None]) ** 2).sum(axis=0).argmin(axis=0)
        parts = [(np.append(centers[:, i : i + 1], x[:, near == i], axis=1), np.append(1.0, w[near == i])) for i in range(k)]
        found.append(fit((np.array([v.sum() for _, v in parts]) / (n + k), np.array([np.average(p, axis=1, weights=v) for p, v in parts]), np.array([np.atleast_2d(np.cov(p, aweights=v, ddof=0)) + 1e-3 * np.eye(len(x)) for p, v in parts])), 30))
    return fit(max(found, key=lambda f: f[0])[1], 2 * rounds)[1]


def mixture_likelihood(real: DataFrame, synth: DataFrame, columns: list[str], components: range = range(1, 6), seed: int = 42, rounds: int = 100) -> DataFrame:
    """(components, bic, n_real, n_synth, real_log_likelihood, synth_log_likelihood): mean log density of each side's rows under a mixture fitted on real rows.

    Full covariances; the number of components is the one of least BIC. All numbers of components are fitted side by side, each round over all real rows, from the best of a few starts on a sample, until a pair of rounds adds no more than 1e-5 to the mean log density.
    Where rows repeat, equal ones are fitted as one that weighs as much. With no complete real row all but the counts is null."""
    spark, d = real.sparkSession, len(columns)
    kind = "components int, bic double, n_real long, n_synth long, real_log_likelihood double, synth_log_likelihood double"
    middle, width = scales(real, columns)
    names = [f"c{i}" for i in range(d)]
    plain = lambda df: df.select(*(number(c).alias(a) for a, c in zip(names, columns, strict=True))).dropna()
    scaled = lambda df, *more: df.select(*(((F.col(a) - float(middle[i])) / float(width[i])).alias(a) for i, a in enumerate(names)), *more)
    r, s = plain(real), plain(synth)
    r, rows, n = merged(r)
    if not n:
        return spark.createDataFrame([(None, None, n, s.count(), None, None)], kind)
    table, high = fits.blocks(scaled(r, *r.columns[d:])), len(r.columns)

    def ask(points: dict) -> dict:
        def run(x: np.ndarray) -> np.ndarray:
            return np.concatenate([expected(x[:d], fits.weights(x, d), p) for p in points.values()])

        sizes = [1 + len(p[0]) * (1 + d + d * d) for p in points.values()]
        return dict(zip(points, np.split(fits.summed(table, high, run), np.cumsum(sizes)[:-1]), strict=True))

    first = fits.sample(table, high, rows)
    found = fits.together({k: mixing(started(first[:d], fits.weights(first, d), k, seed, rounds), n, rounds, 1e-5) for k in components if k <= n}, ask)
    discard(table)
    bics = {k: (k - 1 + k * d + k * d * (d + 1) // 2) * math.log(n) - 2 * n * likelihood for k, (likelihood, _) in found.items()}
    k = min(bics, key=bics.get)
    likelihood, mixture = found[k]

    def density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, m = 0.0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = fits.matrix(batch.slice(at, 4096), "<f8")
                total, m = total + float(log_density(x.T, *mixture).sum()), m + x.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([m])], names=["total", "m"])

    total, m = scaled(s).mapInArrow(density, "total double, m long").agg(F.sum("total"), F.coalesce(F.sum("m"), F.lit(0))).first()
    shift = float(np.log(width).sum())  # back from scaled columns
    return spark.createDataFrame([(k, float(bics[k] + 2 * n * shift), n, m, float(likelihood - shift), float(total / m - shift) if m else None)], kind)


def waves(size: int, gamma: float, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (a row a number) and offsets of random Fourier features."""
    rng = np.random.default_rng(seed)
    return rng.normal(scale=math.sqrt(2 * gamma), size=(size, features)), rng.uniform(0, 2 * math.pi, features)


def fourier(x: Column, size: int, gamma: float, features: int = FEATURES, seed: int = 42) -> Column:
    """Random Fourier features of vectors of `size` numbers: their inner products come near exp(-gamma |a - b|^2)."""
    directions, offsets = waves(size, gamma, features, seed)

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(math.sqrt(2 / features) * np.cos(np.stack(x.to_numpy()) @ directions + offsets))) if len(x) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<double>")(x)


class Margin:
    """A linear support vector classifier over features of mean `mean` and deviation `width`, by its scaled weights and, last, its intercept."""

    def __init__(self, mean: np.ndarray, width: np.ndarray, penalty: float):
        self.mean, self.width, self.penalty = mean, width, penalty

    def plain(self, point: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and intercept on features as they are."""
        return point[:-1] / self.width, point[-1] - point[:-1] @ (self.mean / self.width)

    def objective(self, point: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
        """sums: the hinge loss, its slopes in plain weights and intercept, and the rows."""
        n, held = max(sums[-1], 1e-300), np.append(point[:-1], 0.0)
        slope = np.append((sums[1:-2] - self.mean * sums[-2]) / self.width, sums[-2])
        return sums[0] / n + self.penalty / 2 * (held @ held), slope / n + self.penalty * held


def area(above: np.ndarray, below: np.ndarray) -> float | None:
    """Area under the curve of two histograms over rising scores; a tie counts half. None if one is empty."""
    whole = above.sum() * below.sum()
    return float((above * (np.cumsum(below) - below / 2)).sum() / whole) if whole else None


def svc_detection(real: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str], features: int = FEATURES, seed: int = 42) -> DataFrame:
    """(auc, score): how badly a support vector classifier with a Gaussian kernel, fitted on two thirds of the rows, tells the rest apart; the mean of three folds. Null if a side has no row in a fold.

    The kernel stands in random Fourier features, so that fitting stays linear in the rows; they are made where they are summed, once a round for all three fits, and never stored. Where rows repeat, equal ones are fitted as one that weighs as much.
    Folds go by a hash of the row, words are hashed to WIDTH slots, and areas are those of scores in SCORES bins a fold."""
    side = lambda df, label: df.select(*(number(c).alias(f"n{i}") for i, c in enumerate(numeric)), *(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(categorical)), F.lit(label).alias("label"))
    both = side(real, 1.0).unionByName(side(synth, 0.0)).dropna()
    names = [c for c in both.columns if c != "label"]
    p, q = len(numeric), len(names)
    middle, width = scales(both, names[:p]) if p else (np.zeros(0), np.ones(0))
    x = F.array(*((F.col(f"n{i}") - float(middle[i])) / float(width[i]) for i in range(p))).cast("array<float>").alias("x")
    at = F.array(*(F.pmod(F.xxhash64(F.lit(i), c), F.lit(WIDTH)) for i, c in enumerate(names[p:]))).cast("array<float>").alias("at")
    fold = F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(3)).cast("float").alias("fold")
    ready, rows, n = merged(both.select(x, at, F.col("label").cast("float").alias("label"), fold))
    none = real.sparkSession.createDataFrame([(None, None)], "auc double, score double")
    if not n:
        return none
    high, weighted = q + 2 + ("w" in ready.columns), ["w"] if "w" in ready.columns else []
    table = fits.blocks(ready.select(*(F.col("x")[i] for i in range(p)), *(F.col("at")[i] for i in range(q - p)), "label", "fold", *weighted), "<f4")
    first = fits.sample(table, high, rows, "<f4", 1 << 17)
    slots = np.flatnonzero(fits.summed(table, high, lambda x: sum((np.bincount(c.astype(int), minlength=WIDTH) for c in x[p:q]), np.zeros(WIDTH)), "<f4"))
    directions, offsets = waves(p + (WIDTH if q > p else 0), 1 / max(1, q), features, seed)
    turn = np.concatenate([directions[:p], directions[p + slots] if q > p else directions[:0], offsets[None]]).T.astype("f4")

    def waved(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Features (a row each), labels, folds and weights, a few rows at a time."""
        for at in range(0, x.shape[1], 512):
            part = x[:, at : at + 512]
            z = turn @ np.concatenate([spread(part[:q], p, slots, np.ones(len(slots))), np.ones((1, part.shape[1]), "f4")])
            yield np.cos(z, out=z), part[q], part[q + 1], fits.weights(part, q + 2)

    def moments(x: np.ndarray) -> np.ndarray:
        return sum(np.concatenate([z @ w, (z * z) @ w]).astype("f8") for z, _, _, w in waved(x))

    mean, square = fits.summed(table, high, moments, "<f4").reshape(2, features) / n
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    margin = Margin(mean, np.where(deviation > 1e-6, deviation, 1.0), 1e-2)

    def hinge(points: dict, x: np.ndarray) -> np.ndarray:
        """What each open fit k asks for: rows of fold k take no part in it."""
        own, plain = np.array(list(points)), [margin.plain(v) for v in points.values()]
        a, b = np.array([v for v, _ in plain], "f4"), np.array([[v] for _, v in plain], "f4")
        total = np.zeros((len(points), features + 3))
        for z, label, fold, w in waved(x):
            y, held = 2 * label - 1, (fold != own[:, None]) * w
            short = np.maximum(1 - y * (a @ z + b), 0)
            push = -y * held * (short > 0)
            total += np.concatenate([(short * held).sum(axis=1, keepdims=True), (z @ push.T).T, push.sum(axis=1, keepdims=True), held.sum(axis=1, keepdims=True)], axis=1)
        return total

    def fitted(starts: dict, total) -> dict:
        return fits.together({k: fits.descent(starts[k], margin.objective, 20, 1e-3) for k in range(3)}, lambda points: dict(zip(points, total(points), strict=True)))

    near = fitted({k: np.zeros(features + 1) for k in range(3)}, lambda points: hinge(points, first))
    points = fitted(near, lambda points: fits.summed(table, high, lambda x: hinge(points, x).ravel(), "<f4").reshape(len(points), -1))
    plain = [margin.plain(points[k]) for k in range(3)]
    a, b = np.array([v for v, _ in plain], "f4"), np.array([[v] for _, v in plain], "f4")

    def judged(z: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return (a @ z + b)[fold.astype(int), np.arange(z.shape[1])]

    seen = np.concatenate([judged(z, fold) for z, _, fold, _ in waved(first)])
    low, step = float(seen.min()), max(float(seen.max() - seen.min()), 1e-9) / (SCORES - 2)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weights by fold, label and bin of the score; the outer bins take what lies beyond the sample's scores."""
        found = np.zeros((3, 2, SCORES))
        for block in fits.opened(batches, high, "<f4"):
            for z, label, fold, w in waved(block):
                np.add.at(found, (fold.astype(int), label.astype(int), np.clip((judged(z, fold) - low) / step + 1, 0, SCORES - 1).astype(int)), w)
        k, side, bin = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(k * 2 + side), pa.array(bin), pa.array(found[k, side, bin])], names=["k", "bin", "w"])

    found = np.zeros((6, SCORES))
    for k, bin, w in table.mapInArrow(counted, "k long, bin long, w double").groupBy("k", "bin").agg(F.sum("w")).collect():
        found[k, bin] = w
    discard(table)
    areas = [area(found[2 * k + 1], found[2 * k]) for k in range(3)]
    if None in areas:
        return none
    auc = sum(areas) / 3
    return real.sparkSession.createDataFrame([(auc, 1 - (2 * max(0.5, auc) - 1))], "auc double, score double")


def spread(x: np.ndarray, numbers: int, slots: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Features of a block: its numbers, and for each of the slots how many of its words have it, over the slot's deviation."""
    hot = np.zeros((len(slots), x.shape[1]), x.dtype)
    for code in x[numbers:]:
        hot += code == slots[:, None]
    return np.concatenate([x[:numbers], hot / width[:, None].astype(x.dtype)])


class Softmax:
    """Classes by linear scores, of which two classes need one: multinomial logistic regression with a penalty on weights."""

    def __init__(self, inputs: int, classes: int, penalty: float):
        self.shape, self.classes, self.penalty = (classes if classes > 2 else 1, inputs), classes, penalty
        self.size = self.shape[0] * (inputs + 1)

    def start(self, rng: np.random.Generator) -> np.ndarray:
        return np.zeros(self.size)

    def scores(self, point: np.ndarray, x: np.ndarray) -> np.ndarray:
        found = point[: -self.shape[0]].reshape(self.shape).astype(x.dtype) @ x + point[-self.shape[0] :, None].astype(x.dtype)
        return found if len(found) > 1 else np.concatenate([np.zeros_like(found), found])

    def sums(self, point: np.ndarray, x: np.ndarray, truth: np.ndarray, w: np.ndarray) -> np.ndarray:
        loss, off = missed(self.scores(point, x), truth, w)
        off = off[-self.shape[0] :]
        return np.concatenate([[loss], (off @ x.T).ravel(), off.sum(axis=1)])

    def objective(self, point: np.ndarray, sums: np.ndarray, n: float) -> tuple[float, np.ndarray]:
        held = np.concatenate([point[: -self.shape[0]], np.zeros(self.shape[0])])
        return sums[0] / n + self.penalty / 2 * (held @ held), sums[1:] / n + self.penalty * held


class Perceptron:
    """Classes by one layer of hidden sigmoid units."""

    def __init__(self, inputs: int, classes: int, hidden: int):
        self.shapes = [(hidden, inputs), (hidden, 1), (classes, hidden), (classes, 1)]
        self.size = sum(a * b for a, b in self.shapes)

    def start(self, rng: np.random.Generator) -> np.ndarray:
        return np.concatenate([rng.normal(scale=math.sqrt(2 / (a + b)) if b > 1 else 0.1, size=a * b) for a, b in self.shapes])

    def layers(self, point: np.ndarray, dtype: np.dtype) -> list[np.ndarray]:
        return [v.reshape(shape).astype(dtype) for v, shape in zip(np.split(point, np.cumsum([a * b for a, b in self.shapes])[:-1]), self.shapes, strict=True)]

    @staticmethod
    def hidden(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
        h = a @ x
        h += b
        np.negative(np.clip(h, -80, 80, out=h), out=h)
        np.exp(h, out=h)
        h += 1
        return np.reciprocal(h, out=h)

    def scores(self, point: np.ndarray, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers(point, x.dtype)
        return c @ self.hidden(a, b, x) + d

    def sums(self, point: np.ndarray, x: np.ndarray, truth: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers(point, x.dtype)
        h = self.hidden(a, b, x)
        loss, off = missed(c @ h + d, truth, w)
        back = c.T @ off
        back *= h
        back *= 1 - h
        return np.concatenate([[loss], (back @ x.T).ravel(), back.sum(axis=1), (off @ h.T).ravel(), off.sum(axis=1)])

    def objective(self, point: np.ndarray, sums: np.ndarray, n: float) -> tuple[float, np.ndarray]:
        return sums[0] / n, sums[1:] / n


def missed(scores: np.ndarray, truth: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted cross entropy of the scores, and its slope in them."""
    scores = scores - scores.max(axis=0)
    odds = np.exp(scores)
    whole, at = odds.sum(axis=0), np.arange(len(truth))
    loss = float((w * (np.log(whole) - scores[truth, at])).sum(dtype="f8"))
    odds /= whole
    odds[truth, at] -= 1
    return loss, odds * w


def cuts(values: np.ndarray, bins: int) -> list[float]:
    """Up to bins - 1 values at which a sample's values are cut into bins of about equal numbers."""
    different = np.unique(values)
    found = different if len(different) <= bins else np.unique(np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf"))
    return [float(v) for v in found if v < different[-1]]


def bin_of(c: Column, at: list[float], first: int = 0) -> Column:
    """How many of the sorted cuts lie below c, by halving."""
    if not at:
        return F.lit(float(first))
    mid = len(at) // 2
    return F.when(c <= at[mid], bin_of(c, at[:mid], first)).otherwise(bin_of(c, at[mid + 1 :], first + mid + 1))


def transfer(real: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str], target: str, seed: int = 42) -> DataFrame:
    """(model, label, n, precision, recall, f1): classifiers learn `target` from synthetic rows and are tried on all real ones, a row per model and real class.

    Words are hashed to WIDTH slots. Trees see numbers by bins, at most BINS a column, cut by a sample, so rows of equal bins and words are fitted and tried as one that weighs as much.
    Regression and perceptron take the numbers as they are and share their readings of the rows.
    Labels that synthetic rows lack are never predicted. More than MAX_CLASSES labels are an error."""
    spark = real.sparkSession
    numbers, words = [f"n{i}" for i in range(len(numeric))], [f"c{i}" for i in range(len(categorical))]
    side = lambda df: df.select(*(number(c).alias(a) for a, c in zip(numbers, numeric, strict=True)), *(F.col(f"`{c}`").cast("string").alias(a) for a, c in zip(words, categorical, strict=True)), F.col(f"`{target}`").cast("string").alias("label")).dropna()
    r, s = side(real), side(synth)
    labels = sorted(x["label"] for x in s.select("label").distinct().limit(MAX_CLASSES + 1).collect())
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} labels")
    out = "model string, label string, n long, precision double, recall double, f1 double"
    if len(labels) < 2:
        return spark.createDataFrame([], out)
    middle, width = scales(s, numbers) if numbers else (np.zeros(0), np.ones(0))
    scaled = [((F.col(a) - float(middle[i])) / float(width[i])).cast("float").alias(a) for i, a in enumerate(numbers)]
    slot = [F.pmod(F.xxhash64(F.lit(i), a), F.lit(WIDTH)).cast("float").alias(a) for i, a in enumerate(words)]
    truth = F.coalesce(*(F.when(F.col("label") == v, F.lit(float(i))) for i, v in enumerate(labels)), F.lit(-1.0)).cast("float").alias("truth")
    p, q = len(numbers), len(numbers) + len(words)
    s, r = s.select(*scaled, *slot, truth), r.select(*scaled, *slot, truth, "label")

    train, rows, n = merged(s)
    table, high = fits.blocks(train, "<f4"), len(train.columns)
    first = fits.sample(table, high, rows, "<f4")

    def slots_in(x: np.ndarray) -> np.ndarray:
        hot = spread(x[:q], p, np.arange(WIDTH), np.ones(WIDTH))[p:].astype("f8")
        return np.concatenate([hot @ fits.weights(x, q + 1), (hot * hot) @ fits.weights(x, q + 1)])

    mean, square = fits.summed(table, high, slots_in, "<f4").reshape(2, WIDTH) / n
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    slots = np.flatnonzero(deviation > 0)
    deviation = deviation[slots]

    linear = {"logistic_regression": (Softmax(p + len(slots), len(labels), 1e-3), 50), "perceptron": (Perceptron(p + len(slots), len(labels), 16), 60)}

    def sums(points: dict, x: np.ndarray) -> np.ndarray:
        seen, at, w = spread(x[:q], p, slots, deviation), x[q].astype(int), fits.weights(x, q + 1)
        return np.concatenate([linear[k][0].sums(point, seen, at, w) for k, point in points.items()])

    def fitted(starts: dict, weight: float, total) -> dict:
        parted = lambda points, v: dict(zip(points, np.split(v, np.cumsum([1 + linear[k][0].size for k in points])[:-1]), strict=True))
        return fits.together({k: fits.descent(starts[k], lambda at, v, m=m: m.objective(at, v, weight), rounds, 1e-6) for k, (m, rounds) in linear.items()}, lambda points: parted(points, total(points)))

    rng = np.random.default_rng(seed)
    near = fitted({k: m.start(rng) for k, (m, _) in linear.items()}, float(fits.weights(first, q + 1).sum(dtype="f8")), lambda points: sum(sums(points, first[:, at : at + 4096]) for at in range(0, first.shape[1], 4096)))
    points = fitted(near, n, lambda points: fits.summed(table, high, lambda x: sums(points, x), "<f4"))
    discard(table)
    names = list(points)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of (model, truth, prediction)."""
        found = np.zeros((len(names), len(labels) + 1, len(labels)), int)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = fits.matrix(batch.slice(at, 4096), "<f4")
                seen = spread(x[:q], p, slots, deviation)
                for i, k in enumerate(names):
                    np.add.at(found[i], (x[q].astype(int), linear[k][0].scores(points[k], seen).argmax(axis=0)), 1)
        i, t, said = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.where(t == len(labels), -1, t)), pa.array(said), pa.array(found[i, t, said])], names=["model", "truth", "said", "n"])

    found = [(names[x["model"]], x["truth"], x["said"], x["n"]) for x in r.drop("label").mapInArrow(tried, "model long, truth long, said long, n long").groupBy("model", "truth", "said").agg(F.sum("n").alias("n")).collect()]

    bins = [bin_of(F.col(a), cuts(first[i], BINS)).alias(a) for i, a in enumerate(numbers)]
    features = array_to_vector(F.array(*(F.col(a) for a in numbers), *(sum((F.col(a) == F.lit(float(v))).cast("double") for a in words) for v in slots)).cast("array<double>")).alias("features")
    cells = lambda df, *more: df.select(*bins, *words, "truth", *more).groupBy(*numbers, *words, "truth", *more).agg(F.count(F.lit(1)).cast("double").alias("w"))
    learnt, asked = dealt(cells(s), NARROW_ROWS).select(features, F.col("truth").cast("double").alias("truth"), "w"), materialised(cells(r, "label"))
    boosted = GBTClassifier(labelCol="truth", weightCol="w", maxIter=10, maxDepth=4, maxBins=BINS, seed=seed)
    trees = {
        "boosted_trees": boosted if len(labels) == 2 else OneVsRest(classifier=boosted, labelCol="truth", weightCol="w", parallelism=4),
        "decision_tree": DecisionTreeClassifier(labelCol="truth", weightCol="w", maxDepth=8, maxBins=BINS, seed=seed),
    }
    for model, classifier in trees.items():
        said = classifier.fit(learnt).transform(asked.select(features, "truth", "w")).groupBy(F.col("truth").cast("int").alias("truth"), F.col("prediction").cast("int").alias("said"))
        found += [(model, x["truth"], x["said"], int(x["n"])) for x in said.agg(F.sum("w").alias("n")).collect()]
    hits, said = Counter(), Counter()
    for model, t, s_, n_ in found:
        hits[model, t] += n_ * (t == s_)
        said[model, s_] += n_
    counted = spark.createDataFrame([(model, v, hits[model, i], said[model, i]) for model in (*trees, *names) for i, v in enumerate(labels)], "model string, label string, hits long, said long")
    every = spark.createDataFrame([(model,) for model in (*trees, *names)], "model string")
    both = asked.groupBy("label").agg(F.sum("w").cast("long").alias("n")).crossJoin(F.broadcast(every)).join(F.broadcast(counted), ["model", "label"], "left").fillna(0, ["hits", "said"])
    return both.select("model", "label", "n", F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)).alias("precision"), F.try_divide("hits", "n").alias("recall"), F.try_divide(2 * F.col("hits"), F.col("n") + F.col("said")).alias("f1"))
