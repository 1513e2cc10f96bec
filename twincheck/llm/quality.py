"""Quality classifier by supervised subword embeddings.

Each whitespace-separated word and each character n-gram of it, with its neighbouring white space as boundary
marker, is hashed to a learned vector; a document is the average of its vectors, and a softmax over
that average gives the label. Training is plain stochastic gradient descent in numpy. Texts are turned into
their distinct features where they lie; the one fitting task reads those, at most `BUCKETS` of a text however long it is.

At scoring time the output layer is applied to every vector once. The average of dot products equals
the dot product with the average, so a document costs one table look-up per feature.

Defined results: a null or empty text has no features and gets the learned prior (the softmax of the
bias). Repeated rows are scored each on its own. A repeated label row counts once, with its smallest
label; null labels are left out. Without any labelled row every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, buffers, mix, per_row, portions, prefix_hash, range_hash, remainder, text_bytes, word_bounds

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4)
EPOCHS = 8
RATE = 0.1
#: The classifier is fitted on about so many labelled rows, chosen by a hash of their ids.
SAMPLE = 4000


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (bucket of each feature, bounds of the rows in it): words, then n-grams for each n."""
    h = prefix_hash(data)
    start, end = word_bounds(data, offsets, ~IS_SPACE)
    out = [((range_hash(h, start, end) % np.uint64(buckets)).astype(np.int64), np.searchsorted(start, offsets))]
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    bound = np.searchsorted(first, offsets)
    row_end = np.repeat(bound[1:], np.diff(bound))
    blank = np.concatenate([[0], np.cumsum(IS_SPACE[data[first[:-1]]])])
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(row_end)) + n <= row_end)
        at = at[blank[at + n - 1] == blank[at + 1]]  # white space at its ends only
        out.append((((range_hash(h, first[at], first[at + n]) + np.uint64(n)) % np.uint64(buckets)).astype(np.int64), np.searchsorted(at, bound)))
    return out


def bags(data: np.ndarray, offsets: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct buckets with their share of the row's features."""
    found, out = features(data, offsets, buckets), []
    for i in range(len(offsets) - 1):
        ids, counts = np.unique(np.concatenate([b[at[i] : at[i + 1]] for b, at in found]), return_counts=True)
        out.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """SGD over (bucket ids, shares) rows. Returns the log-odds of label 1 that each bucket carries, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32)
    out = np.zeros((2, dim), dtype=np.float32)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    bias = np.log(np.array([1 - share, share])).astype(np.float32)
    steps, step = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, weight = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            own = vectors[ids]
            hidden = weight @ own
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # gradient of the loss by z
            back = p @ out
            out -= lr * np.outer(p, hidden)
            # shares are small: over their squared length, a step moves the document's vector by lr * back
            vectors[ids] = own - (lr / (weight @ weight)) * weight[:, None] * back[None, :]
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score_rows(data: np.ndarray, offsets: np.ndarray, odds: np.ndarray, bias: float) -> np.ndarray:
    total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for ids, at in features(data, offsets, len(odds)):
        total += per_row(odds[ids].astype(np.float64), at)
        n += np.diff(at)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on about `sample` of the labelled rows, in one task whose input is bounded by the features of so many rows."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    n = known.count()
    share = min(1.0, sample / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", F.col("label").cast("int"), F.xxhash64("doc_id").alias("h"))

    def shown(batches):
        for batch in batches:
            data, at = buffers(batch.column(0))
            bag = [x for i, j in portions(at) for x in bags(data[at[i] : at[j]], at[i : j + 1] - at[i], BUCKETS)]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes() for x, _ in bag], pa.binary()), pa.array([w.tobytes() for _, w in bag], pa.binary()), batch.column(1), batch.column(2)], names=["ids", "share", "label", "h"])

    def run(batches):
        held = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        held.sort(key=lambda x: (x[3], x[0], x[1]))  # as rows arrive in any order
        bag = [(np.frombuffer(i, dtype="<i4").astype(np.int64), np.frombuffer(w, dtype=np.float32)) for i, w, _, _ in held]
        odds, bias = fit(bag, np.array([y > 0 for _, _, y, _ in held], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([odds.tobytes()], pa.binary()), pa.array([bias])], names=["odds", "bias"])

    one = rows.mapInArrow(shown, "ids binary, share binary, label int, h long").repartition(1).mapInArrow(run, "odds binary, bias double").first()
    if one is None:  # no labelled row: every text gets one half
        return np.zeros(BUCKETS, dtype=np.float32), 0.0
    return np.frombuffer(bytes(one["odds"]), dtype=np.float32), one["bias"]


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Rows whose remainder is `held` teach nothing."""
    texts = text_bytes(docs, "doc_id")
    odds, bias = train(texts.where(remainder(F.col("doc_id"), modulus) != held), labels.where(remainder(F.col("doc_id"), modulus) != held), label)
    model = docs.sparkSession.sparkContext.broadcast((odds, bias))  # BUCKETS floats

    def run(batches):
        odds, bias = model.value
        for batch in batches:
            data, at = buffers(batch.column(1))
            scores = [score_rows(data[at[i] : at[j]], at[i : j + 1] - at[i], odds, bias) for i, j in portions(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    scored = texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
