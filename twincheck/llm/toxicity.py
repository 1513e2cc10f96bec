"""Toxic passages by maximum-scoring segment search.

Every token carries a log-odds of toxic against clean text. Counts are smoothed by Dirichlet priors that
back off from the word over its first 6, 5, 4 and 3 bytes to all tokens, so an unseen inflection of a
toxic stem still scores. One linear scan finds all maximal-scoring segments of a document (Ruzzo and
Tompa); the best scores of clean text follow an extreme-value law, whose decay and scale are fitted on
clean labelled documents. A segment of score S in n tokens is expected K n exp(-decay S) times by
chance. Significant segments (expected fewer than `ALPHA` times) are toxic passages. The document's
p-value comes from the sum statistics of its segments; it becomes a posterior probability by the
Sellke-Bayarri-Berger bound on the Bayes factor.

Tokens are runs of ASCII letters and digits, lower-cased, and of bytes above 127.

Defined results: a null, empty or token-free text has no segment and gets the prior share of toxic rows.
Repeated rows are scored each on its own; a repeated label row counts once, with its largest label;
null labels are left out. Without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, lean, portions, prefix_hash, range_hash, remainder, text_bytes, word_bounds

#: Fitted on about so many labelled rows, chosen by a hash of their ids.
SAMPLE = 16000
STEMS = (3, 4, 5, 6)
#: Strength of each level's Dirichlet prior, in documents.
PRIOR = 5.0
#: Tokens seen in fewer sampled documents have no entry of their own; their stem speaks for them.
LEAST = 3
ALPHA = 0.05
#: Log-odds that say nothing yet.
MARGIN = 0.7
#: Standard errors that a positive log-odds must hold beyond.
CAUTION = 3.0

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[ord("0") : ord("9") + 1] = _TOKEN[ord("a") : ord("z") + 1] = _TOKEN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Model:
    """Sorted hashes of words and stems with their log-odds; decay, scale and prior of the calibration."""

    def __init__(self, keys: list[np.ndarray], odds: list[np.ndarray], rest: float, decay: float = 1.0, scale: float = 1.0, prior: float = 0.0, place: float = 0.0, spread: float = 1.0):
        self.keys, self.odds, self.rest, self.decay, self.scale, self.prior = keys, odds, rest, decay, scale, prior
        self.place, self.spread = place, spread

    def token_odds(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = prefix_hash(data)
        out = np.full(len(start), self.rest)
        for n, keys, odds in zip((*STEMS, None), self.keys, self.odds, strict=True):  # longer stems overrule shorter ones
            own = range_hash(h, start, end if n is None else np.minimum(start + n, end))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                out[hit] = odds[at[hit]]
        return out


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) in linear time.

    Only positive scores can begin or end one, so neighbours of one sign are summed first and the scan
    runs over the positive runs."""
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(up, prepend=False, append=False))
    begin, stop = edge[::2], edge[1::2]
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, nearest earlier with a smaller left sum
    for s, e in zip(begin.tolist(), stop.tolist(), strict=True):
        left, right = total[s], total[e]
        k = len(held)
        while True:
            j = k - 1
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= right:
                held[k:] = [(left, right, s, e, j)]
                break
            left, s, k = held[j][0], held[j][2], j
    return [(r - lo, s, e) for lo, r, s, e, _ in held]


def passages(model: Model, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, float, int]]:
    """(row, first byte, byte after the last, score, tokens of the row) of every maximal segment."""
    data = _LOWER[data]
    start, end = word_bounds(data, offsets, _TOKEN)
    odds = model.token_odds(data, start, end)
    at = np.searchsorted(start, offsets)
    rows = np.unique(np.searchsorted(at, np.flatnonzero(odds > 0), side="right") - 1)
    return [(row, int(start[i + s] - offsets[row]), int(end[i + e - 1] - offsets[row]), value, j - i) for row in rows.tolist() for i, j in [(at[row], at[row + 1])] for value, s, e in segments(odds[i:j])]


def evidence(model: Model, values: list[float], n: float) -> float:
    """-log p of a text's best segments together, by the sum statistics of Karlin and Altschul.

    Normalised scores are x = decay * score - log(scale * n). The r best of them, of sum s, have chance
    exp(-s) s^(r-1) / (r! (r-1)!); the r that says most counts, at a price of 2^r for having chosen it."""
    x = np.sort(model.decay * np.array(values) - np.log(model.scale * max(n, 1)))[::-1]
    x = x[x > 0]
    if not len(x):
        return 0.0
    s, r = np.cumsum(x), np.arange(1, len(x) + 1)
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(r))])
    return float(np.max(s - (r - 1) * np.log(np.maximum(s, 1)) + log_fact[r] + log_fact[r - 1] - r * np.log(2)))


def posterior(model: Model, strength: np.ndarray) -> np.ndarray:
    """Of -log p, which texts without toxic passages exceed by a Gumbel law: the Bayes factor is at most 1/(-e p ln p); the posterior follows under the prior."""
    p = np.clip(-np.expm1(-np.exp(-np.clip((strength - model.place) / model.spread, -5, 200))), 1e-80, 1)
    factor = np.where(p < 1 / np.e, 1 / (-np.e * p * np.log(np.minimum(p, 0.99))), 1.0)
    return model.prior * factor / (model.prior * factor + 1 - model.prior)


def score_rows(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    strength = np.zeros(len(offsets) - 1)
    for row, own in groupby(passages(model, data, offsets), key=lambda x: x[0]):
        own = list(own)
        strength[row] = evidence(model, [x[3] for x in own], own[0][4])
    return posterior(model, strength)


def toxic_passages(model: Model, data: np.ndarray, offsets: np.ndarray, alpha: float = ALPHA) -> list[tuple[int, int, int, float]]:
    """(row, first byte, byte after the last, expected number by chance) of the significant segments."""
    return [(row, s, e, x) for row, s, e, value, n in passages(model, data, offsets) if (x := model.scale * n * np.exp(-model.decay * value)) < alpha]


def fit_odds(words, toxic: np.ndarray, clean: np.ndarray, prior: float = PRIOR) -> Model:
    """Log-odds of each word (a list or an Arrow column of bytes) and stem from counts in toxic and clean text, each level the prior of the next.

    Words and stems are hashes in arrays: as objects they would take several times the memory of the driver."""
    total = np.array([toxic.sum(), clean.sum()], dtype=np.float64)
    share = total / max(1.0, total.sum())
    data, at = buffers(words if isinstance(words, (pa.Array, pa.ChunkedArray)) else pa.array(words, pa.binary()))
    h, start, end = prefix_hash(data), at[:-1], at[1:]
    counts = np.stack([toxic, clean], axis=1).astype(np.float64)
    keys, odds, above, level = [], [], np.zeros(len(start), dtype=np.int64), share[None, :]
    for n in (*STEMS, None):
        key, first, place = np.unique(range_hash(h, start, end if n is None else np.minimum(start + n, end)), return_index=True, return_inverse=True)
        c = np.stack([np.bincount(place, weights=counts[:, k], minlength=len(key)) for k in range(2)], axis=1)
        level = p = (c + prior * level[above[first]]) / (c.sum(axis=1, keepdims=True) + prior)
        above, n = place, c.sum(axis=1) + prior
        # against the overall share, so that an unknown token says nothing; what few documents say counts less its error
        delta = np.log((p[:, 0] + 1e-9) / (p[:, 1] + 1e-9)) - np.log((share[0] + 1e-9) / (share[1] + 1e-9))
        error = np.sqrt(1 / np.maximum(0.5, p[:, 0] * n) + 1 / np.maximum(0.5, p[:, 1] * n))
        gain = np.minimum(delta, 8) - CAUTION * error - MARGIN
        keys.append(key)
        odds.append(np.where(gain > 0, gain, np.minimum(-0.1, gain)).clip(-3))
    return Model(keys, odds, -1.0)


def calibrate(model: Model, values: list[list[float]], n: np.ndarray) -> None:
    """Fit the law on clean texts: the segment scores of each, and its tokens.

    Chance segments fall off exponentially, so decay is ln 2 over their median (at most 1, as for exact log-odds),
    and the share of texts without one is exp(-scale n). The strengths of whole texts then get a Gumbel law from their median and 98 % point."""
    got = np.array([x for v in values for x in v])
    model.decay = np.log(2) / max(np.log(2), float(np.median(got))) if len(got) >= 20 else 1.0
    model.scale = max(1e-6, -np.log(max(1e-3, 1 - (sum(map(bool, values)) + 1) / (len(values) + 2))) / max(1.0, n.mean() if len(n) else 1.0))
    if values:
        mid, high = np.quantile([evidence(model, v, k) if v else 0.0 for v, k in zip(values, n, strict=True)], [0.5, 0.98])
        model.spread = max(0.5, (high - mid) / (3.902 - 0.367))
        model.place = mid - 0.367 * model.spread


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Half of the sampled rows give the token counts, the other half the calibration."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = known.count()
    share = min(1.0, sample / max(1, n))
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20))
    chosen = known.where(h < F.lit(int(share * (1 << 20)))).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", (F.col("label") > 0).alias("toxic"), "half")

    def count(batches):
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            data, at = buffers(batch.column(0))
            data = _LOWER[data]
            start, end = word_bounds(data, at, _TOKEN)
            whole, to = data.tobytes(), np.searchsorted(start, at)
            for i, toxic in enumerate(batch.column(1).to_pylist()):
                for w in {whole[s:e] for s, e in zip(start[to[i] : to[i + 1]].tolist(), end[to[i] : to[i + 1]].tolist(), strict=True)}:
                    x = seen.setdefault(w, [0, 0])  # documents, as one may repeat a word at will
                    x[0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in range(2))], names=["word", "toxic", "clean"])

    counts = rows.where(~F.col("half")).select("text", "toxic").mapInArrow(count, "word binary, toxic long, clean long")
    # the counts of a bounded sample are bounded; rare words only count for their stems
    name = F.when(F.col("toxic") + F.col("clean") >= LEAST, F.col("word")).otherwise(F.substring("word", 1, STEMS[-1]))
    merged = counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean")))
    words = merged.groupBy(name.alias("word")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    model = lean(fit_odds, words["word"], words["toxic"].to_numpy(), words["clean"].to_numpy())
    del words

    def best(batches):
        for batch in batches:
            data, at = buffers(batch.column(0))
            start, _ = word_bounds(_LOWER[data], at, _TOKEN)
            own: list[list[float]] = [[] for _ in range(len(batch))]
            for row, _, _, value, _ in passages(model, data, at):
                own[row].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.float64())), pa.array(np.diff(np.searchsorted(start, at))), batch.column(1)], names=["values", "n", "toxic"])

    held = rows.where("half").select("text", "toxic").mapInArrow(best, "values array<double>, n long, toxic boolean").toPandas()
    clean = held[~held["toxic"].astype(bool)]
    lean(calibrate, model, [list(v) for v in clean["values"]], clean["n"].to_numpy(dtype=np.float64))
    model.prior = float(held["toxic"].mean()) if len(held) else 0.0
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Rows whose remainder is `held` teach nothing."""
    texts = text_bytes(docs, "doc_id")
    model = docs.sparkSession.sparkContext.broadcast(train(texts.where(remainder(F.col("doc_id"), modulus) != held), labels.where(remainder(F.col("doc_id"), modulus) != held)))

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(1))
            scores = [score_rows(model.value, data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in portions(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    scored = texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, whatever their id."""
    model = docs.sparkSession.sparkContext.broadcast(train(text_bytes(docs, "doc_id"), labels))
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            column = batch.column(names.index("text"))
            data, at = buffers(column.fill_null("").cast(pa.binary()))
            keep = np.concatenate([np.zeros(0, dtype=bool), *(score_rows(model.value, data[at[i] : at[j]], at[i : j + 1] - at[i]) < 0.3 for i, j in portions(at))])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
