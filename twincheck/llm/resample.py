"""Importance resampling towards a target: documents drawn by how much their n-grams look like the target's.

Runs of 1 to `GRAMS` words are the features; each falls into one of `BUCKETS` buckets by the crc32 of its bytes. A
bucket's gain is the scaled log ratio of its smoothed shares in the target and in the documents, a document's weight the
sum of its features' gains. Noise by a digest of seed and doc_id makes the highest scores a draw without replacement.

The features are enumerated by suffix arrays over word ids, one for each stretch of `PORTION` bytes of a partition.
Suffixes are sorted to a depth of GRAMS words. Where neighbours share at least k words (their LCP), they lie in one
run of the same k-gram: it is hashed once, and its bucket is scattered back to all its occurrences. A text longer than a
stretch goes on in the next one, which begins with the words before the cut that its first features need.

The counts of the buckets are the only thing that is gathered: BUCKETS numbers a task, summed in Spark, then one table
of BUCKETS gains for all tasks. Ranks come from scores in ranges: of the rows that a histogram of at most 4,096 bins
can't rule out, those with equal values are one row with a count, so that no value is too frequent for one range.

Defined results: a null text has no words and a text without words weighs 0. A null doc_id counts as '' in the digest and ranks
behind others of its score. Repeated rows are rows of their own; of equal rows some may be drawn and others not. Documents of fewer
than LEAST_WORDS words are never drawn. Other columns are ignored. Empty documents give an empty result; an empty target has
no features, its shares are those of the smoothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, stored, text_bytes

GRAMS = 1
BUCKETS = 10_000
SEED = 2024
#: Hundredths of the documents of at least LEAST_WORDS words that are drawn.
DRAWN, LEAST_WORDS = 10, 20
#: Bytes of text under one suffix array.
PORTION = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words: digits, letters and all of characters beyond ASCII.
INSIDE = np.zeros(256, dtype=bool)
INSIDE[ord("0") : ord("9") + 1] = INSIDE[ord("a") : ord("z") + 1] = INSIDE[128:] = True


def stretches(data: np.ndarray, offsets: np.ndarray, most: int = PORTION) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of stretches of whole rows, about `most` bytes together; a longer row is cut behind words."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
        at, end = int(offsets[i]), int(offsets[j])
        while end - at > most and j == i + 1:
            look = at + most
            while look < end and INSIDE[data[look]]:  # a word never parts; one longer than a stretch makes it longer
                look += 1
            yield i, j, at, look
            at = look
        yield i, j, at, end
        i = j


class Words:
    """The words of data[begin:stop]: an id and a row each, and every different word's bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, begin: int, stop: int):
        own = data[begin:stop]
        held = INSIDE[own]
        edge = np.zeros(len(own) + 1, dtype=bool)
        edge[np.clip(offsets - begin, 0, len(own))] = True
        start = held.copy()
        start[1:] &= ~held[:-1] | edge[1:-1]
        start = np.flatnonzero(start)
        packed = own[held]
        at = np.append(np.cumsum(held)[start] - 1, len(packed)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False)
        self.row = np.searchsorted(offsets, start + begin, side="right") - 1
        self.spelt = words.dictionary.to_pylist()


def suffix_array(ids: np.ndarray, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by their next `depth` word ids inside a row, and each one's common words with the place before it."""
    n = len(ids)
    ahead = [ids]
    for k in range(1, depth):  # -1: the row ends
        later = np.full(n, -1, dtype=ids.dtype)
        if n > k:
            later[:-k] = np.where(row[k:] == row[:-k], ids[k:], -1)
        ahead.append(later)
    order = np.lexsort(ahead[::-1]) if depth > 1 else np.argsort(ids.astype(np.uint16) if n and ids.max() < 1 << 16 else ids, kind="stable")
    lcp = np.zeros(n, dtype=np.int32)
    alike = np.ones(max(n - 1, 0), dtype=bool)
    for own in ahead:
        own = own[order]
        alike &= (own[1:] == own[:-1]) & (own[1:] >= 0)
        lcp[1:] += alike
    return order, lcp


def occurrences(words: Words, depth: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 1..depth: k, the places where a run of k words begins, and the buckets of these."""
    ids, row = words.ids, words.row
    n = len(ids)
    order, lcp = suffix_array(ids, row, depth)
    for k in range(1, depth + 1):
        whole = np.zeros(n, dtype=bool)
        if n >= k:
            whole[: n - k + 1] = row[: n - k + 1] == row[k - 1 :]
        own = whole[order]
        head = own & (lcp < k)  # a place with k words that shares fewer with the one before it begins a run
        hashed = np.fromiter((zlib.crc32(b" ".join([words.spelt[i] for i in ids[a : a + k].tolist()])) % buckets for a in order[head].tolist()), dtype=np.int32)
        out = np.empty(n, dtype=np.int32)
        out[order[own]] = hashed[np.cumsum(head)[own] - 1]
        places = np.flatnonzero(whole)
        yield k, places, out[places]


def features(data: np.ndarray, offsets: np.ndarray, depth: int = GRAMS, buckets: int = BUCKETS, most: int = PORTION) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, rows, buckets) of all runs of k = 1..depth words of a batch of texts, stretch by stretch."""
    data = LOWER[data]
    for first, end, begin, stop in stretches(data, offsets, most):
        lead = begin
        if begin > offsets[first]:  # a cut row: begin as many words before the cut as its features need
            for _ in range(depth - 1):
                while lead > offsets[first] and not INSIDE[data[lead - 1]]:
                    lead -= 1
                while lead > offsets[first] and INSIDE[data[lead - 1]]:
                    lead -= 1
        words = Words(data, offsets[first : end + 1], lead, stop)
        old = len(Words(data, offsets[first : end + 1], lead, begin).ids) if lead < begin else 0
        for k, places, bucket in occurrences(words, depth, buckets):
            fresh = places + k > old  # the others were counted before the cut
            yield k, words.row[places[fresh]] + first, bucket[fresh]


def counts(texts: DataFrame, depth: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences in each bucket of all features of texts(text)."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, bucket in features(*buffers(batch.column(0)), depth, buckets):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in text_bytes(texts).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln of target share over source share), every bucket counted once more than it occurs."""
    t, s, b = target.astype(float), source.astype(float), len(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, depth: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs(doc_id, text)."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(counts(target, depth, buckets), counts(docs, depth, buckets)))  # `buckets` numbers

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            n = len(offsets) - 1
            words, found, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for k, row, bucket in features(data, offsets, depth, buckets):
                if len(row):
                    own = slice(row[0], row[-1] + 1)
                    many = np.bincount(row - row[0])
                    found[own] += many
                    words[own] += many if k == 1 else 0
                    weight[own] += np.bincount(row - row[0], weights=gain.value[bucket]).astype(np.int64)  # whole numbers far below 2^53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(found), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A whole number of a thousandth's scale, Gumbel distributed by the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """rows(score, doc_id, ...) with rank 1..k by falling score, then rising doc_id (null last), then the other columns; null from there on."""
    names = rows.columns
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), *(F.col(c) for c in names if c not in ("score", "doc_id"))]
    equal = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    parts = stored(equal.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    total, before = 0, [F.lit(0)]
    for r in parts.groupBy("part").agg(F.sum("times").alias("n")).orderBy("part").collect():  # one row a partition
        before.append(F.when(F.col("part") == r["part"], F.lit(total)))
        total += r["n"]
    start = F.coalesce(*before[1:], before[0]) + F.sum("times").over(Window.partitionBy("part").orderBy(*by)) - F.col("times")
    placed = parts.select(*names, "times", start.alias("start"))
    rank = F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("times")))
    return placed.select(*names, rank.alias("rank")).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, drawn: int = DRAWN, least: int = LEAST_WORDS, seed: int = SEED, depth: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of docs(doc_id, text), drawn towards target(text)."""
    rows = weigh(docs, target, depth, buckets)
    rows = stored(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    bin_ = (F.signum("score") * F.floor(F.log2(1 + F.abs("score")) * 32)).cast("int")  # rises with the score
    able = F.col("n_words") >= least
    bins = rows.where(able).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin")).collect()  # at most 4,096 rows
    k = drawn * sum(r["n"] for r in bins) // 100
    low, above = None, 0
    for r in bins:
        if above >= k:
            break
        low, above = r["bin"], above + r["n"]
    near = able & (bin_ >= low) if low is not None else F.lit(False)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = rows.where(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    return rest if low is None else ranked(rows.where(near).select(*columns), k).unionByName(rest)
