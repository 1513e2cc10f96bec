"""Near-duplicates by min-max hashing.

Every permutation of a shingle set gives two signature values, its minimum and its maximum, so
`PERMUTATIONS` hash functions yield twice as many values. Bands of `BAND_ROWS` values, no two of one
permutation, bring candidates together. Copies of one shingle set are a single node from the start.

No bucket is expanded into pairs. First every bucket offers the pairs of its first node with the others;
they are confirmed on the full shingle sets and the links are contracted. Most buckets are then one
component and done. Of the others, those with at most `FEW` pairs across components offer these. What is left
are crowds of texts close to the threshold: connected buckets make a crowd, whose nodes are cut into blocks of
`BLOCK`; each node outside the crowd's largest component is counted against all nodes, block against block,
inside tasks that only return links. No pair that could link is dropped.

At similarity 0.8 a pair misses all bands with probability (1 - 0.8^4)^24 < 4e-6.

Copies are told by a digest of the shingles' own bytes; hashes only sort them.

Defined results: a null or blank text has an empty set and no links; a text of fewer words than a shingle
is one shingle of all its words. doc_id is an integer. Rows with the same doc_id and text are copies of each other;
with the same doc_id and other texts they are documents of their own, with a row each. A row without an id takes
part; a component of such rows only has a null component_id, and these rows count as kept. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, buffers, discard, mix, portions, stored, text_bytes, word_bounds, word_hashes

PERMUTATIONS = 48
BAND_ROWS = 4
#: Pairs across components that an open bucket may offer at once.
FEW = 64
#: Nodes of a block of a crowd.
BLOCK = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """64-bit hashes of each row's distinct k-word shingles, sorted by row, the rows' bounds in them, and words (start, end, first words of the shingles)."""
    data = _LOWER[data]
    start, end = word_bounds(data, offsets, ~IS_SPACE)
    words = word_hashes(data, start, end)
    at = np.searchsorted(start, offsets)
    n = np.diff(at)
    long = np.minimum(n, k)  # words of each row's shingles
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    bounds = np.concatenate([[0], np.cumsum(count)])
    first = at[row] + (np.arange(len(row)) - bounds[row])
    h = np.zeros(len(row), dtype=np.uint64)
    for i in range(k):
        own = long[row] > i
        h[own] = mix(h[own] * np.uint64(0x9E3779B97F4A7C15) + words[first[own] + i] + np.uint64(i + 1))
    if not len(h):
        return h, bounds, (start, end, first)
    order = np.lexsort((h, row))
    h, row, first = h[order], row[order], first[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))]), (start, end, first[new])


def set_keys(data: np.ndarray, offsets: np.ndarray, k: int, bounds: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes | None]:
    """A digest of each row's shingles as bytes, words ended by a space, in the order of their hashes; None without a shingle."""
    start, end, first = words
    rows = np.searchsorted(offsets, start[first], side="right") - 1
    last = np.searchsorted(start, offsets[1:])[rows] if len(first) else first  # the word after the row's last
    size = np.minimum(k, last - first)
    word = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = end[word] - start[word] + 1
    stop = np.cumsum(wide)
    spelled = np.append(_LOWER[data], np.uint8(32))[np.repeat(start[word] - (stop - wide), wide) + np.arange(wide.sum())]
    spelled[stop - 1] = 32
    at = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(size)])[bounds]]
    whole = memoryview(spelled.tobytes())
    return [hashlib.blake2b(whole[s:e], digest_size=16).digest() if e > s else None for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def signature(h: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minima, then maxima, of a set under each permutation."""
    low, high = np.empty(permutations, dtype=np.uint64), np.empty(permutations, dtype=np.uint64)
    for at in range(0, permutations, 8):
        x = _A[at : at + 8, None] * h[None, :] + _B[at : at + 8, None]
        x ^= x >> np.uint64(31)
        low[at : at + 8], high[at : at + 8] = x.min(axis=1), x.max(axis=1)
    return np.concatenate([low, high])


def bands(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One hash per band; band j takes neighbouring values of the minima or of the maxima."""
    grouped = sig.reshape(-1, rows)
    out = np.arange(len(grouped), dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, i])
    return out.view(np.int64)


def word_sets(text: bytes, k: int) -> set:
    words = text.lower().split()  # of bytes: A-Z only, and the contract's white space
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def alike(a: bytes, b: bytes, k: int, percent: int) -> bool:
    """100 * intersection >= percent * union, on the words themselves."""
    x, y = word_sets(a, k), word_sets(b, k)
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, u (hash of the text), n_shingles, set_key (digest of the set; null: empty) and bands of every row of docs(id, u, text)."""

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(2))
            n, key, band = [], [], []
            for i, j in portions(at, 1 << 18):
                part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                h, bounds, words = shingles(part, own, k)
                n += np.diff(bounds).tolist()
                key += set_keys(part, own, k, bounds, words)
                band += [bands(signature(h[s:e])) if e > s else None for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64()))], names=["id", "u", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, "id long, u long, n_shingles long, set_key binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets are alike. texts(id, text) holds both."""

    def run(batches):
        for batch in (b.slice(at, 128) for b in batches for at in range(0, len(b), 128)):
            ok = [alike(x, y, k, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    own = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = own.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def contracted(label: DataFrame, links: DataFrame) -> DataFrame:
    """label(id, comp) after uniting the components of links(a, b): smallest labels travel along the links until none changes.

    Every round also replaces a component's target by that target's own, so chains halve."""
    side = links.join(label.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(label.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
    edges = stored(side.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
    if edges.isEmpty():
        return label
    spot = stored(edges.select(F.explode(F.array("lo", "hi")).alias("c")).distinct().select("c", F.col("c").alias("to")))
    while True:
        seen = edges.join(spot.select(F.col("c").alias("lo"), F.col("to").alias("p")), "lo").join(spot.select(F.col("c").alias("hi"), F.col("to").alias("q")), "hi").where("p <> q")
        # of two linked components, and of what they point to, the larger goes to the smaller
        offer = seen.select(F.explode(F.array(*(F.struct(F.col(c).alias("c"), F.least("p", "q").alias("m")) for c in ("lo", "hi")), F.struct(F.greatest("p", "q").alias("c"), F.least("p", "q").alias("m")))).alias("o")).select("o.*")
        best = offer.groupBy("c").agg(F.min("m").alias("m"))
        moved = spot.join(best, "c", "left").select("c", F.least("to", "m").alias("to"))
        jump = moved.select(F.col("c").alias("to"), F.col("to").alias("next"))
        new = stored(moved.join(jump, "to", "left").select("c", F.coalesce("next", "to").alias("to")))
        changed = new.join(spot.select("c", F.col("to").alias("was")), "c").where("to <> was").isEmpty()
        spot = new
        if changed:
            break
    return stored(label.join(spot.select(F.col("c").alias("comp"), "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))


def block_links(own: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """Links of the nodes asked for (role 0) with those of the block (role 1): one per node and component that it reaches."""
    asks, held = own[own["role"] == 0], own[own["role"] == 1]
    if asks.empty or held.empty:
        return pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
    texts = [bytes(t) for t in held["text"]]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h, bounds, _ = shingles(np.frombuffer(b"".join(texts), dtype=np.uint8), at, k)
    names, place = np.unique(h, return_inverse=True)
    size, comp, ids = np.diff(bounds), held["comp"].to_numpy(), held["id"].to_numpy()
    a, b = [], []
    for i, c, text in zip(asks["id"], asks["comp"], map(bytes, asks["text"]), strict=True):
        own_h = shingles(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), k)[0]
        spot = np.minimum(np.searchsorted(names, own_h), max(0, len(names) - 1))
        mark = np.zeros(len(names), dtype=np.int64)
        mark[spot[names[spot] == own_h]] = 1
        both = np.add.reduceat(mark[place], bounds[:-1])
        hits = np.flatnonzero((100 * both >= percent * (size + len(own_h) - both)) & (comp != c))
        reached: set[int] = set()
        for j in hits.tolist():
            if comp[j] not in reached and alike(text, texts[j], k, percent):
                reached.add(comp[j])
                a.append(i)
                b.append(ids[j])
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def crowd_links(buckets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links across components among buckets(band, id, comp, hub), counted block against block."""
    nodes = buckets.select("id", "comp").distinct()
    crowd = contracted(nodes.select("id", F.col("id").alias("comp")), stored(buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()))
    placed = stored(nodes.join(crowd.withColumnRenamed("comp", "crowd"), "id"))
    parts = placed.groupBy("crowd", "comp").agg(F.count(F.lit(1)).alias("n"))
    shape = parts.groupBy("crowd").agg(F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("main")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    full = placed.join(shape, "crowd").join(texts, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cell = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ask = full.where("comp <> main").select("crowd", F.col("block").alias("i"), cell.alias("j"), "id", "comp", "text", F.lit(0).alias("role"))
    held = full.select("crowd", cell.alias("i"), F.col("block").alias("j"), "id", "comp", "text", F.lit(1).alias("role"))
    return ask.unionByName(held).groupBy("crowd", "i", "j").applyInPandas(lambda own: block_links(own, k, percent), "a long, b long")


def _named(docs: DataFrame) -> DataFrame:
    """id, u and text of every row, as bytes (null: empty)."""
    texts = text_bytes(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id")
    return texts.select("id", F.xxhash64("text").alias("u"), "text")


def near_classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and set_key, component_id (smallest id; null: none has one) and chief (set_key of the document that stays) of every set."""
    texts = _named(docs)
    rows = stored(sketches(texts, k))
    # copies of a set are one node, named by a number of its own, with the text of its smallest id
    order = F.struct(F.col("id").isNull().alias("none"), "id", "u")
    nodes = stored(rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(order).alias("m"), F.first("bands").alias("bands")).select("set_key", F.col("m.id").alias("doc"), F.col("m.u").alias("u"), "bands", F.monotonically_increasing_id().alias("id")))
    near = nodes.select("id", F.explode("bands").alias("band"))
    wide = near.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    buckets = stored(near.join(wide, "band"))
    label = nodes.select("id", F.col("id").alias("comp"))
    if not buckets.isEmpty():
        asked = nodes.join(buckets.select("id").distinct(), "id", "left_semi").select(F.coalesce("doc", F.lit(-1)).alias("doc"), "u", F.col("id").alias("node"))
        shown = texts.select(F.coalesce("id", F.lit(-1)).alias("doc"), "u", "text")
        own = stored(shown.join(asked, ["doc", "u"]).groupBy(F.col("node").alias("id")).agg(F.min("text").alias("text")))
        hubs = stored(buckets.join(buckets.groupBy("band").agg(F.min("id").alias("hub")), "band"))
        star = hubs.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        label = contracted(label, stored(confirmed(star, own, k, percent)))
        placed = hubs.join(label, "id")
        state = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
        open_ = state.groupBy("band").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")).where("pairs > 0")
        rest = stored(placed.join(open_, "band"))
        few = rest.where(F.col("pairs") <= FEW)
        one, two = few.select("band", F.col("id").alias("a"), F.col("comp").alias("ca")), few.select("band", F.col("id").alias("b"), F.col("comp").alias("cb"))
        offer = one.join(two, "band").where("a < b AND ca <> cb").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
        links = stored(confirmed(offer, own, k, percent).unionByName(crowd_links(rest.where(F.col("pairs") > FEW), own, k, percent)))
        label = contracted(label, links)
        discard(buckets, own, hubs, rest, links)
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "u", "set_key"))
    heads = nodes.join(label, "id").groupBy("comp").agg(first.alias("m")).select("comp", F.col("m.doc").alias("component_id"), F.col("m.set_key").alias("chief"))
    return rows, nodes.join(label, "id").join(heads, "comp").select("set_key", "component_id", "chief")


def near_groups(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, classes = near_classes(docs, k, percent)
    found = rows.select("id", "n_shingles", "set_key").join(classes.select("set_key", F.struct("component_id").alias("c")), "set_key", "left")
    component = F.when(F.col("c").isNotNull(), F.col("c.component_id")).otherwise(F.col("id"))
    out = found.select(F.col("id").cast(kind).alias("doc_id"), "n_shingles", component.cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id (rows without an id come last), and texts without words.

    Rows that equal it in doc_id and text are that document and stay with it."""
    rows, classes = near_classes(docs, k, percent)
    own = rows.where("set_key IS NOT NULL").select("id", "u", "set_key").distinct().join(classes, "set_key")
    best = own.where("set_key = chief").groupBy("chief").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "u")).alias("m"))
    gone = own.join(best, "chief").where(~(F.col("id").eqNullSafe(F.col("m.id")) & (F.col("u") == F.col("m.u")))).select("id", "u")
    names = docs.columns
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("i"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("u"))
    left = keyed.join(gone.select(F.coalesce("id", F.lit(-1)).alias("i"), F.col("id").isNull().alias("none"), "u").distinct(), ["i", "none", "u"], "left_anti")
    return left.select(*(F.col(f"row.`{c}`").alias(c) for c in names))
