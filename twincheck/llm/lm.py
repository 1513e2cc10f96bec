"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each context of 0 to `DEPTH` preceding bytes has one Krichevsky-Trofimov
estimator per decision. A node's weighted probability is half its own estimate's and half the product of its
children's, so after training the share that its own estimate keeps is known, and a prediction mixes the
estimates of all depths along the context. Training counts every byte of every learning text.

Texts are dealt to chunks of bounded size by a hash. A chunk asks for what it contains: its distinct words and its
distinct (context, byte) strings, with their counts in learning texts. Counts are summed over all chunks. Strings with
the same three last context bytes form one subtree; whole subtrees are dealt to shards of about `SHARD` strings and
weighted there from the leaves up. What they say at depth 3 is summed to depth 2, to depth 1 and to the root by plain
aggregates, whose sizes the alphabet bounds (at most 256 * 255 nodes of depth 1 are collected); then the mixture goes
down again, by a join at depth 2 and within the shards below. The answers go back to the chunks that asked. So nothing
that grows with the corpus is broadcast or collected.

Texts are lower-cased (A-Z); each is preceded by `DEPTH` zero bytes and ended by one, whose code length counts.
Words are runs of other bytes than the contract's white space; one end token per text follows them.

A mixture over all depths up to `DEPTH` loses at most a few bits a context to the best of them, so a deeper tree is
only a matter of cost.

Defined results: null text counts as empty: its one token is the end. Repeated rows count and score each on its own.
Without learning texts every decision costs one bit and base_score is 0 = log10(1/1). An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, portions, remainder, stored, text_bytes, volume

DEPTH = 5
#: Depth whose contexts name a subtree, and strings of a shard of subtrees, about.
ROOTS, SHARD = 3, 400_000
#: Bytes of text of a chunk, about.
CHUNK_BYTES = 16 << 20
PORTION = 1 << 20


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every place of the texts, packed into 64 bits with the byte lowest, and the texts' bounds in them."""
    pad = b"\0" * DEPTH
    data = np.frombuffer(b"".join([pad + t + b"\0" for t in texts]), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    key = np.zeros(max(0, len(data) - DEPTH), dtype=np.int64)
    for i in range(DEPTH + 1):
        key <<= 8  # in place: these are the largest arrays of a task
        key |= data[i : len(data) - DEPTH + i]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.ones(len(key), dtype=bool)
    inner = (bounds[1:-1, None] + DEPTH * np.arange(len(texts) - 1)[:, None] + np.arange(DEPTH)[None, :]).ravel()
    keep[inner] = False  # windows that lie across two texts
    return key[keep], bounds


def lowered(table: pa.Table, most: int = PORTION):
    """Portions of a chunk's texts in lower case, and which of them teach: a task never holds all its texts a second time."""
    at = np.concatenate([[0], np.cumsum(pc.binary_length(table["text"]).to_numpy())])
    for i, j in portions(at, most):
        own = table.slice(i, j - i)
        yield [t.lower() for t in own["text"].to_pylist()], [not x for x in own["held_out"].to_pylist()]


def counted(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names, in order, and the sums of their counts."""
    names, counts = np.concatenate(names), np.concatenate(counts)
    order = np.argsort(names)
    names = names[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, dtype=np.int64)
    return names[first], np.add.reduceat(counts[order], first) if len(first) else first


def string_counts(parts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of portions of (texts, which of them teach), and how often they occur in learning texts."""
    names, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for texts, learn in parts:
        for teach in (True, False):
            key, _ = strings([t for t, ok in zip(texts, learn, strict=True) if ok is teach])
            key.sort()  # a plain sort, as strings carry nothing with them yet
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
            names.append(key[first])
            counts.append(np.diff(first, append=len(key)) * teach)
    return counted(names, counts)


def questions(table: pa.Table) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """A chunk's distinct words with their counts in learning texts, and its strings with theirs."""
    words: dict[bytes, int] = Counter()
    for texts, learn in lowered(table):
        for t, ok in zip(texts, learn, strict=True):
            own = t.split()
            if ok:
                words.update(own)
            else:
                for w in own:
                    words.setdefault(w, 0)
    return words, *string_counts(lowered(table, 4 * PORTION))


def answered(table: pa.Table, known: pa.Table, tokens: int, distinct: int, learning: int) -> tuple[list[int], list[int], list[float], np.ndarray]:
    """n_tokens, n_known, base_score and score of each text of a chunk, from its answers (word, gram, value).

    The answers are read batch by batch, and the words go before the strings come, so that a task holds one of the two tables."""
    local: dict[bytes, float] = Counter()
    for texts, learn in lowered(table):
        for t, ok in zip(texts, learn, strict=True):
            if ok:
                local.update(t.split())
    names, value = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for batch in known.select(["word", "gram", "value"]).to_batches():
        word = batch.filter(pc.is_valid(batch["word"]))
        dict.update(local, zip(word["word"].to_pylist(), word["value"].to_pylist(), strict=True))
        gram = batch.filter(pc.is_valid(batch["gram"]))
        names.append(gram["gram"].to_numpy())
        value.append(gram["value"].to_numpy())
    n, found, base = [], [], []
    log_all = np.log10(tokens + distinct + 1)
    for texts, _ in lowered(table):
        for t in texts:
            c = np.array([*map(local.get, t.split(), repeat(0)), learning], dtype=np.float64)
            n.append(len(c))
            found.append(int((c > 0).sum()))
            base.append(float(np.log10(c + 1).sum() - len(c) * log_all))
    del local
    names, value = np.concatenate(names), np.concatenate(value)
    order = np.argsort(names)
    names, value = names[order], value[order]
    score = [np.zeros(0)]
    for texts, _ in lowered(table):
        own, bounds = strings(texts)
        order = np.argsort(own)  # near keys lie near in the table
        found_at = np.empty(len(own))
        found_at[order] = value[np.searchsorted(names, own[order])]
        score.append(np.add.reduceat(found_at, bounds[:-1]))
    return n, found, base, np.concatenate(score)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series after eight steps of the recurrence."""
    y = x + 8
    steps = np.prod([x + i for i in range(8)], axis=0)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def cells_of(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of strings (context and byte): each decision's place among the visited nodes (8 rows), each node's decision and first string, and zeros and ones there.

    Decision i of a byte stands at node (1 << i) | (its first i bits), 1 to 255. In the order of the strings, a node is a run of
    equal contexts and first bits."""
    order = np.argsort(key)
    byte, n = key[order] & 255, n[order].astype(np.float64)
    context = np.concatenate([[True], np.diff(key[order] >> 8) != 0])
    at = np.empty((8, len(key)), dtype=np.int64)
    level, string, zeros, ones, size = [], [], [], [], 0
    for i in range(8):
        bits = byte >> (8 - i)
        new = context.copy()
        new[1:] |= bits[1:] != bits[:-1]
        first = np.flatnonzero(new)
        at[i, order] = np.cumsum(new) - 1 + size
        one = np.add.reduceat(n * ((byte >> (7 - i)) & 1), first)
        level.append(np.full(len(first), i))
        string.append(order[first])
        ones.append(one)
        zeros.append(np.add.reduceat(n, first) - one)
        size += len(first)
    return at, *(np.concatenate(x) for x in (level, string, zeros, ones))


def weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - np.log(2)


def kept_share(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def subtree(key: np.ndarray, n: np.ndarray):
    """The nodes of depths ROOTS to DEPTH of whole subtrees.

    Per depth: each decision's place among the visited nodes, zeros, ones, ln of own estimate, ln of the children's product (leaves: none).
    Then, for depth ROOTS, each node's context, its number, and the ln of its weighted probability."""
    levels, below = [], None
    for d in range(DEPTH, ROOTS - 1, -1):
        at, level, string, a, b = cells_of(key & ((1 << (8 * (d + 1))) - 1), n)
        own, children = estimated(a, b), None
        if below is not None:  # a node's parent is where its first string stands one depth higher
            children = np.bincount(at[below[0], below[1]], weights=below[2], minlength=len(a))
        value = np.where(a + b > 0, own if children is None else weighted(own, children), 0.0)
        levels.append((at, a, b, own, children))
        below = level, string, value
    byte = key[string] & 255
    return levels[::-1], (key[string] >> 8) & ((1 << (8 * ROOTS)) - 1), (1 << level) | (byte >> (8 - level)), value


def descend(mixed: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Add a depth to a prediction. mixed: probability of a one so far; left: weight still to be given. An unseen node gives all to 1/2."""
    seen = a + b > 0
    share = np.where(seen, 1.0 if children is None else kept_share(own, children), 1.0)
    kt = np.where(seen, (b + 0.5) / (a + b + 1), 0.5)
    return mixed + left * share * kt, left * (1 - share)


def top(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From the nodes of depth 1 (c, node, a, b, value): prediction and remaining weight after depth 1 at each (c, node)."""
    a, b, value, children = (np.zeros((256, 256)) for _ in range(4))
    c, node = rows["c"].to_numpy(), rows["node"].to_numpy()
    a[c, node], b[c, node], value[c, node], children[c, node] = rows["a"], rows["b"], rows["value"], rows["children"]
    a0, b0 = a.sum(axis=0), b.sum(axis=0)
    mixed, left = descend(np.zeros(256), np.ones(256), a0, b0, estimated(a0, b0), value.sum(axis=0))
    return descend(np.broadcast_to(mixed, (256, 256)), np.broadcast_to(left, (256, 256)), a, b, estimated(a, b), children)


def evaluate(key: np.ndarray, n: np.ndarray, spot: np.ndarray, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 probability of the byte of each string, given what lesser depths than ROOTS say at spot (context * 256 + node, sorted)."""
    levels, _, _, _ = subtree(key, n)
    byte, number = key & 255, (key >> 8) & ((1 << (8 * ROOTS)) - 1)
    # what a node adds to a prediction of weight 1, and the weight it leaves
    steps = [(at, *descend(np.zeros(len(a)), np.ones(len(a)), a, b, own, children)) for at, a, b, own, children in levels]
    out = np.zeros(len(key))
    for i in range(8):
        node, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
        first = np.searchsorted(spot, number * 256 + node)
        p, rest = mixed[first], left[first]
        for at, adds, leaves in steps:
            p, rest = p + rest * adds[at[i]], rest * leaves[at[i]]
        out += np.log10(np.clip(np.where(bit == 1, p, 1 - p), 1e-300, 1))
    return out


def _valued(nodes: DataFrame, name: str) -> DataFrame:
    """Adds value, the ln of the weighted probability, to nodes(name, node, a, b, children)."""

    def run(parts):
        for x in parts:
            a, b = x["a"].to_numpy(), x["b"].to_numpy()
            yield x.assign(value=np.where(a + b > 0, weighted(estimated(a, b), x["children"].to_numpy()), 0.0))

    return nodes.mapInPandas(run, f"{name} int, node int, a double, b double, children double, value double")


def string_scores(counts: DataFrame) -> DataFrame:
    """gram and value, the log10 probability, of each string of counts(gram, n), a stored table."""
    spark = counts.sparkSession
    shards = max(1, -(-counts.count() // SHARD))
    root = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * ROOTS)) - 1))
    placed = counts.withColumn("shard", F.pmod(F.xxhash64(root), F.lit(shards)))

    def lift(rows: pd.DataFrame) -> pd.DataFrame:
        levels, roots, nodes, value = subtree(rows["gram"].to_numpy(), rows["n"].to_numpy())
        _, a, b, _, _ = levels[0]
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "root": roots.astype(np.int32), "node": nodes.astype(np.int32), "a": a, "b": b, "value": value})

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        return lean(lift, rows)

    three = stored(placed.groupBy("shard").applyInPandas(up, "shard long, root int, node int, a double, b double, value double"))
    sums = F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("value").alias("children")
    pair = F.col("root").bitwiseAND(F.lit(0xFFFF)).alias("pair")
    two = stored(_valued(three.groupBy(pair, "node").agg(*sums), "pair"))  # 65536 * 255 rows at most
    head = _valued(two.groupBy(F.col("pair").bitwiseAND(F.lit(0xFF)).alias("c"), "node").agg(*sums), "c").where("a + b > 0").toPandas()  # 256 * 255 rows at most
    known = spark.sparkContext.broadcast(top(head))  # 2 * 256 * 256 numbers

    def second(parts):
        for x in parts:
            mixed, left = (m[x["pair"].to_numpy() & 255, x["node"].to_numpy()] for m in known.value)
            a, b = x["a"].to_numpy(), x["b"].to_numpy()
            mixed, left = descend(mixed, left, a, b, estimated(a, b), x["children"].to_numpy())
            yield pd.DataFrame({"pair": x["pair"], "node": x["node"], "mixed": mixed, "rest": left})

    said = two.mapInPandas(second, "pair int, node int, mixed double, rest double")
    given = three.select("shard", "root", pair, "node").join(said, ["pair", "node"]).select("shard", (F.col("root").cast("long") * 256 + F.col("node")).alias("spot"), "mixed", "rest")

    def lower(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        above = above.sort_values("spot")
        return pd.DataFrame({"gram": rows["gram"], "value": evaluate(rows["gram"].to_numpy(), rows["n"].to_numpy(), *(above[c].to_numpy() for c in ("spot", "mixed", "rest")))})

    def down(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return lean(lower, rows, above)

    return placed.groupBy("shard").cogroup(given.groupBy("shard")).applyInPandas(down, "gram long, value double")


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row. Rows whose remainder is `held` teach nothing."""
    rows = text_bytes(docs, "doc_id")
    n_rows, total = volume(rows)
    chunks = max(1, -(-(total + 64 * n_rows) // chunk_bytes))
    out = remainder(F.col("doc_id"), modulus) == held
    # rows are dealt by id, text and a draw, so that many equal rows do not meet in one chunk; stored, as a draw must not change
    deal = F.pmod(F.xxhash64("doc_id", "text", F.floor(F.rand(5) * 64)), F.lit(chunks))
    dealt = stored(rows.select("doc_id", "text", out.alias("held_out"), deal.alias("chunk")))
    learning = dealt.where("NOT held_out").count()

    def questioned(key, table):
        words, names, counts = questions(table)
        k, g = len(words), len(names)
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * (k + g), pa.int64()),
            "word": pa.array([*words, *[None] * g], pa.binary()),
            "gram": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(names)]),
            "n": pa.concat_arrays([pa.array(list(words.values()), pa.int64()), pa.array(counts)]),
        })

    def ask(key, table):
        return lean(questioned, key, table)

    asked = stored(dealt.groupBy("chunk").applyInArrow(ask, "chunk long, word binary, gram long, n long"))
    grams, words = asked.where("gram IS NOT NULL"), asked.where("word IS NOT NULL")
    counts = stored(grams.groupBy("gram").agg(F.sum("n").alias("n")))
    of_words = words.select("chunk", "word", "n").withColumn("c", F.sum("n").over(Window.partitionBy("word")))
    # words of one chunk only are known there
    of_words = stored(of_words.select("chunk", "word", "n", "c").where("c > n"))
    whole = words.where("n > 0").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    several = of_words.where("n > 0").agg(F.countDistinct("word").alias("v"), F.count(F.lit(1)).alias("n")).first()
    tokens = (whole["n"] or 0) + learning
    distinct = several["v"] + whole["v"] - several["n"] + (1 if learning else 0)
    answers = stored(
        of_words.select("chunk", "word", F.lit(None).cast("long").alias("gram"), F.col("c").cast("double").alias("value"))
        .unionByName(grams.join(string_scores(counts), "gram").select("chunk", F.lit(None).cast("binary").alias("word"), "gram", "value"))
    )
    discard(asked, counts, of_words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(table, known):
        n, found, base, score = answered(table, known, tokens, distinct, learning)
        size = len(n)
        bits = -score / np.log10(2) / (pc.binary_length(table["text"]).to_numpy() + 1.0)
        return pa.table({
            "doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(found, pa.int64()),
            "train_tokens": pa.array([tokens] * size, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score), "bits_per_byte": pa.array(bits),
        })

    def tell(key, table, known):
        return lean(scored, table, known)

    shape = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tell, shape)
