"""Packing by lexical retrieval.

Terms are token ids; document frequencies, mean length and row count are taken once over all documents. The
documents' BM25 weights are projected to the widest directions of a bounded sample, and a tree of hyperplanes,
each between two means of its part of another bounded sample, gives leaves of documents of like content. Every
document's leaf is counted, and neighbouring leaves join to shards of bounded size; only a leaf larger than a
shard is split by a hash. A shard builds a BM25 inverted index with the weights of the whole corpus. A seed,
the remainder of the document that was cut last or else the first unused document, asks the index for its
unused neighbours, all that share a term with it; they fill the window in order of score, and an unrelated
document follows only when none is left. The last one is cut where the window ends, and its rest seeds the next
window. So only the last sequence of a shard can need padding. Neighbours beyond the shard are not found; the
README states the measured recall.

Token ids come from the given tokenizer's file, followed by the end id. White space separates words for the
tokenizer, so each distinct word is encoded once per task and looked up afterwards.

Defined results: null text counts as empty and packs as the end id alone. Repeated rows are packed each on
its own. Null ids are packed like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, buffers, discard, lean, portions, prefix_hash, range_hash, stored, text_bytes, word_hashes

WINDOW = 4096
END = 2
#: An added token of the tokenizer. Texts that hold its first two characters are encoded whole.
MARK = "<|endoftext|>"
#: 1: ASCII letters and digits, 2: ASCII signs but the apostrophe. No token of the tokenizer holds both.
KIND = np.array([1 if chr(i).isalnum() else 2 for i in range(128)] + [0] * 128, dtype=np.uint8)
KIND[[*range(33), ord("'"), 127]] = 0
#: Bytes of text of a shard, about.
SHARD_BYTES = 4 << 20
K1, B = 1.2, 0.75
#: Directions of the projection, documents that fit it, leaves of the tree per shard, and documents per leaf that fit the tree.
WIDTH, ROWS, LEAVES, FIT = 24, 4096, 4, 8
#: Terms in this share of a shard's documents, or more, are rows of a matrix.
COMMON = 8
#: A task forgets its words but the first KEPT when it would hold more than MEMORY, and when it ends. A word takes about 50 bytes.
MEMORY, KEPT = 1_000_000, 500_000


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of the rows, cut between an ASCII letter or digit and a sign beside it: the tokenizer cuts there too, so fewer words differ."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    held, kind = ~IS_SPACE[data], KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] + kind[:-1] == 3
    start, end = held.copy(), held.copy()
    start[1:] &= ~held[:-1] | edge[1:-1]
    end[:-1] &= ~held[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Table:
    """Numbers of words by two 64-bit hashes, by open addressing; a word's ids lie in one array at its number."""

    def __init__(self):
        self.grow(1 << 16)
        self.ids, self.at, self.n = np.zeros(1 << 18, dtype="<u4"), np.zeros(1, dtype=np.int64), 0
        self.names = np.zeros((0, 2), dtype=np.uint64)

    def grow(self, size: int) -> None:
        self.mask = np.uint64(size - 1)
        self.slot = np.full(size, -1, dtype=np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out = np.full(len(a), -1, dtype=np.int64)
        live, place = np.arange(len(a)), a & self.mask
        while len(live):
            k = self.slot[place]
            used = k >= 0
            live, k, place = live[used], k[used], place[used]
            hit = (self.names[k, 0] == a[live]) & (self.names[k, 1] == b[live])
            out[live[hit]] = k[hit]
            live, place = live[~hit], (place[~hit] + np.uint64(1)) & self.mask
        return out

    def place(self, numbers: np.ndarray) -> None:
        at = self.names[numbers, 0] & self.mask
        while len(numbers):
            free = self.slot[at] < 0
            self.slot[at[free]] = numbers[free]
            left = self.slot[at] != numbers
            numbers, at = numbers[left], (at[left] + np.uint64(1)) & self.mask

    def add(self, a: np.ndarray, b: np.ndarray, ids: list[bytes]) -> None:
        """New words, each once."""
        own = np.frombuffer(b"".join(ids), dtype="<u4")
        end = self.at[-1] + np.cumsum([len(x) // 4 for x in ids])
        if end[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.at[-1]], np.zeros(2 * int(end[-1]) - int(self.at[-1]), dtype="<u4")])
        self.ids[self.at[-1] : end[-1]] = own
        self.at, self.names = np.concatenate([self.at, end]), np.concatenate([self.names, np.stack([a, b], axis=1)])
        first, self.n = self.n, self.n + len(a)
        if 2 * self.n > len(self.slot):
            self.grow(1 << int(4 * self.n - 1).bit_length())
            first = 0
        self.place(np.arange(first, self.n, dtype=np.int32))

    def keep(self, n: int) -> None:
        """Only the first n words."""
        self.n = min(n, self.n)
        self.at, self.names = self.at[: self.n + 1].copy(), self.names[: self.n].copy()
        self.ids = self.ids[: self.at[-1]].copy()
        self.grow(1 << max(16, int(4 * self.n).bit_length()))
        self.place(np.arange(self.n, dtype=np.int32))


class Words:
    """Token ids of white-space-separated words, each as little-endian 32-bit numbers, remembered."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.held = Table()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; one that may hold an added token is encoded whole."""
        whole = [k for k, t in enumerate(texts) if b"<|" in t]
        out = self._by_words([b"" if b"<|" in t else t for t in texts])
        for k, x in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = np.array(x, dtype="<u4").tobytes()
        return out

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Lower-casing A-Z and cutting at ASCII white space change nothing for the tokenizer, which does both."""
        out = []
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        for i, j in portions(offsets, 1 << 19):
            out += self._portion(b"".join(texts[i:j]).lower(), offsets[i : j + 1] - offsets[i])
        return out

    def _portion(self, whole: bytes, offsets: np.ndarray) -> list[bytes]:
        data = np.frombuffer(whole, dtype=np.uint8)
        start, end = cut(data, offsets)
        a = word_hashes(data, start, end)
        h = prefix_hash(data)
        b = range_hash(h, start, end)  # two hashes of different kinds: 128 bits tell words apart
        held = self.held
        number = held.find(a, b)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            _, first = np.unique(a[miss], return_index=True)
            new = miss[np.sort(first)]
            if held.n + len(new) > MEMORY:
                self.forget()
                number = held.find(a, b)
                miss = np.flatnonzero(number < 0)
                new = miss[np.sort(np.unique(a[miss], return_index=True)[1])]
            held.add(a[new], b[new], self._encoded([whole[s:e] for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)]))
            number[miss] = held.find(a[miss], b[miss])
        begin = held.at[number]
        size = held.at[number + 1] - begin
        after = np.cumsum(size)
        ids = held.ids[np.repeat(begin - after + size, size) + np.arange(after[-1] if len(after) else 0)].tobytes()
        ends = (4 * np.concatenate([[0], after])[np.searchsorted(start, offsets)]).tolist()
        return [ids[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        found: dict[bytes, bytes] = {}
        letters, others = [], []
        for w in words:
            (letters if w.decode().isalpha() else others).append(w)
        for at in range(0, len(letters), 100):
            found.update(self._letters(letters[at : at + 100]))
        for at in range(0, len(others), 100):
            found.update(self._each(others[at : at + 100]))
        return [found[w] for w in words]

    def forget(self) -> None:
        """Keep the words met first, which are mostly the frequent ones."""
        self.held.keep(KEPT)

    def _letters(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of words of letters, joined by spaces: one token with a word's end each, or else they go the other way."""
        ids = np.array(self._ids([b" ".join(words)])[0], dtype="<u4")
        last = self.last[ids]
        return self._parted(words, ids, np.flatnonzero(last) + 1, 0) if last.sum() == len(words) else self._each(words)

    def _each(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of each word. An added token between them keeps words apart, so that one call does for many."""
        if self.mark is None:
            return zip(words, (np.array(x, dtype="<u4").tobytes() for x in self._ids(words)), strict=True)
        ids = np.array(self._ids([MARK.encode().join(words)])[0], dtype="<u4")
        return self._parted(words, ids, np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    @staticmethod
    def _parted(words: list[bytes], ids: np.ndarray, end: np.ndarray, between: int) -> Iterator[tuple[bytes, bytes]]:
        data, end = ids.tobytes(), (4 * end).tolist()
        return zip(words, (data[i:j] for i, j in zip([0, *(e + 4 * between for e in end[:-1])], end, strict=True)), strict=True)


_held: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _held:
        _held[path] = Words(path)
    return _held[path]


def counts(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and how often, for each pair that occurs, in order."""
    key = (np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets)) << 32) | tokens.astype(np.int64)
    key, tf = np.unique(key, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf


def kept(path: str) -> str:
    """Type of stored token ids: two bytes if the tokenizer's ids fit."""
    return "<u2" if lean(lambda: Words(path).tokenizer.get_vocab_size()) <= 1 << 16 else "<u4"  # the driver keeps no tokenizer


class Corpus:
    """Inverse document frequency of each term and the mean length, over all documents."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.idf, self.mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), max(1.0, tokens / max(1, n))

    def weights(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        norm = K1 * (1 - B + B * sizes / self.mean)
        return self.idf[term] * tf * (K1 + 1) / (tf + norm[doc])

    def rows(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, term, tf = counts(tokens, offsets)
        return doc, term, self.weights(doc, term, tf, np.diff(offsets)).astype(np.float32)

    def directions(self, tokens: np.ndarray, offsets: np.ndarray, rounds: int = 4) -> np.ndarray:
        """Terms x WIDTH: the leading singular vectors of the documents' unit rows, by subspace iteration."""
        doc, term, weight = self.rows(tokens, offsets)
        n, v = len(offsets) - 1, len(self.idf)
        weight = weight / np.sqrt(np.maximum(np.bincount(doc, weights=weight * weight, minlength=n), 1e-9))[doc]
        q = np.random.default_rng(0).standard_normal((v, WIDTH))
        for _ in range(rounds):
            y = np.stack([np.bincount(doc, weights=weight * q[term, k], minlength=n) for k in range(WIDTH)], axis=1)
            y = np.linalg.qr(y)[0]
            q = np.stack([np.bincount(term, weights=weight * y[doc, k], minlength=v) for k in range(y.shape[1])], axis=1)
            q = np.pad(q, ((0, 0), (0, WIDTH - q.shape[1])))
        return (q / np.maximum(np.linalg.norm(q, axis=0), 1e-9)).astype(np.float32)

    def vectors(self, tokens: np.ndarray, offsets: np.ndarray, project: np.ndarray) -> np.ndarray:
        """Unit projections of the documents' weights; zero without a term."""
        doc, term, weight = self.rows(tokens, offsets)
        out = np.zeros((len(offsets) - 1, WIDTH), dtype=np.float32)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        if len(first):
            out[doc[first]] = np.add.reduceat(project[term] * weight[:, None], first, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def plane(x: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.float32]:
    """Normal and offset between two means, from halves of the widest direction; the halves if the means leave a side below a tenth."""
    mid = x - x.mean(axis=0)
    first = np.linalg.eigh((mid.T @ mid).astype(np.float64))[1][:, -1].astype(np.float32)
    at = x @ first
    middle = np.median(at)
    if not (at < middle).any():
        middle = at[at > middle].min(initial=np.inf)
    axis, cut, right = first, middle, at >= middle
    for _ in range(rounds):
        if min(right.sum(), (~right).sum()) < 0.1 * len(x):
            return first, middle
        a, b = x[~right].mean(axis=0), x[right].mean(axis=0)
        axis, cut = b - a, (b - a) @ (b + a) / 2
        now = x @ axis >= cut
        if (now == right).all():
            break
        right = now
    return axis, cut


class Tree:
    """Cuts of the projected documents into about `leaves` parts of like content and size, numbered from left to right."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, leaves: int):
        self.axis, self.cut, self.child, self.leaves = [], [], [], 0
        self._grow(vectors, sizes, sizes.sum() / leaves)
        self.axis, self.cut, self.child = np.array(self.axis, dtype=np.float32).reshape(-1, WIDTH), np.array(self.cut, dtype=np.float32), np.array(self.child, dtype=np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, sizes: np.ndarray, most: float) -> int:
        """Number of the inner node, or -1 - number of the leaf."""
        if sizes.sum() > most and (x != x[:1]).any():
            axis, cut = plane(x)
            right = x @ axis >= cut
            if right.any() and not right.all():
                me = len(self.axis)
                self.axis.append(axis)
                self.cut.append(cut)
                self.child.append(None)
                self.child[me] = (self._grow(x[~right], sizes[~right], most), self._grow(x[right], sizes[right], most))
                return me
        self.leaves += 1
        return -self.leaves

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), 0 if len(self.axis) else -1, dtype=np.int64)
        while (at >= 0).any():
            own = np.flatnonzero(at >= 0)
            node = at[own]
            at[own] = self.child[node, (np.einsum("ij,ij->i", vectors[own], self.axis[node]) >= self.cut[node]).astype(np.int64)]
        return -1 - at


def shards_of(leaves: list[tuple[int, int]], shard_bytes: int) -> list[tuple[int, int, int]]:
    """(leaf, first shard, shards) from (leaf, bytes) in order: neighbouring leaves share a shard while they fit."""
    out, last, room = [], -1, 0
    for leaf, size in leaves:
        parts = max(1, -(-size // shard_bytes))
        if size > room:
            first, last, room = last + 1, last + parts, shard_bytes if parts == 1 else 0
        else:
            first = last
        room -= size if parts == 1 else 0
        out.append((leaf, first, parts))
    return out


class Index:
    """BM25 postings over documents given as arrays of token ids, the end id last; with the weights of the corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        sizes = np.array([len(d) - 1 for d in docs], dtype=np.int64)
        doc, term, tf = counts(np.concatenate([d[:-1] for d in docs]), np.concatenate([[0], np.cumsum(sizes)]))
        weight = corpus.weights(doc, term, tf, sizes)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.first = doc[order].astype(np.int32), weight[order].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(corpus.idf)))])
        self.query, self.query_at = term.astype(np.int32), np.searchsorted(doc, np.arange(len(docs) + 1))
        self.n = len(docs)
        # terms of many documents as rows of a matrix, at most COMMON times the postings: adding rows is faster than following postings
        df = np.diff(self.first)
        often = np.flatnonzero(df * COMMON >= max(1, self.n))
        self.row, self.dense = np.full(len(df), -1, dtype=np.int32), np.zeros((len(often), self.n), dtype=np.float32)
        self.row[often] = np.arange(len(often))
        own = self.row[term]
        self.dense[own[own >= 0], doc[own >= 0]] = weight[own >= 0]

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with the seed, the best first, the smaller number first of equals."""
        terms = self.query[self.query_at[seed] : self.query_at[seed + 1]]
        if not len(terms):
            return
        row = self.row[terms]
        score, terms = self.dense[row[row >= 0]].sum(axis=0, dtype=np.float64), terms[row < 0]
        begin, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        score += np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)
        top = np.flatnonzero(score > 0)
        top = top[~used[top] & (top != seed)]
        score, take = -score[top], 32
        while len(top):  # most windows need few: order the best, and the rest only if they run out
            if take < len(top):
                near = score <= np.partition(score, take)[take]
            else:
                near = np.ones(len(top), dtype=bool)
            best = top[near]
            yield from best[np.argsort(score[near], kind="stable")].tolist()
            top, score, take = top[~near], score[~near], take * 8


def fill(docs: list[np.ndarray], corpus: Corpus, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset)."""
    index, used, out = Index(docs, corpus), np.zeros(len(docs), dtype=bool), []
    sequence, room, waiting, nxt, rest, seed = 0, window, iter(()), 0, None, -1
    while True:
        if rest is not None:
            (d, start), rest = rest, None
            if room == window and d != seed:  # a new window: the rest of the last document seeds it
                seed, waiting = d, index.neighbours(d, used)
        else:
            d, start = next((x for x in waiting if not used[x]), -1), 0
            if d < 0:
                while nxt < len(docs) and used[nxt]:
                    nxt += 1
                if nxt == len(docs):
                    return out
                d = seed = nxt
                waiting = index.neighbours(d, used)
            used[d] = True
        take = min(room, len(docs[d]) - start)
        out.append((d, start, take, sequence, window - room))
        room -= take
        if start + take < len(docs[d]):
            rest = (d, start + take)
        if not room:
            sequence, room = sequence + 1, window
            if rest is None:
                waiting = iter(())


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (without the end id) and size, which is the text's bytes and 16 more."""
    kind = kept(tokenizer)

    def run(batches):
        encoder = words_of(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                text = part.column(1).to_pylist()
                ids = [np.frombuffer(x, dtype="<u4").astype(kind).tobytes() for x in encoder.encode(text)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(t) + 16 for t in text], pa.int64())], names=["doc_id", "ids", "size"])
        encoder.forget()  # workers live on, and other stages need the memory

    return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, size long")


def flat(column: pa.Array, kind: str):
    """Token ids and offsets of portions of a batch's documents."""
    data, at = buffers(column)
    wide = int(kind[-1])
    for i, j in portions(at, 1 << 21):
        yield i, j, np.frombuffer(data[at[i] : at[j]].tobytes(), dtype=kind), (at[i : j + 1] - at[i]) // wide


def measured(tokens: DataFrame, kind: str) -> Corpus:
    """One aggregate over all documents; a row for each term comes to the driver, as many as the tokenizer knows."""

    def run(batches):
        n, length, df = 0, 0, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for i, j, ids, at in flat(batch.column(0), kind):
                own = np.bincount(counts(ids, at)[1], minlength=len(df))
                own[: len(df)] += df
                n, length, df = n + j - i, length + len(ids), own
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], [n, length]))], names=["term", "n"])

    rows = tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    held = dict(zip(rows["term"].tolist(), rows["n"].tolist(), strict=True))
    n, length = held.pop(-1, 0), held.pop(-2, 0)
    df = np.zeros(1 + max(held, default=0), dtype=np.int64)
    df[list(held.keys())] = list(held.values())
    return Corpus(n, length, df)


def placed(tokens: DataFrame, corpus, shard_bytes: int, held: str) -> DataFrame:
    """Adds the shard: documents of like content share one. tokens is a stored table and goes when it is dealt."""
    n, total = tokens.agg(F.count(F.lit(1)), F.sum("size")).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    if shards == 1:
        return tokens.withColumn("shard", F.lit(0).cast("long"))
    key = F.xxhash64("doc_id", "ids")

    def some(rows: int) -> DataFrame:
        return tokens.where(F.pmod(key, F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))).groupBy(key.alias("key")).agg(F.min("ids").alias("ids"), F.sum("size").alias("size"))

    fit = [bytes(r["ids"]) for r in sorted(some(ROWS).collect(), key=lambda r: r["key"])]  # about ROWS rows
    directions = lean(corpus.value.directions, np.frombuffer(b"".join(fit), dtype=held), np.concatenate([[0], np.cumsum([len(x) // int(held[-1]) for x in fit], dtype=np.int64)]))
    project = tokens.sparkSession.sparkContext.broadcast(directions)

    def vectors(column):
        return np.concatenate([corpus.value.vectors(ids, at, project.value) for _, _, ids, at in flat(column, held)] or [np.zeros((0, WIDTH), dtype=np.float32)])

    def show(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in vectors(batch.column(1))], pa.binary()), batch.column(2)], names=["key", "v", "size"])

    fit = some(shards * LEAVES * FIT).mapInArrow(show, "key long, v binary, size long").toPandas().sort_values("key")
    tree = tokens.sparkSession.sparkContext.broadcast(lean(Tree, np.frombuffer(b"".join(map(bytes, fit["v"])), dtype=np.float32).reshape(-1, WIDTH), fit["size"].to_numpy(), shards * LEAVES))

    def walk(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.leaf(vectors(batch.column(1))))], names=["doc_id", "ids", "size", "leaf"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    # the draw is fixed by the write and parts repeated rows, which share their leaf
    out = stored(tokens.select("doc_id", "ids", "size").mapInArrow(walk, f"doc_id {kind}, ids binary, size long, leaf long").withColumn("draw", F.xxhash64(F.monotonically_increasing_id())))
    discard(tokens)
    sizes = sorted((r["leaf"], r["size"]) for r in out.groupBy("leaf").agg(F.sum("size").alias("size")).collect())  # LEAVES rows a shard
    deal = tokens.sparkSession.createDataFrame(shards_of(sizes, shard_bytes), "leaf long, first long, parts long")
    return out.join(F.broadcast(deal), "leaf").withColumn("shard", F.col("first") + F.pmod("draw", "parts"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    texts, held = stored(encoded(docs, tokenizer)), kept(tokenizer)
    corpus = docs.sparkSession.sparkContext.broadcast(measured(texts, held))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(key, rows):
        rows = rows.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids = rows["doc_id"].combine_chunks()
        tokens = [np.append(np.frombuffer(x, dtype=held).astype("<u4"), np.uint32(END)) for x in rows["ids"].to_pylist()]
        d, start, length, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*fill(tokens, corpus.value, window), strict=True))
        crc = [zlib.crc32(tokens[k][s : s + n].astype("<u4").tobytes()) for k, s, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True)]
        size = np.array([len(t) for t in tokens], dtype=np.int64)[d]
        return pa.table({"doc_id": ids.take(pa.array(d)), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": size, "sequence_id": seq + (key[0].as_py() << 32), "offset": offset})

    return placed(texts, corpus, shard_bytes, held).select("doc_id", "ids", "shard").groupBy("shard").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
