"""Byte-level BPE on length-bucketed padded matrices.

The tokenizer's pattern cuts texts into pieces that no merge crosses. Distinct pieces of a batch that the
worker has not seen yet go into buckets by length, and each bucket is one padded matrix of ids. Each round every row merges its leftmost pair of minimum rank: pairs are looked up in an
open-addressing table, `argmin` gives the leftmost minimum, and rows move up over the freed place. Rows
without a pair left leave the matrix. A row of over `LONG` bytes merges, in one round, all
non-overlapping places of its minimum-rank pair from the left: nothing of lower rank can arise between
them, as a merge of a new token has a higher rank than the token.

Defined results: null text counts as empty and gives no ids. Repeated rows are encoded each on its own.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_bytes

#: Rows of more bytes merge all places of a pair in a round.
LONG = 2048
#: A worker forgets its units when it holds so many.
MEMORY = 600_000
_NONE = np.int32(0x7FFFFFFF)
#: Letters of Latin script; texts of these and ASCII are cut by the faster of two equal patterns.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x7fÀ-ÖØ-öø-ɏ]")


def latin_pattern(pattern: str) -> re.Pattern:
    """The same cuts for texts without a match of _OTHER, in Python's own syntax."""
    return re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LATIN}0-9]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]"))


class BytePairs:
    """Encoder and decoder over a rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for b, r in ranks.items():
            self.token[r] = b
        self.text_of = [str(i) for i in range(self.size)]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pattern, self.latin = regex.compile(pattern), latin_pattern(pattern)
        self.cache: dict[str, bytes] = {}
        # every split of a token into two tokens is a pair that merges into it
        pairs = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.mask = (1 << int(4 * len(pairs) - 1).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.ranks = np.full(self.mask + 1, _NONE, dtype=np.int32)
        key, todo, step = left * self.size + right, np.arange(len(pairs)), 0
        while len(todo):
            at = (self.slot(key[todo]) + step) & self.mask
            free = self.keys[at] < 0
            self.keys[at[free]] = key[todo[free]]
            placed = self.keys[at] == key[todo]
            self.ranks[at[placed]] = rank[todo[placed]]
            todo, step = todo[~placed], step + 1
        self.probes = step

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B1) >> 15) & self.mask

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where none merges or a place is empty (negative id)."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        out = np.full(key.shape, _NONE, dtype=np.int32)
        at = self.slot(key)
        live = np.flatnonzero(key.ravel() >= 0)
        flat, key, at = out.ravel(), key.ravel(), at.ravel()
        for step in range(self.probes):
            if not len(live):
                break
            p = (at[live] + step) & self.mask
            found = self.keys[p]
            hit = found == key[live]
            flat[live[hit]] = self.ranks[p[hit]]
            live = live[~hit & (found >= 0)]
        return flat.reshape(out.shape)

    def merge_rows(self, ids: np.ndarray) -> list[bytes]:
        """BPE of every row of a matrix of ids, padded at the right by -1."""
        out = [b""] * len(ids)
        names, ids = np.arange(len(ids)), ids.copy()
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        while len(ids):
            if ids.shape[1] < 2:
                best = np.full(len(ids), _NONE)
            else:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(ids)), at]
            done = best == _NONE
            if done.any():
                own = ids[done]
                whole, ends = own[own >= 0].tobytes(), np.cumsum((own >= 0).sum(axis=1) * 4).tolist()
                for k, i, j in zip(names[done].tolist(), [0, *ends], ends, strict=False):
                    out[k] = whole[i:j]
                names, ids, rank = names[~done], ids[~done], rank[~done]
                if not len(ids):
                    break
                at, best = at[~done], best[~done]
            rows, wide = np.arange(len(ids)), ids.shape[1]
            ids[rows, at] = best
            # the places after the merged pair move up by one
            move = np.arange(wide - 1)[None, :] + (np.arange(wide - 1)[None, :] > at[:, None])
            ids = np.take_along_axis(ids, move, axis=1)
            if wide > 2:
                rank = np.take_along_axis(rank, np.minimum(move[:, : wide - 2], wide - 2), axis=1)
                for side in (at - 1, at):  # only pairs with the new token change
                    ok = (side >= 0) & (side < wide - 2)
                    rank[rows[ok], side[ok]] = self.pair_rank(ids[rows[ok], side[ok]], ids[rows[ok], side[ok] + 1])
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """BPE of one long row: each round merges every non-overlapping place of the minimum-rank pair from the left."""
        while len(ids) > 1:
            rank = self.pair_rank(ids[:-1], ids[1:])
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            fresh = np.diff(at, prepend=-2) > 1
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - first) % 2 == 0]  # of overlapping places every other one
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian int32."""
        out = [b""] * len(pieces)
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        for k in np.flatnonzero(size > LONG):
            out[k] = self.merge_long(self.byte_id[np.frombuffer(pieces[k], dtype=np.uint8)]).tobytes()
        short = np.flatnonzero((size > 0) & (size <= LONG))
        order = short[np.argsort(size[short], kind="stable")]
        at = 0
        while at < len(order):
            # a bucket: like lengths, and a bounded matrix
            wide = int(size[order[at]])
            wide = wide + 1 if wide < 24 else 2 * wide
            end = min(int(np.searchsorted(size[order], wide, side="right")), at + max(1, (1 << 18) // wide))
            own = order[at:end]
            wide = int(size[own].max())
            joined = np.frombuffer(b"".join([pieces[k] for k in own]), dtype=np.uint8)
            ids = np.full((len(own), wide), -1, dtype=np.int32)
            ids[np.arange(wide)[None, :] < size[own][:, None]] = self.byte_id[joined]
            for k, x in zip(own.tolist(), self.merge_rows(ids), strict=True):
                out[k] = x
            at = end
        return out

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text) if _OTHER.search(text) else self.latin.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32."""
        cut, own = [self.cut(t) for t in texts], self.cache
        todo = set().union(*cut).difference(own)
        if len(own) + len(todo) > MEMORY:
            own.clear()
            todo = set().union(*cut)
        names = list(todo)
        own.update(zip(names, self.encode_pieces([p.encode() for p in names]), strict=True))
        return [b"".join(map(own.__getitem__, x)) for x in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_held: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One per worker and vocabulary."""
    if (path, pattern) not in _held:
        _held[path, pattern] = BytePairs(path, pattern)
    return _held[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""

    def run(batches):
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(x, dtype=np.int32) for t in batch.column(1).to_pylist() for x in pairs.encode([t.decode()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids in decimal joined by spaces, and of the bytes that the ids decode to."""

    def run(batches):
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            n, ids, back = [], [], []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for x in pairs.encode([t.decode() for t in texts[at : at + 256]]):
                    own = np.frombuffer(x, dtype=np.int32).tolist()
                    n.append(len(own))
                    ids.append(hashlib.sha256(" ".join(map(pairs.text_of.__getitem__, own)).encode()).hexdigest())
                    back.append(hashlib.sha256(pairs.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
