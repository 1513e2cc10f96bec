"""Removal of repeated byte strings by a sparse suffix array, sorted deep-shallow.

A byte goes if a string of `LENGTH` bytes over it also starts anywhere else. Of every such string one place
is chosen by its content alone: where its `GRAM`-byte substring of smallest hash begins. Equal strings share that
place, so only suffixes that begin at chosen places (anchors) with equal substrings can witness a repeat. Anchors
whose substring occurs once drop out before any text is moved. Anchors of equal context (all that a string of LENGTH
bytes over the anchor can reach) are one entry with a count, however often a text was copied.

The entries of a shard are sorted twice, by what follows the anchor and by what precedes it, read backwards:
multikey quicksort over 8-byte characters to a depth of `SHALLOW` bytes, then blind tries order the groups that are
still equal. From both orders and their longest common prefixes, a sweep over the common lengths to the right
finds for each entry how far repeated strings reach to either side. Its cost grows with the entries, not with
their pairs. The reaches go back to all anchors of that context, and each document merges its intervals.

A substring with more than `CROWD` anchors is not brought to one task. Its entries are split by further context
instead: by all stretches of LENGTH - STEP bytes over the anchor that begin a multiple of STEP before it. Stretches
that occur once die; what is left is told apart byte by byte. Every step is an aggregate.

A second, shorter length can be measured on the same orders: `measure` also counts the bytes under repeated
strings of `PASSAGE` bytes, about 40 words.

Defined results: null text counts as empty. Texts shorter than LENGTH keep all. Repeated rows repeat each other
in full. Matches never cross rows. An empty table gives an empty result. doc_id is an integer; null ids are rows like any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, discard, portions, prefix_hash, range_hash, stored

LENGTH = 400
PASSAGE = 240
GRAM = 32
SHALLOW = 64
#: Bytes of context in a shard, about.
SHARD_BYTES = 8 << 20
#: Anchors with one substring that a shard may hold, and the grid on which a larger group is split.
CROWD, STEP = 1 << 16, 16
#: A task remembers so many contexts to send each of them once.
MEMORY = 400_000
#: Rows of a batch that carries contexts.
BATCH = 4096


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of the chosen substrings of all strings of `length` bytes that lie in one row."""
    n, wide = len(data), length - gram + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none
    bits = n.bit_length()  # the lowest bits of a hash hold the place
    at = np.arange(n - gram + 1)
    grams = range_hash(prefix_hash(data), at, at + gram)
    low = np.uint64((1 << bits) - 1)
    key = (grams & ~low) | at.astype(np.uint64)  # of equal hashes the leftmost
    blocks = -(-len(key) // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    cells = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    least = np.minimum(behind[starts], ahead[starts + wide - 1])
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.unique((least[starts + length <= row_end[: len(starts)]] & low).astype(np.int64))
    return np.searchsorted(offsets, place, side="right") - 1, place, grams[place].view(np.int64)


def blind_trie(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
    """members ordered by their rows. Inner nodes know a depth and a child per byte there; only leaves know strings."""
    wide = rows.shape[1]
    root: list = [wide, {}, int(members[0])]  # depth, children, and for a leaf its member
    for m in members[1:].tolist():
        s = rows[m]
        node = root
        while node[1]:  # blind: bytes between branching depths are not looked at
            node = node[1].get(int(s[node[0]])) or next(iter(node[1].values()))
        differ = s != rows[node[2]]
        depth = int(differ.argmax()) if differ.any() else wide
        up, node = None, root
        while node[1] and node[0] < depth:
            up, node = node, node[1][int(s[node[0]])]
        leaf = [wide, {}, m]
        if depth == wide:  # an equal string: beside the leaf
            node[2:] = [*node[2:], m]
        elif node[1] and node[0] == depth:
            node[1][int(s[depth])] = leaf
        else:
            old = rows[_leaf(node)]
            inner = [depth, {int(old[depth]): node, int(s[depth]): leaf}]
            if up is None:
                root = inner
            else:
                up[1][int(s[up[0]])] = inner
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node[1]:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node[2:]
    return np.array(out, dtype=np.int64)


def _leaf(node: list) -> int:
    while node[1]:
        node = next(iter(node[1].values()))
    return node[2]


def deep_shallow(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows of a byte matrix by (group, bytes). Its width is a multiple of 8."""
    words = rows.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    same = np.concatenate([[False], group[order][1:] == group[order][:-1]])
    for d in range(min(shallow // 8, words.shape[1])):
        begin = np.flatnonzero(~same)
        name = np.cumsum(~same) - 1
        size = np.diff(np.append(begin, len(order)))
        open_ = np.flatnonzero(size[name] > 1)  # places in groups that are still equal
        if not len(open_):
            return order
        own = words[order[open_], d]
        by = np.lexsort((own, name[open_]))
        order[open_] = order[open_[by]]
        own, name = own[by], name[open_]
        same[open_] = np.concatenate([[False], (own[1:] == own[:-1]) & (name[1:] == name[:-1])])
    begin = np.flatnonzero(~same)
    end = np.append(begin[1:], len(order))
    for i, j in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        order[i:j] = blind_trie(rows, order[i:j])
    return order


def common(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row in order with the one before it."""
    out = np.zeros(len(order), dtype=np.int64)
    for at in range(1, len(order), 4096):
        a, b = order[at - 1 : at + 4095], order[at : at + 4096]
        a = a[: len(b)]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[at : at + len(b)] = np.minimum(first, np.minimum(sizes[a], sizes[b]))
    return out


class RangeMin:
    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Minimum of values[i:j], for i < j."""
        k = np.frexp((j - i).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for level in np.unique(k):
            own = k == level
            out[own] = np.minimum(self.levels[level][i[own]], self.levels[level][j[own] - (1 << int(level))])
        return out


Reach = tuple[np.ndarray, np.ndarray]


def reaches(right: np.ndarray, right_lcp: np.ndarray, left: np.ndarray, left_lcp: np.ndarray, n: int, lengths: tuple[int, ...]) -> list[Reach]:
    """For each of lengths: how far repeated strings of so many bytes reach left and right of each of n entries with one anchor substring.

    right and left are the entries in both orders, with common prefixes of neighbours. Entries that have r bytes in common to
    the right are runs of `right`; in such a run, the longest common left part of an entry is with a neighbour in `left`'s order."""
    out = [(np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)) for _ in lengths]
    least = RangeMin(left_lcp)
    for r in np.unique(right_lcp[1:])[::-1].tolist():
        run = np.empty(n, dtype=np.int64)
        run[right] = np.cumsum(np.concatenate([[0], right_lcp[1:] < r]))
        own = run[left]
        by = np.argsort(own, kind="stable")
        pair = np.flatnonzero(own[by][1:] == own[by][:-1])
        i, j = by[pair], by[pair + 1]
        shared = least.of(i + 1, j + 1)
        for length, (to_left, to_right) in zip(lengths, out, strict=True):
            ok = shared + r >= length
            for side in (left[i[ok]], left[j[ok]]):
                np.maximum.at(to_left, side, shared[ok])
                np.maximum.at(to_right, side, r)
    return out


def matrix(parts: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    out = np.zeros((len(parts), -(-wide // 8) * 8), dtype=np.uint8)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return out, sizes


def shard_reaches(key: np.ndarray, count: np.ndarray, left: list[bytes], right: list[bytes], lengths: tuple[int, ...]) -> list[Reach]:
    """Reaches of the entries of a shard. left is read backwards."""
    rows_r, size_r = matrix(right, max(lengths))
    rows_l, size_l = matrix(left, max(lengths))
    by_right, by_left = deep_shallow(rows_r, key), deep_shallow(rows_l, key)
    lcp_r, lcp_l = common(rows_r, size_r, by_right), common(rows_l, size_l, by_left)
    out = [(np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)) for _ in lengths]
    bound = np.flatnonzero(np.concatenate([[True], key[by_right][1:] != key[by_right][:-1], [True]]))
    size = np.diff(bound)
    two = bound[:-1][size == 2]  # most groups: the second row of either order knows what both share
    for length, (to_left, to_right) in zip(lengths, out, strict=True):
        ok = lcp_l[two + 1] + lcp_r[two + 1] >= length
        for k in (0, 1):
            to_left[by_right[two[ok] + k]], to_right[by_right[two[ok] + k]] = lcp_l[two[ok] + 1], lcp_r[two[ok] + 1]
    place = np.empty(len(key), dtype=np.int64)
    for i, j in zip(bound[:-1][size > 2].tolist(), bound[1:][size > 2].tolist(), strict=True):
        r, lf = by_right[i:j], by_left[i:j]
        place[r] = np.arange(j - i)
        for (to_left, to_right), (lo, hi) in zip(out, reaches(np.arange(j - i), lcp_r[i:j], place[lf], lcp_l[i:j], j - i, lengths), strict=True):
            to_left[r], to_right[r] = lo, hi
    for length, (to_left, to_right) in zip(lengths, out, strict=True):
        twice = (count > 1) & (size_l + size_r >= length)  # equal contexts repeat each other in full
        to_left[twice], to_right[twice] = size_l[twice], size_r[twice]
    return out


def _named(docs: DataFrame, *more: str | Column) -> DataFrame:
    """Texts as bytes, and d and u, which name a row and its equals."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("d"), F.xxhash64(text).alias("u"), text.alias("text"), *more)


def _digest(data: bytes | memoryview, at: int) -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=int(at).to_bytes(8, "little")).digest()


def found_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """d, u, m (place) and key (hash of the substring) of every anchor."""

    def find(batches):
        for batch in batches:
            data, at = buffers(batch.column(2))
            d, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in portions(at, 1 << 19):
                own = at[i : j + 1] - at[i]
                row, place, key = anchors(data[at[i] : at[j]], own, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(d[i:j][row]), pa.array(u[i:j][row]), pa.array(place - own[row]), pa.array(key)], names=["d", "u", "m", "key"])

    return rows.mapInArrow(find, "d long, u long, m long, key long")


def contexts(rows: DataFrame, longest: int, gram: int) -> DataFrame:
    """Of rows(d, u, text, hits(m, key, crowd)): per hit its context's digest and sizes to the left and right.

    The first time that a task meets a context, the row also carries its bytes and n = 1. What it meets again is
    counted in rows without d, so that n sums up to the context's number over all rows."""

    def show(batches):
        names = ["d", "u", "m", "key", "crowd", "ctx", "l", "r", "n", "part"]
        seen: dict[bytes, list] = {}

        def again():
            more = [(c, *x) for c, x in seen.items() if x[0]]
            seen.clear()
            ctx, n, key, crowd, left, right = zip(*more, strict=True) if more else [()] * 6
            none = pa.nulls(len(more), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(key, pa.int64()), pa.array(crowd, pa.bool_()), pa.array(ctx, pa.binary()), pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(more), pa.binary())], names=names)

        for batch in batches:
            data, at = buffers(batch.column(2))
            whole, hits = memoryview(data.tobytes()), batch.column(3)
            first = hits.offsets.to_numpy()
            held = hits.values.slice(first[0], first[-1] - first[0])
            row = np.repeat(np.arange(len(batch)), np.diff(first))
            order = np.lexsort((held.field("m").to_numpy(), row))
            row, m, key, crowd = row[order], held.field("m").to_numpy()[order], held.field("key").to_numpy()[order], held.field("crowd").to_numpy(zero_copy_only=False)[order]
            place = at[row] + m
            begin, end = np.maximum(at[row], place - (longest - gram)), np.minimum(at[row + 1], place + longest)
            d, u = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            for i in range(0, len(row), BATCH):
                own = slice(i, i + BATCH)
                ctx, parts, n = [], [], []
                for s, p, e, k, c in zip(begin[own].tolist(), place[own].tolist(), end[own].tolist(), key[own].tolist(), crowd[own].tolist(), strict=True):
                    name = _digest(whole[s:e], p - s)
                    ctx.append(name)
                    if name in seen:
                        seen[name][0] += 1
                        parts.append(None)
                        n.append(0)
                    else:
                        seen[name] = [0, k, c, p - s, e - p]
                        parts.append(whole[s:e].tobytes())
                        n.append(1)
                left, right = (place - begin)[own], (end - place)[own]
                yield pa.RecordBatch.from_arrays([pa.array(d[own]), pa.array(u[own]), pa.array(m[own]), pa.array(key[own]), pa.array(crowd[own]), pa.array(ctx, pa.binary()), pa.array(left), pa.array(right), pa.array(n, pa.int64()), pa.array(parts, pa.binary())], names=names)
                if len(seen) > MEMORY:
                    yield from again()
        yield from again()

    return rows.mapInArrow(show, "d long, u long, m long, key long, crowd boolean, ctx binary, l long, r long, n long, part binary")


def shard_table(placed: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """ctx, lo0, hi0, lo1, ... of the contexts that repeat, sorted shard by shard. Shards keep a substring together."""
    entries = placed.where("n > 0 AND NOT crowd")
    shards = max(1, -(-entries.where("part IS NOT NULL").count() * 2 * max(lengths) // SHARD_BYTES))
    names = [f"{x}{k}" for k in range(len(lengths)) for x in ("lo", "hi")]

    def sort(rows):
        rows = rows.combine_chunks()
        number: dict[bytes, int] = {}
        own = np.array([number.setdefault(c, len(number)) for c in rows["ctx"].to_pylist()], dtype=np.int64)
        n = np.bincount(own, weights=rows["n"].to_numpy()).astype(np.int64)
        shown = np.flatnonzero(rows["part"].is_valid().to_numpy())
        at = np.empty(len(number), dtype=np.int64)
        at[own[shown]] = shown  # tasks may show a context each
        parts, cut, key = rows["part"].take(pa.array(at)).to_pylist(), rows["l"].to_numpy()[at].tolist(), rows["key"].to_numpy()[at]
        reach = shard_reaches(key, n, [p[:k][::-1] for p, k in zip(parts, cut, strict=True)], [p[k:] for p, k in zip(parts, cut, strict=True)], lengths)
        hit = np.flatnonzero(np.any([hi > 0 for _, hi in reach], axis=0))
        ctx = list(number)
        return pa.table([pa.array([ctx[i] for i in hit], pa.binary()), *(x[hit] for pair in reach for x in pair)], names=["ctx", *names])

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    return entries.select(shard, "key", "ctx", "n", "l", "part").groupBy("shard").applyInArrow(sort, "ctx binary, " + ", ".join(f"{x} long" for x in names))


def crowd_reach(crowd: DataFrame, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """ctx, k, lo and hi of the contexts of crowd(key, ctx, n, l, part) over which a string of lengths[k] bytes repeats.

    Such a string begins t bytes before the anchor, with t from 0 to length - gram; wanted are the largest and the
    smallest t of each context. It contains the stretch of length - STEP bytes that begins at t's multiple of STEP, so only
    multiples whose stretch repeats are open. The strings of an open multiple lie in one piece of the context; equal pieces
    are counted once, then their strings."""
    kinds = "ctx binary, k long, bucket long, name binary, wide binary, n long"

    def table(batch):
        return zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("ctx", "key", "l", "part", "n")), strict=True)

    def split(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for ctx, key, x, p, n in table(batch):
                for k, length in enumerate(lengths):
                    for b in range(0, min(x, length - gram) + 1, STEP):
                        if x - b + length - STEP <= len(p):
                            lead, salt = min(STEP - 1, x - b), (key & 0xFFFFFFFF) << 8
                            row = ctx, k, b, _digest(p[x - b : x - b + length - STEP], salt), _digest(p[x - b - lead : x - b + length], salt + lead), n
                            for c, value in zip(out, row, strict=True):
                                c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if i in (0, 3, 4) else pa.int64()) for i, v in enumerate(out)], names=["ctx", "k", "bucket", "name", "wide", "n"])

    shown = stored(crowd.mapInArrow(split, kinds))
    often = shown.groupBy("k", "bucket", "name").agg(F.sum("n").alias("total")).where("total > 1").select("k", "bucket", "name")
    live = stored(shown.join(often, ["k", "bucket", "name"]).select("ctx", "k", "bucket", "wide", "n"))
    pieces = live.groupBy("k", "bucket", "wide").agg(F.sum("n").alias("n"), F.min("ctx").alias("ctx"))

    def spell(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            more = zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("k", "bucket", "wide")), strict=True)
            for (_, key, x, p, n), (k, b, wide) in zip(table(batch), more, strict=True):
                for t in range(b, min(b + STEP - 1, x, lengths[k] - gram) + 1):
                    if x - t + lengths[k] <= len(p):
                        for c, value in zip(out, (k, b, wide, t, _digest(p[x - t : x - t + lengths[k]], key & 0xFFFFFFFF), n), strict=True):
                            c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if i in (2, 4) else pa.int64()) for i, v in enumerate(out)], names=["k", "bucket", "wide", "t", "name", "n"])

    strings = stored(pieces.join(crowd.select("ctx", "key", "l", "part"), "ctx").mapInArrow(spell, "k long, bucket long, wide binary, t long, name binary, n long"))
    twice = strings.groupBy("k", "t", "name").agg(F.sum("n").alias("total")).where("total > 1").select("k", "t", "name")
    hit = strings.join(twice, ["k", "t", "name"]).groupBy("k", "bucket", "wide").agg(F.max("t").alias("most"), F.min("t").alias("least"))
    length = F.element_at(F.array(*(F.lit(x) for x in lengths)), (F.col("k") + 1).cast("int"))
    return live.join(hit, ["k", "bucket", "wide"]).groupBy("ctx", "k").agg(F.max("most").alias("lo"), (F.first(length) - F.min("least")).alias("hi"))


def intervals(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """d, u and per length spans0, spans1, ... (begin, end): the repeated bytes of each text that has any, not yet merged."""
    rows = _named(docs)
    found = stored(found_anchors(rows, min(lengths), gram))
    # stored, so that the join can split a substring that has very many anchors
    often = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("key", (F.col("total") > crowd).alias("crowd")))
    hits = found.join(often, "key").groupBy("d", "u").agg(F.collect_set(F.struct("m", "key", "crowd")).alias("hits"))
    placed = stored(contexts(rows.join(hits, ["d", "u"]).select("d", "u", "text", "hits"), max(lengths), gram))
    discard(found, often)
    reach = shard_table(placed, lengths)
    many = placed.where("n > 0 AND crowd").groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.max("l").alias("l"), F.max("part").alias("part"))
    many = stored(many)
    if not many.isEmpty():
        own = stored(crowd_reach(many, lengths, gram))
        reach = reach.unionByName(own.groupBy("ctx").agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col(x))), F.lit(0)).alias(f"{x}{k}") for k in range(len(lengths)) for x in ("lo", "hi"))))
    reach = stored(reach)
    spans = [F.collect_set(F.when(F.col(f"hi{k}") > 0, F.struct((F.col("m") - F.col(f"lo{k}")).alias("s"), (F.col("m") + F.col(f"hi{k}")).alias("e")))).alias(f"spans{k}") for k in range(len(lengths))]
    return placed.where("d IS NOT NULL").select("d", "u", "m", "ctx").join(reach, "ctx").groupBy("d", "u").agg(*spans)


def cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and runs removed."""
    if not spans:
        return text, 0, 0
    kept, at, gone, runs = [], 0, 0, 0
    end = -1
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if s > end:  # a new run
            kept.append(text[at:s])
            runs += 1
            gone += e - s
            at = end = e
        elif e > end:
            gone += e - end
            at = end = e
    kept.append(text[at:])
    return b"".join(kept), gone, runs


def measure(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage (bytes under repeated strings of `passage` bytes) of every row."""
    rows = _named(docs, "doc_id").join(intervals(docs, (length, passage)), ["d", "u"], "left").select("doc_id", "text", "spans0", "spans1")

    def run(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            texts = batch.column(1).to_pylist()
            out = [cut(t, s) for t, s in zip(texts, batch.column(2).to_pylist(), strict=True)]
            under = [cut(t, s)[1] for t, s in zip(texts, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], pa.string()), pa.array(under, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes gone from text, and characters that lost a part of their bytes; n_chars follows if there is one."""
    names, kind = docs.columns, docs.schema
    rows = _named(docs, F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))  # whatever the columns are called
    joined = rows.join(intervals(docs, (length,)), ["d", "u"], "left").select("row", F.col("spans0").alias("spans"))
    joined = joined.select(F.col("row.text").alias("text"), "spans", *(F.col(f"row.`{c}`").alias(f"c{k}") for k, c in enumerate(names)))

    def run(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            texts = [t if not s else cut(t.encode(), s)[0].decode(errors="ignore") for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            held = dict(zip(names, batch.columns[2:], strict=True))
            held["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(held.values()), names=list(held))

    out = joined.mapInArrow(run, kind)
    return out.withColumn("n_chars", F.length("text").cast(kind["n_chars"].dataType)) if "n_chars" in names else out
