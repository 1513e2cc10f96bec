"""Exact nearest neighbours over mixed columns, in blocks of a k-d tree.

Distances are metrics: Gower's (mean over the columns of the gap as a share of the column's range, or 0 and 1 for categories;
a missing value is at 1 from every other and at 0 from a missing one) or Euclid's over scaled numbers. Of candidates that are
alike only the k of least id can be among the k nearest, so no others are kept. A sample is cut at medians of its widest
columns into the leaves of a tree, and every candidate falls into one leaf's block; a box holds the ends of a block's columns.
A query first searches the block it falls into, then those whose boxes reach nearer than its k-th best so far. Blocks and the
queries that go to one are cut to bounded size, so a task holds one block and one group of its queries; there, smaller
leaves of the same kind spare most distances.

Ties in a distance of nine decimals go to the smaller id. Categories are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialised

#: About how many leaves the tree over all candidates has at most, sampled rows of a leaf, and rows of a leaf inside a block.
PIVOTS, SAMPLED, LEAF = 1024, 64, 256
BLOCK_ROWS, QUERY_ROWS = 32768, 32768
#: Cells of a matrix of distances that is held at once.
CELLS = 1 << 21
DIGITS = 9
#: What rounding may take from a distance.
SLACK = 2 * 10.0**-DIGITS


def ranges(sides: list[DataFrame], numeric: list[str]) -> dict[str, float]:
    """One over each column's range over all sides; 0 for a constant column."""
    if not numeric:
        return {}
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    ends = [d.agg(*(f(value(c)).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("lo", F.min), ("hi", F.max)))).first() for d in sides]
    out = {}
    for i, c in enumerate(numeric):
        lo, hi = ([e[f"{k}{i}"] for e in ends if e[f"{k}{i}"] is not None] for k in ("lo", "hi"))
        out[c] = 1 / (max(hi) - min(lo)) if lo and max(hi) > min(lo) else 0.0
    return out


def encode(df: DataFrame, key: str, scale: dict[str, float], categorical: list[str]) -> DataFrame:
    """id, x (scaled numbers, NaN: missing) and c (hashes of categories)."""
    number = lambda c, s: F.coalesce(F.col(f"`{c}`").cast("double") * F.lit(s), F.lit(float("nan")))
    word = lambda c: F.when(F.col(f"`{c}`").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(f"`{c}`").cast("string")))
    x = F.array(*(number(c, s) for c, s in scale.items())) if scale else F.array().cast("array<double>")
    c = F.array(*map(word, categorical)) if categorical else F.array().cast("array<long>")
    return df.select(F.col(f"`{key}`").alias("id"), x.alias("x"), c.alias("c"))


def distances(qx: np.ndarray, qc: np.ndarray, sx: np.ndarray, sc: np.ndarray, metric: str) -> np.ndarray:
    """Of each query to each candidate."""
    total = np.zeros((len(qx), len(sx)))
    for j in range(qx.shape[1]):
        gap = np.abs(qx[:, j][:, None] - sx[:, j])
        if metric == "gower":
            alone = np.isnan(gap)
            if alone.any():
                gap[alone] = (np.isnan(qx[:, j])[:, None] != np.isnan(sx[:, j]))[alone]
            total += gap
        else:
            total += gap * gap
    for j in range(qc.shape[1]):
        total += qc[:, j][:, None] != sc[:, j]
    return total / max(1, qx.shape[1] + qc.shape[1]) if metric == "gower" else np.sqrt(total)


def _arrays(batch, x: str = "x", c: str = "c") -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two list columns as matrices."""
    out = []
    for name, kind in ((x, np.float64), (c, np.int64)):
        column = batch[name].combine_chunks() if isinstance(batch[name], pa.ChunkedArray) else batch[name]
        out.append(column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=kind))
    return out[0], out[1]


class Boxes(NamedTuple):
    """Ends of each leaf's columns: numbers (inf and -inf without one), whether one is missing, hashes."""

    lo: np.ndarray
    hi: np.ndarray
    missing: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def bounds(self, x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
        """No row of a leaf is nearer to a query."""
        total = np.zeros((len(x), len(self.lo)))
        for j in range(x.shape[1]):
            v = x[:, j][:, None]
            gap = np.maximum(np.maximum(self.lo[:, j] - v, v - self.hi[:, j]), 0)
            if metric == "gower":
                gap = np.where(self.missing[:, j], np.minimum(gap, 1), gap)
                gap[np.isnan(x[:, j])] = np.where(self.missing[:, j], 0.0, 1.0)
                total += gap
            else:
                total += np.where(np.isnan(gap), 0, gap * gap)
        for j in range(c.shape[1]):
            v = c[:, j][:, None]
            total += (v < self.first[:, j]) | (v > self.last[:, j])
        return total / max(1, x.shape[1] + c.shape[1]) if metric == "gower" else np.sqrt(total)


class Tree:
    """Rows cut at medians, always of the widest column, down to leaves of at most `most` rows (more if all are alike)."""

    def __init__(self, x: np.ndarray, c: np.ndarray, most: int):
        self.cuts: list[list] = []  # column, value, below, above: a number of a cut, or -1 - a leaf
        leaves: list[np.ndarray] = []

        def grow(own: np.ndarray) -> int:
            cut = self._cut(x, c, own) if len(own) > most else None
            if cut is None:
                leaves.append(own)
                return -len(leaves)
            j, value = cut
            at = len(self.cuts)
            self.cuts.append([j, value, 0, 0])
            under = (x[own, j] if j < x.shape[1] else c[own, j - x.shape[1]]) < value
            self.cuts[at][2] = grow(own[under])
            self.cuts[at][3] = grow(own[~under])
            return at

        grow(np.arange(len(x)))
        self.leaves = leaves

    @staticmethod
    def _cut(x: np.ndarray, c: np.ndarray, own: np.ndarray) -> tuple | None:
        widest, cut = 0.0, None
        for j in range(x.shape[1]):
            v = x[own, j]
            known = v[~np.isnan(v)]
            spread = known.max() - known.min() if len(known) else 0.0
            if 0 < len(known) < len(v):
                spread = max(spread, 1.0)
            if spread > widest:
                widest, cut = spread, (j, known)
        for j in range(c.shape[1]):
            v = c[own, j]
            if widest < 1 and v.min() != v.max():
                widest, cut = 1.0, (x.shape[1] + j, v)
        if cut is None:
            return None
        j, v = cut
        value, least = np.partition(v, len(v) // 2)[len(v) // 2], v.min()
        if value == least:
            more = v[v > least]
            value = more.min() if len(more) else np.inf  # inf: the rest is missing
        return j, value

    def place(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        out = np.zeros(len(x), dtype=np.int32)
        open_ = [(0 if self.cuts else -1, np.arange(len(x)))]
        while open_:
            at, own = open_.pop()
            if at < 0:
                out[own] = -1 - at
            elif len(own):
                j, value, below, above = self.cuts[at]
                under = (x[own, j] if j < x.shape[1] else c[own, j - x.shape[1]]) < value
                open_ += [(below, own[under]), (above, own[~under])]
        return out


def leaves(x: np.ndarray, c: np.ndarray, most: int = LEAF) -> tuple[np.ndarray, np.ndarray, Boxes]:
    """An order of the rows in which leaves lie together, where each begins and the end, and their boxes."""
    own = Tree(x, c, most).leaves
    order, starts = np.concatenate(own), np.cumsum([0, *map(len, own)])
    x, c, at = x[order], c[order], starts[:-1]
    gone = np.isnan(x)
    ends = [np.minimum.reduceat(np.where(gone, np.inf, x), at), np.maximum.reduceat(np.where(gone, -np.inf, x), at), np.logical_or.reduceat(gone, at)]
    return order, starts, Boxes(*ends, np.minimum.reduceat(c, at), np.maximum.reduceat(c, at))


def visit(x: np.ndarray, c: np.ndarray, boxes: Boxes, metric: str, reach: np.ndarray, look: Callable[[np.ndarray, int], None]) -> None:
    """Calls look(queries, leaf) for each leaf that may hold something within `reach` of them, which look lessens: the two nearest leaves first, then all others."""
    step = max(1, CELLS // len(boxes.lo))
    for i in range(0, len(x), step):
        near = boxes.bounds(x[i : i + step], c[i : i + step], metric) - SLACK
        every = np.arange(len(near))
        for _ in range(2):
            leaf = near.argmin(axis=1)
            some = (near[every, leaf] <= reach[i : i + step]) & (near[every, leaf] < np.inf)
            _each(every[some] + i, leaf[some], look)
            near[every, leaf] = np.inf  # seen, or beyond reach
        at, leaf = np.nonzero((near <= reach[i : i + step][:, None]) & (near < np.inf))
        _each(at + i, leaf, look)


def _each(queries: np.ndarray, leaf: np.ndarray, look: Callable[[np.ndarray, int], None]) -> None:
    order = np.argsort(leaf, kind="stable")
    queries, leaf = queries[order], leaf[order]
    starts = np.flatnonzero(np.diff(leaf, prepend=-1))
    for own, at in zip(np.split(queries, starts[1:]), leaf[starts], strict=True) if len(starts) else ():
        for i in range(0, len(own), CELLS // LEAF):
            look(own[i : i + CELLS // LEAF], int(at))


def nearest(qx: np.ndarray, qc: np.ndarray, sx: np.ndarray, sc: np.ndarray, order: np.ndarray, k: int, most: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and distance of the k nearest candidates at `most` or nearer, ties by `order`."""
    rows, starts, boxes = leaves(sx, sc)
    sx, sc, order = sx[rows], sc[rows], order[rows]
    top, reach = np.full((len(qx), k), np.inf), most.astype(float)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]

    def look(own: np.ndarray, leaf: int) -> None:
        lo, hi = starts[leaf], starts[leaf + 1]
        d = np.round(distances(qx[own], qc[own], sx[lo:hi], sc[lo:hi], metric), DIGITS)
        best = np.sort(np.concatenate([top[own], np.partition(d, k - 1, axis=1)[:, :k] if hi - lo > k else d], axis=1), axis=1)[:, :k]
        top[own], reach[own] = best, np.minimum(reach[own], best[:, -1])
        q, s = np.nonzero(d <= reach[own][:, None])
        found.append((own[q], s + lo, d[q, s]))

    visit(qx, qc, boxes, metric, reach, look)
    q, s, d = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((order[s], d, q))
    q, s, d = q[by], s[by], d[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[keep], rows[s[keep]], d[keep]


def least(qx: np.ndarray, qc: np.ndarray, wanted: np.ndarray, sx: np.ndarray, sc: np.ndarray, mask: np.ndarray, most: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, part (a bit of `wanted`) and the distance of the nearest candidate whose `mask` has that bit, at `most` or nearer."""
    rows, starts, boxes = leaves(sx, sc)
    sx, sc, mask = sx[rows], sc[rows], mask[rows]
    parts = max(1, int(wanted.max(initial=0)).bit_length())
    asked = (wanted[:, None] >> np.arange(parts) & 1).astype(bool)
    held = (mask[:, None] >> np.arange(parts) & 1).astype(bool)
    best, limit, reach = np.where(asked, np.inf, -np.inf), most.astype(float), most.astype(float)

    def look(own: np.ndarray, leaf: int) -> None:
        lo, hi = starts[leaf], starts[leaf + 1]
        d = np.round(distances(qx[own], qc[own], sx[lo:hi], sc[lo:hi], metric), DIGITS)
        for i in range(parts):
            best[own, i] = np.minimum(best[own, i], d[:, held[lo:hi, i]].min(axis=1, initial=np.inf))
        reach[own] = np.minimum(limit[own], best[own].max(axis=1))

    visit(qx, qc, boxes, metric, reach, look)
    q, i = np.nonzero((best <= limit[:, None]) & np.isfinite(best))
    return q, i, best[q, i]


def _blocks(queries: DataFrame, candidates: DataFrame, need: Column, found: str, local: Callable, metric: str, block_rows: int, query_rows: int, pivots: int) -> DataFrame | None:
    """What `local` finds for queries (id, x, c, want) in the blocks of candidates (near_id, x, c), in two passes; an answer is whole for now with `need` rows of distances. None: nothing to search."""
    spark = queries.sparkSession
    candidates = materialised(candidates)
    n = candidates.count()
    if not n:
        return None
    blocks = min(pivots, -(-n // block_rows))
    few = candidates.where(F.pmod(F.xxhash64("near_id", "x", "c"), F.lit(max(1, n // (SAMPLED * blocks)))) == 0).select("x", "c").toArrow()  # about SAMPLED rows a leaf
    tree = Tree(*_arrays(few), max(SAMPLED, -(-len(few) // blocks)) if blocks > 1 else n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.place(*_arrays(batch)))], names=[*batch.schema.names, "region"])

    placed = lambda df: materialised(df.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", region int"))
    rows, asked = placed(candidates), placed(queries)
    width = [len(few["x"][0]) if len(few) else 0, len(few["c"][0]) if len(few) else 0]
    if not len(few):  # a small table may have no sampled row
        one = candidates.first()
        width = [len(one["x"]), len(one["c"])]
    v, h = (lambda j: F.col("x")[j]), (lambda j: F.col("c")[j])
    known = lambda j: F.when(~F.isnan(v(j)), v(j))
    ends = [e for j in range(width[0]) for e in (F.min(known(j)).alias(f"lo{j}"), F.max(known(j)).alias(f"hi{j}"), F.max(F.isnan(v(j))).alias(f"gone{j}"))]
    ends += [e for j in range(width[1]) for e in (F.min(h(j)).alias(f"first{j}"), F.max(h(j)).alias(f"last{j}"))]
    sizes = rows.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).cast("int").alias("parts"), *ends).toArrow().to_pydict()  # a row a leaf
    regions = np.array(sizes["region"], dtype=np.int32)
    column = lambda name, m, kind, none=0: np.array([[none if e is None else e for e in sizes[f"{name}{j}"]] for j in range(m)], dtype=kind).reshape(m, len(regions)).T
    boxes = Boxes(column("lo", width[0], float, np.inf), column("hi", width[0], float, -np.inf), column("gone", width[0], bool), column("first", width[1], np.int64), column("last", width[1], np.int64))
    parts = F.broadcast(spark.createDataFrame(list(zip(sizes["region"], sizes["parts"], strict=True)), "region int, parts int"))
    rows = rows.join(parts, "region").select("region", F.pmod(F.xxhash64("near_id"), "parts").cast("int").alias("part"), "near_id", F.col("x").alias("sx"), F.col("c").alias("sc"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                near = boxes.bounds(*_arrays(batch), metric)
                at, to = np.nonzero(near <= batch["most"].to_numpy()[:, None] + SLACK)
                sent = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(regions[to])], names=[*sent.schema.names, "to"])

    def search(routed: DataFrame) -> DataFrame:
        """Queries (id, x, c, want, most, region, part), dealt in groups of bounded size per block."""
        names = ["region", "part", "group"]
        groups = F.broadcast(routed.groupBy("region", "part").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("groups")))  # a row a block
        dealt = routed.join(groups, ["region", "part"]).withColumn("group", F.pmod(F.xxhash64("id"), "groups").cast("int")).drop("groups")
        sent = rows.join(groups, ["region", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return kind.empty_table()
            q, what, d = local(left, *_arrays(left, "sx", "sc"), *_arrays(right), right["want"].to_numpy(), right["most"].to_numpy())
            return pa.Table.from_arrays([right["id"].take(pa.array(q)).combine_chunks(), what, pa.array(d)], schema=kind)

        id_type = dealt.schema["id"].dataType
        kind = spark.createDataFrame([], f"id {id_type.simpleString()}, {found}, distance double").limit(0).toArrow().schema
        return materialised(sent.groupBy(*names).cogroup(dealt.groupBy(*names)).applyInArrow(run, f"id {id_type.simpleString()}, {found}, distance double"))

    far = float("inf")
    some = search(asked.where(F.col("region").isin(regions.tolist())).withColumn("most", F.lit(far)).withColumn("part", F.lit(0)))
    best = some.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
    more = asked.join(best, "id", "left").withColumn("most", F.when(F.col("n") >= need, F.col("d")).otherwise(F.lit(far))).drop("n", "d")
    more = more.mapInArrow(route, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in more.schema) + ", to int").withColumnRenamed("region", "home").withColumnRenamed("to", "region")
    more = more.join(parts, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where((F.col("home") != F.col("region")) | (F.col("part") > 0)).drop("parts", "home")
    return some.unionByName(search(materialised(more)))


def join(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "gower", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """id, rank, near_id, distance: the k nearest candidates of each query, both sides from `encode`. Ids are unique on each side."""
    first = F.row_number().over(Window.partitionBy("x", "c").orderBy("id"))
    kept = candidates.withColumn("n", first).where(F.col("n") <= k).select(F.col("id").alias("near_id"), "x", "c")
    id_type, near_type = queries.schema["id"].dataType.simpleString(), candidates.schema["id"].dataType.simpleString()

    def local(left, sx, sc, qx, qc, wanted, most):
        order = np.unique(left["near_id"].to_numpy(), return_inverse=True)[1]
        q, s, d = nearest(qx, qc, sx, sc, order, k, most, metric)
        return q, left["near_id"].take(pa.array(s)).combine_chunks(), d

    found = _blocks(queries.select("id", "x", "c", F.lit(0).cast("long").alias("want")), kept, F.lit(k), f"near_id {near_type}", local, metric, block_rows, query_rows, pivots)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"id {id_type}, rank int, near_id {near_type}, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "near_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "near_id", "distance")


def nearest_of_parts(queries: DataFrame, candidates: DataFrame, metric: str = "gower", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """id, part, distance: from each query to the nearest candidate of every part it wants and that has one.

    Both sides from `encode`; the bits of the long columns `want` and `mask` are the parts that a query wants and that a candidate belongs to. Candidates
    that are alike count as one in all their parts, and one search of the blocks serves all parts."""
    alike = candidates.groupBy("x", "c").agg(F.bit_or("mask").alias("near_id"))

    def local(left, sx, sc, qx, qc, wanted, most):
        q, part, d = least(qx, qc, wanted, sx, sc, left["near_id"].to_numpy(), most, metric)
        return q, pa.array(part.astype(np.int32)), d

    found = _blocks(queries.select("id", "x", "c", "want").where("want <> 0"), alike, F.bit_count("want"), "part int", local, metric, block_rows, query_rows, pivots)
    if found is None:
        return queries.select("id", F.lit(0).alias("part"), F.lit(0.0).alias("distance")).limit(0)
    return found.groupBy("id", "part").agg(F.min("distance").alias("distance"))


def neighbours(queries: DataFrame, candidates: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int, **sizes) -> DataFrame:
    """id, rank, near_id, distance by Gower's distance; ranges cover both sides."""
    scale = ranges([queries, candidates], numeric)
    return join(encode(queries, key, scale, categorical), encode(candidates, key, scale, categorical), k, **sizes)
