"""Exact top-k by inner product with M-trees.

Vectors are points in a metric space: with one more coordinate, sqrt(M^2 - |v|^2) for the largest norm M, all points lie
on one sphere, a query gets 0 there, and d(q, v)^2 = |q|^2 + M^2 - 2 q.v. The nearest points are those of highest
inner product.

The uppermost node is a table of at most `ROOTS` routing vectors, drawn by a hash. Every vector goes to the nearest one; its
region keeps a covering radius, and is cut into shards of bounded size, however many copies of a vector it holds. Each
shard is an M-tree of pages: inner pages hold routing vectors with covering radii and distances to the page's own routing
vector, leaf pages hold vectors with that distance. Search takes the page of least possible distance first and ends
when that can't reach the query's k-th best any more. |d(q, parent) - d(parent, x)| <= d(q, x) rules out entries by stored
distances, before any computation.

A query first searches one shard of its nearest region. Its k-th best score there bounds the second step, in which it visits
the shards of all regions that may hold a better or an equal one. Queries travel in blocks of bounded size.

Scores are inner products of whole numbers, exact in doubles up to 2^53 and by Python's integers beyond, cut to the range of
a long. Bounds are doubles with a margin, and rule out only what is surely lower: ties go to the smaller id.

Defined results: rows whose vector is null or holds a null, NaN or infinite component take no part. A shorter vector counts as ending
in zeros. A null id is no query; as a candidate it ranks behind others of its score. Repeated rows are rows of their own:
each finds the other, and as queries they have one list each. Fewer candidates than k give all of them. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, stored

K = 20
#: A component x counts as floor(SCALE * x).
SCALE = 64
#: Queries are the ids that this divides.
EVERY = 20
ROOTS = 1024
SHARD_BYTES = 4 << 20
#: Entries of a leaf page, and of an inner page.
LEAF, FAN = 512, 32
#: Queries that search a shard together.
BLOCK = 4096
#: Whole numbers below are exact in doubles, and in singles.
EXACT, EXACT_SMALL = float(1 << 53), float(1 << 24)
NO_ID = (1 << 63) - 1


class Sphere:
    """Distances between vectors of norm `most` at most, after one more coordinate has put them on a sphere."""

    def __init__(self, most: float):
        self.square = most

    def last(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - np.einsum("ij,ij->i", v, v), 0))

    def between(self, v: np.ndarray, last: np.ndarray, c: np.ndarray, c_last: float) -> np.ndarray:
        """From each of v to c."""
        gap = v - c
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (last - c_last) ** 2)

    def query(self, dots: np.ndarray, norm: float) -> np.ndarray:
        """From a query of squared norm `norm` to points with these inner products."""
        return np.sqrt(np.maximum(norm + self.square - 2 * dots, 0))

    def reach(self, least: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The distance up to which an inner product of `least` may lie, with a margin for rounding."""
        out = np.sqrt(np.maximum((norm + self.square) * (1 + 2e-7) + 0.5 - 2 * np.asarray(least, dtype=float), 0))
        return np.where(np.isnan(out), np.inf, out)  # squares beyond a double's range rule nothing out


class Tree:
    """Vectors with ids and how often each row occurs, below one routing vector.

    A page is (distances to its routing vector, first and end row of a leaf, centres, covering radii, pages below)."""

    @np.errstate(over="ignore", invalid="ignore")
    def __init__(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray, sphere: Sphere, leaf: int = LEAF, fan: int = FAN):
        self.vectors, self.sphere = vectors, sphere
        self.most = float(np.abs(vectors).max(initial=0))
        last = sphere.last(vectors)
        self.centre = vectors[0]
        distance = sphere.between(vectors, last, vectors[0], last[0])
        self.radius = float(distance.max())
        self.pages: list = [None]
        order, placed = [], 0
        todo = [(0, np.arange(len(ids)), distance)]
        while todo:
            at, rows, parent = todo.pop()
            if len(rows) <= leaf:
                self.pages[at] = (parent, placed, placed + len(rows), None, None, None)
                order.append(rows)
                placed += len(rows)
                continue
            chosen, own, near = self._split(rows, parent, last, min(fan, -(-len(rows) // leaf)))
            cuts = [np.flatnonzero(own == i) for i in range(len(chosen))]
            below = np.arange(len(cuts)) + len(self.pages)
            self.pages += [None] * len(cuts)
            self.pages[at] = (parent[chosen], -1, -1, vectors[rows[chosen]], np.array([near[c].max() for c in cuts]), below)
            todo += [(b, rows[c], near[c]) for b, c in zip(below.tolist(), cuts, strict=True)]
        order = np.concatenate(order)  # the rows of a leaf side by side
        self.ids, self.times, self.vectors = ids[order], times[order], vectors[order]
        self.by_id = np.argsort(self.ids, kind="stable")
        if self.most * self.most * vectors.shape[1] < EXACT_SMALL:
            self.vectors = self.vectors.astype(np.float32)

    def _split(self, rows: np.ndarray, parent: np.ndarray, last: np.ndarray, n: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Up to n of `rows` as routing vectors, the one each row goes to, and its distance: each next one is the farthest from those before."""
        chosen = [int(parent.argmax())]
        near, own = np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int64)
        while True:
            c = rows[chosen[-1]]
            d = self.sphere.between(self.vectors[rows], last[rows], self.vectors[c], last[c])
            own[d < near] = len(chosen) - 1
            near = np.minimum(near, d)
            if len(chosen) == n or near.max() == 0:
                break
            chosen.append(int(near.argmax()))
        if not np.bincount(own, minlength=2)[: max(2, len(chosen))].all():  # equal vectors only, or distances beyond a double's range: pages of one size
            cuts = np.array_split(np.arange(len(rows)), n)
            chosen, own = [int(c[0]) for c in cuts], np.repeat(np.arange(n), [len(c) for c in cuts])
            near = near if near.max() == 0 else np.full(len(rows), np.inf)
        return chosen, own, near

    def dots(self, v: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
        """Inner products as whole numbers."""
        if exact:
            return v @ q
        whole = [int(x) for x in q.tolist()]
        return np.array([max(-NO_ID - 1, min(NO_ID, sum(a * int(b) for a, b in zip(whole, x, strict=True)))) for x in v.tolist()], dtype=np.int64)

    def own(self, id_: int, q: np.ndarray) -> int:
        """The row that is the query itself, or -1."""
        i, j = np.searchsorted(self.ids, [id_, id_ + 1], sorter=self.by_id) if id_ < NO_ID else (0, 0)
        rows = self.by_id[i:j]
        same = rows[(self.vectors[rows] == q).all(axis=1)]
        return int(same[0]) if len(same) else -1

    @np.errstate(over="ignore", invalid="ignore")
    def search(self, q: np.ndarray, k: int, least: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and rows of the k best entries of at least `least`, and how many distances that took. Row `skip` is left out."""
        norm, top = float(q @ q), float(np.abs(q).max(initial=0))
        exact = top * self.most * len(q) < EXACT
        small = q.astype(np.float32) if self.vectors.dtype == np.float32 and top * self.most * len(q) < EXACT_SMALL else q
        best, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        done, count = 1, 0
        d0 = float(self.sphere.query(self.centre @ q, norm))
        heap = [(max(0.0, d0 - self.radius), 0, d0, 0)]
        reach = float(self.sphere.reach(least, norm))
        while heap:
            low, _, d, at = heapq.heappop(heap)
            if low > reach:
                break
            parent, first, end, centres, radii, below = self.pages[at]
            if centres is None:
                near = np.abs(parent - d) <= reach if reach < np.inf else None
                if near is None or near.all():
                    rows, v = None, self.vectors[first:end]
                else:
                    rows = np.flatnonzero(near) + first
                    v = self.vectors[rows]
                done += len(v)
                score = self.dots(v, small, exact)
                fit = np.flatnonzero(score >= least)
                if not len(fit):
                    continue
                score = score[fit].astype(np.int64)
                fit = fit + first if rows is None else rows[fit]
                if skip >= 0 and (fit == skip).any():
                    score, fit = score[fit != skip], fit[fit != skip]
                best, held = np.concatenate([best, score]), np.concatenate([held, fit])
                if len(best) >= k:
                    order = np.lexsort((self.ids[held], -best))[:k]
                    best, held = best[order], held[order]
                    if best[-1] > least:
                        least = int(best[-1])
                        reach = float(self.sphere.reach(least, norm))
                continue
            seen = np.flatnonzero(~(np.abs(d - parent) - radii > reach))
            done += len(seen)
            away = self.sphere.query(centres[seen] @ q, norm)
            nearest = np.fmax(away - radii[seen], 0)
            fits = np.flatnonzero(~(nearest > reach))
            for i, a, b in zip(below[seen[fits]].tolist(), nearest[fits].tolist(), away[fits].tolist(), strict=True):
                count += 1
                heapq.heappush(heap, (a, count, b, i))
        return best, held, done


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a column of packed vectors."""
    data, _ = buffers(column)
    return np.frombuffer(data.tobytes(), dtype=np.float64).reshape(len(column), dim)


def entries(vectors: DataFrame) -> tuple[DataFrame, int, int, float]:
    """id, vector (packed whole numbers as doubles) and times of the different valid rows; their number, dimension and largest squared norm."""
    x = F.col("embedding")
    own = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), x.cast("array<double>").alias("embedding"))
    own = own.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    dim = own.agg(F.max(F.size("embedding"))).first()[0]
    if dim is None:
        return own, 0, 0, 0.0
    dim = max(1, dim)

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            flat = np.floor(SCALE * lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]) + 0.0  # no negative zero
            wide = np.zeros((len(lists), dim))
            wide[np.arange(dim) < np.diff(at)[:, None]] = flat
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((np.arange(len(lists) + 1) * (8 * dim)).astype(np.int32)), pa.py_buffer(wide.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(np.einsum("ij,ij->i", wide, wide))], names=["id", "vector", "norm"])

    rows = stored(own.mapInArrow(pack, "id long, vector binary, norm double").groupBy("id", "vector").agg(F.count(F.lit(1)).alias("times"), F.first("norm").alias("norm")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).first()
    return rows.drop("norm"), size["n"], dim, size["most"]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, shard_rows: int | None = None, roots: int = ROOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest inner products of each row of vectors(vec_id, embedding) whose id `every` divides."""
    spark = vectors.sparkSession
    rows, n, dim, most = entries(vectors)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = shard_rows or max(LEAF, min(8192, SHARD_BYTES // (8 * dim)))
    sphere = Sphere(most)

    few = rows.orderBy(F.xxhash64("id", "vector"), "id", "vector").limit(min(roots, max(1, SHARD_BYTES // (8 * dim)), -(-n // size))).select("vector").collect()  # `roots` rows and SHARD_BYTES at most
    centres = np.unique(np.array([np.frombuffer(r["vector"]) for r in few]), axis=0)
    last = sphere.last(centres)

    def assign(batches):
        for batch in batches:
            v = matrix(batch.column(1), dim)
            region, distance = np.zeros(len(v), dtype=np.int32), np.zeros(len(v))
            for i in range(0, len(v), 1024):
                own = v[i : i + 1024]
                region[i : i + 1024] = (own @ centres.T + sphere.last(own)[:, None] * last).argmax(axis=1)
                near = region[i : i + 1024]
                gap = own - centres[near]
                distance[i : i + 1024] = np.sqrt(np.einsum("ij,ij->i", gap, gap) + (sphere.last(own) - last[near]) ** 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(distance)], names=["id", "vector", "times", "region", "distance"])

    placed = stored(rows.select("id", "vector", "times").mapInArrow(assign, "id long, vector binary, times long, region int, distance double"))
    regions = placed.groupBy("region").agg(F.max("distance").alias("radius"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts")).orderBy("region").toPandas()  # one row a routing vector
    centres, radii = centres[regions["region"]], regions["radius"].to_numpy()
    parts = F.broadcast(spark.createDataFrame(regions[["region", "parts"]].to_numpy().tolist(), "region int, parts int"))
    dealt = placed.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("vector", "id"), F.col("parts")).cast("int"))

    def build(own: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        tree = Tree(own["id"].to_numpy(), own["times"].to_numpy(), matrix(own["vector"], dim), sphere)
        return pa.table({"region": own["region"][:1].cast(pa.int32()), "part": own["part"][:1].cast(pa.int32()), "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    trees = stored(dealt.groupBy("region", "part").applyInArrow(build, "region int, part int, tree binary"))

    asked = rows.where(F.col("id") % every == 0).where(F.col("id") != NO_ID).withColumnRenamed("times", "copies")
    asked = asked.withColumn("key", F.unhex(F.md5("vector"))).withColumn("block", F.pmod(F.xxhash64("vector", "id"), F.lit(max(1, -(-n // (every * block))))).cast("int"))
    kind = "id long, key binary, block int, copies long, vector binary, least long, region int"

    def route(first: bool):
        """To the nearest region; or to all that may hold a score of `least`, the nearest one too."""

        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                q = matrix(batch.column(4), dim)
                dots, norms = q @ centres.T, np.einsum("ij,ij->i", q, q)
                home = dots.argmax(axis=1)
                if first:
                    at, to = np.arange(len(q)), home
                else:
                    nearest = sphere.query(dots, norms[:, None]) - radii
                    at, to = np.nonzero(~(nearest > sphere.reach(batch.column(5).to_numpy(), norms)[:, None]))
                whole = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(regions["region"].to_numpy()[to].astype(np.int32)), pa.array(to == home[at])], names=[*whole.schema.names, "region", "home"])

        return run

    def search(routed: DataFrame) -> DataFrame:
        names = ["region", "part", "block"]
        routed = stored(routed.select("id", "key", "copies", "vector", "least", *names))
        wanted = trees.join(routed.select(*names).distinct().toDF(*names), ["region", "part"]).select(*names, "tree")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {c: [] for c in ("at", "vec_id", "times", "score")}
            if left.num_rows and right.num_rows:
                right = right.combine_chunks()
                tree = pickle.loads(left["tree"][0].as_py())
                for i, (id_, q, least) in enumerate(zip(right["id"].to_pylist(), matrix(right["vector"], dim), right["least"].to_pylist(), strict=True)):
                    own = tree.own(id_, q)
                    score, held, _ = tree.search(q, k, least, own if own >= 0 and tree.times[own] == 1 else -1)
                    out["at"].append(np.full(len(held), i))
                    out["vec_id"].append(tree.ids[held])
                    out["times"].append(tree.times[held] - (held == own))
                    out["score"].append(score)
            flat = {c: np.concatenate([np.zeros(0, dtype=np.int64), *x]) for c, x in out.items()}
            asked_ = right.select(["id", "key", "copies"]).take(pa.array(flat.pop("at")))
            return pa.table({"id": asked_["id"], "key": asked_["key"], "copies": asked_["copies"], **flat})

        return stored(wanted.groupBy(*names).cogroup(routed.groupBy(*names)).applyInArrow(run, "id long, key binary, copies long, vec_id long, times long, score long"))

    columns = ["id", "key", "block", "copies", "vector", "least"]
    start = asked.withColumn("least", F.lit(-NO_ID - 1)).select(*columns).mapInArrow(route(True), f"{kind}, home boolean").withColumn("part", F.lit(0))
    some = search(start)
    bound = some.groupBy("id", "key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-NO_ID - 1)).alias("least"))
    further = asked.join(bound, ["id", "key"], "left").withColumn("least", F.coalesce("least", F.lit(-NO_ID - 1))).select(*columns).mapInArrow(route(False), f"{kind}, home boolean")
    further = further.join(parts, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(~F.col("home") | (F.col("part") > 0))
    found = some.unionByName(search(further))

    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))))
    rank = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.desc("score"), "vec_id"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k)
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return best.select(F.col("id").alias("query_id"), "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
