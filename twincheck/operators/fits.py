"""Fits that pass over all rows many times. Rows are stored once as blocks of numbers; in each round one Spark job sums what every open fit asks for.

A fit is a generator: it yields its parameters, is sent the sums over all rows, and returns its result. Fits in one call share the rounds, so that several cost one reading.
Fits start where a bounded sample (FIRST rows of all blocks) leads them, and end by what all rows say."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.storage import materialised

#: Rows of a block, blocks that are computed with at once, and rows of the sample that fits start from.
ROWS, JOINED, FIRST = 1000, 4, 1 << 15
#: Bytes of a row group, which a task's reader holds, and blocks of a file: small files are dealt evenly.
STORED = {"parquet.block.size": 2 << 20, "maxRecordsPerFile": 320}


def matrix(batch: pa.RecordBatch, dtype: str) -> np.ndarray:
    """Columns of numbers as rows of a matrix."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(dtype) for c in batch.columns])


def blocks(df: DataFrame, dtype: str = "<f8") -> DataFrame:
    """df's columns, all numbers, stored as matrices of up to ROWS columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([matrix(batch.slice(at, ROWS), dtype).tobytes()], pa.binary())], names=["x"])

    return materialised(df.toDF(*map(str, range(len(df.columns)))).mapInArrow(run, "x binary"), **STORED)


def opened(batches: Iterator[pa.RecordBatch], width: int, dtype: str) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, JOINED):
            yield np.concatenate([np.frombuffer(x.as_buffer(), dtype).reshape(width, -1) for x in batch.column(0)[at : at + JOINED]], axis=1)


def weights(x: np.ndarray, at: int) -> np.ndarray:
    """The weights in a block's row `at`; 1 if it has none."""
    return x[at] if len(x) > at else np.ones(x.shape[1], x.dtype)


def summed(table: DataFrame, width: int, run: Callable[[np.ndarray], np.ndarray], dtype: str = "<f8") -> np.ndarray:
    """The sum of run(block) over all blocks, JOINED at a time: a vector a task reaches the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(run(x) for x in opened(batches, width, dtype))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    return sum(np.frombuffer(r["v"]) for r in table.mapInArrow(part, "v binary").collect())


def sample(table: DataFrame, width: int, n: int, dtype: str = "<f8", first: int | None = None) -> np.ndarray:
    """About `first` of the n rows in blocks, evenly spaced; all if there are no more."""
    step = -(-n // (first or FIRST))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in opened(batches, width, dtype):
            yield pa.RecordBatch.from_arrays([pa.array([x[:, ::step].tobytes()], pa.binary())], names=["x"])

    return np.concatenate([np.frombuffer(r["x"], dtype).reshape(width, -1) for r in table.mapInArrow(part, "x binary").collect()], axis=1)


def together(fits: dict[object, Generator], ask: Callable[[dict], dict]) -> dict:
    """Result of each fit. ask: the sums that the points of all open fits ask for, in one reading."""
    points, done = {k: next(f) for k, f in fits.items()}, {}
    while points:
        sums = ask(points)
        for k in list(points):
            try:
                points[k] = fits[k].send(sums[k])
            except StopIteration as end:
                done[k] = end.value
                del points[k]
    return done


def descent(point: np.ndarray, objective: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]], rounds: int, tolerance: float, memory: int = 10) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """L-BFGS: steps downhill from a point, at most `rounds` and until ten of them gain no more than `tolerance` of the first value. objective(point, sums): value and gradient there."""
    value, slope = objective(point, (yield point))
    pairs, last, least = deque(maxlen=memory), deque([value], maxlen=10), tolerance * abs(value)
    for _ in range(rounds):
        way, used = -slope, []
        for s, y in reversed(pairs):
            a = (s @ way) / (s @ y)
            way = way - a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            way = way + (a - (y @ way) / (s @ y)) * s
        fall = slope @ way
        if not fall < 0:
            break
        size = 1.0 if pairs else min(1.0, 1 / np.sqrt(slope @ slope))
        for _ in range(10):
            to = point + size * way
            found, there = objective(to, (yield to))
            if found <= value + 1e-4 * size * fall:
                break
            size *= min(0.5, max(0.1, -0.5 * size * fall / (found - value - size * fall))) if np.isfinite(found) else 0.1
        else:
            break
        s, y = to - point, there - slope
        if s @ y > max(1e-12 * np.sqrt((s @ s) * (y @ y)), 1e-100):
            pairs.append((s, y))
        point, value, slope = to, found, there
        if max(last) - value <= least:
            break
        last.append(value)
    return point
