"""Shared pieces: training splits, text buffers, hashes of words, and rolling hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, materialised as stored  # noqa: F401

#: The white space of every contract: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(df: DataFrame, *others: str) -> DataFrame:
    """The named columns and text as bytes (null: empty). Other columns go, whatever their names."""
    return df.select(*others, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def volume(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text: one narrow aggregate, by which later steps size their partitions."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return row["n"], row["b"] or 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and its offsets (one more than rows), without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at is not None and at.size else np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes (one row at least), so that arrays over bytes stay in cache."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def lean(run: Callable, *args):
    """run(*args), after which the worker gives freed memory back: it lives on between tasks, and would keep what its largest one took."""
    out = run(*args)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
    return out


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as many as the longest portion so far needs."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << max(20, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=np.uint64))
        return cls.up, cls.down


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] the hash of data[i:j] times base^i."""
    up, _ = Powers.of(len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=h[1:])
    return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end) of the data under h."""
    _, down = Powers.of(len(h))
    return mix((h[end] - h[start]) * down[start])


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run of bytes of `inside` (by byte value) that stays in one row."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    held = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = held.copy()
    start[1:] &= ~held[:-1] | edge[1:-1]
    end = held.copy()
    end[:-1] &= ~held[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end), mixed every 8 bytes, so that no algebra of the bytes makes two alike."""
    out = (end - start).astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    live = np.arange(len(start))
    at = start.copy()
    while len(live):
        left = end[live] - at[live]
        chunk = np.zeros(len(live), dtype=np.uint64)
        for i in range(8):
            byte = padded[np.minimum(at[live] + i, len(padded) - 1)].astype(np.uint64)
            chunk |= np.where(left > i, byte, np.uint64(0)) << np.uint64(8 * i)
        out[live] = mix(out[live] * np.uint64(_BASE) + chunk + np.uint64(1))
        at[live] += 8
        live = live[left > 8]
    return out


def per_row(values: np.ndarray, bounds: np.ndarray, op=np.add) -> np.ndarray:
    """op.reduce of values between neighbouring bounds; 0 for empty rows."""
    out = np.zeros(len(bounds) - 1, dtype=values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = op.reduceat(values, bounds[:-1][full])
    return out
