"""Exact deduplication over a log-structured merge index of digests.

Texts are equal when they agree without the bytes of `SPACE`. Every task fills memtables of at most
`MEMTABLE` digests, which already join the copies that it meets, and flushes each as a sorted run, cut
by digest range. A range's compaction takes its runs one by one: the filters of the levels below say
which digests are surely new, the others are looked up by binary search, and runs of like size are
merged, always keeping the entry with most code points, then the smallest identifier. Copies of one
text reach a range once per memtable, so a hot text is no hot range. Hits are then verified: each row
of a group of two or more is compared with the bytes of the row that stays. Rows that only share a
digest are grouped by their text instead.

Defined results: null text counts as empty, so all null, empty and blank texts are one group. A null
doc_id sorts after all others. Of repeated rows (same doc_id, same text) one is kept. Other columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored, volume

MEMTABLE = 1 << 16
#: Rows of a digest range, about.
RANGE_ROWS = 1 << 18
FILTER_BITS = 16

_NULL = np.iinfo(np.int64).max


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


class Run:
    """Sorted distinct digests with their best row (cp, id, uid) and count, and a filter of two bits per digest."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows
        self.mask = (1 << max(6, int(len(rows) * FILTER_BITS - 1).bit_length())) - 1
        self.bits = np.zeros((self.mask >> 3) + 1, dtype=np.uint8)
        self.keys = rows["digest"].to_numpy(dtype="S32") if len(rows) else np.zeros(0, dtype="S32")
        for p in self.places(self.keys):
            np.bitwise_or.at(self.bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        raw = np.frombuffer(keys.tobytes(), dtype=np.uint64).reshape(-1, 4)
        return [(raw[:, k] & np.uint64(self.mask)).astype(np.int64) for k in (1, 2)]

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """False: surely absent."""
        out = np.ones(len(keys), dtype=bool)
        for p in self.places(keys):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """One sorted run of several: most code points, then the smallest id, then the first row stays."""
    rows = pd.concat(parts, ignore_index=True).sort_values(["digest", "cp", "id", "uid"], ascending=[True, False, True, True], kind="stable")
    first = ~rows["digest"].duplicated()
    out = rows[first].reset_index(drop=True)
    out["n"] = rows["n"].groupby((first.cumsum() - 1).to_numpy()).sum().to_numpy()
    return out


def compact(runs: list[pd.DataFrame]) -> pd.DataFrame:
    """The index of one range. Levels hold distinct digests; hits update their level, misses begin a new one."""
    levels: list[Run] = []
    for run in runs:
        rest = run
        for level in levels:
            if not len(rest):
                break
            keys = rest["digest"].to_numpy(dtype="S32")
            ask = np.flatnonzero(level.maybe(keys))
            at = np.minimum(np.searchsorted(level.keys, keys[ask]), len(level.keys) - 1)
            real = level.keys[at] == keys[ask]
            ask, at = ask[real], at[real]
            if len(ask):
                both = merged([level.rows.iloc[at], rest.iloc[ask]])  # in the order of the digests, as level.rows
                order = np.sort(at)
                for c in ("cp", "id", "uid", "n"):
                    level.rows[c].to_numpy()[order] = both[c].to_numpy()
                rest = rest.drop(rest.index[ask]).reset_index(drop=True)
        if len(rest):
            fresh = [rest]
            while levels and len(levels[-1].rows) < 2 * sum(map(len, fresh)):
                fresh.append(levels.pop().rows)
            levels.append(Run(merged(fresh)))
    return pd.concat([x.rows for x in levels], ignore_index=True) if levels else pd.DataFrame()


_ENTRY = "digest binary, cp long, id long, uid long, n long"


def index(rows: DataFrame, n_rows: int, memtable: int = MEMTABLE) -> DataFrame:
    """digest, keep (cp, id, uid) and n of every digest of rows(digest, cp, id, uid)."""
    ranges = max(1, -(-n_rows // RANGE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n_rows > RANGE_ROWS else 1)

    def flush(batches):
        held: list[pd.DataFrame] = []

        def runs():
            run = merged(held)
            held.clear()
            run.insert(0, "run", int(run["uid"].min()))
            run.insert(0, "range", [int.from_bytes(x[:4], "little") % ranges for x in run["digest"]])
            return pa.RecordBatch.from_pandas(run[["range", "run", "digest", "cp", "id", "uid", "n"]], preserve_index=False)

        for batch in batches:
            for at in range(0, len(batch), memtable):
                part = batch.slice(at, memtable).to_pandas()
                part["n"] = 1
                held.append(part)
                if sum(map(len, held)) >= memtable:
                    yield runs()
        if held:
            yield runs()

    def range_index(rows: pd.DataFrame) -> pd.DataFrame:
        runs = [x.drop(columns=["range", "run"]).sort_values("digest").reset_index(drop=True) for _, x in rows.groupby("run", sort=True)]
        return compact(runs)[["digest", "cp", "id", "uid", "n"]]

    flushed = rows.select("digest", "cp", "id", "uid").mapInArrow(flush, f"range long, run long, {_ENTRY}")
    return flushed.groupBy("range").applyInPandas(range_index, _ENTRY)


def exact_groups(docs: DataFrame, digest=lambda text: F.unhex(F.sha2(text.cast("binary"), 256)), memtable: int = MEMTABLE) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, uid. digest gives 32 bytes of the normalised text."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), normalised(F.col("text")).alias("norm"))
    head = base.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"), F.length("text").cast("long").alias("cp"), digest(F.col("norm")).alias("digest"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    rows = stored(head.withColumn("uid", F.monotonically_increasing_id()))
    found = stored(index(rows, rows.count(), memtable))
    member = rows.join(found.select("digest", F.col("id").alias("keep"), F.col("uid").alias("keep_uid"), "n"), "digest")
    # byte verification of the hits: of their rows, whose bytes are not those of the row that stays?
    hits = found.where("n > 1").select("digest", "id")
    text = base.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"), digest(F.col("norm")).alias("digest"), F.col("norm"))
    staying = text.join(hits, ["digest", "id"]).groupBy("digest").agg(F.min("norm").alias("stays"))
    asked = text.join(hits.select("digest"), "digest", "left_semi")
    odd = stored(asked.join(staying, "digest").where(F.col("norm") != F.col("stays")).select("digest").distinct())
    out = member.select("doc_id", "keep", "keep_uid", "n", "text_sha256", "uid", "digest")
    if odd.isEmpty():
        split = out
    else:  # texts that only share a digest: their groups by the text itself
        own = text.join(odd, "digest").join(rows.select("digest", "id", "uid", "cp", "doc_id", "text_sha256"), ["digest", "id"]).where(F.sha2(F.col("norm").cast("binary"), 256) == F.col("text_sha256")).dropDuplicates(["uid"])
        w = Window.partitionBy("norm")
        best = F.min(F.struct(-F.col("cp"), F.col("id"), F.col("uid"))).over(w)
        own = own.select("doc_id", best["id"].alias("keep"), best["uid"].alias("keep_uid"), F.count(F.lit(1)).over(w).alias("n"), "text_sha256", "uid", "digest")
        split = out.join(odd, "digest", "left_anti").unionByName(own)
    kind = docs.schema["doc_id"].dataType
    keep = F.when(F.col("keep") != _NULL, F.col("keep")).cast(kind)
    return split.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "uid")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps, under all its columns, whatever their names.

    Of rows with one doc_id and equal texts but for white space, that with the longest text stays, of these the least by its text; of rows
    alike in both, one."""
    kept = exact_groups(docs).where("kept").select("doc_id", "text_sha256").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("sha"))
    same = F.col("row.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("sha") == F.col("k.text_sha256"))
    text = F.coalesce("row.text", F.lit(""))
    one = F.min_by("row", F.struct(-F.length(text), text, F.col("row.text").isNull()))  # each task sends one row of a group at most
    return rows.join(kept.alias("k"), same, "left_semi").groupBy(F.col("row.doc_id").alias("id"), "sha").agg(one.alias("row")).select("row.*")
