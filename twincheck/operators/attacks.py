"""Privacy attacks over all rows: singling out, linking, inferring and telling members, with intervals and guessing baselines.

Every attack answers with how many attacks it made, how many succeeded, the success rate's Wilson interval, the rate that guessing
reaches, and the risk: the share of what guessing leaves open that the attack gains.

Draws are by md5 of a seed and an id, so that a run can be repeated, by another engine too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clip01
from ..plans.storage import materialised
from . import frequency as fq
from . import neighbours as nb

#: Attacks of a kind: the driver holds as many predicates.
ATTACKS = 1000
EVERY, NEAR, SHADOWS = 20, 10, 10
TOLERANCE = 0.05
#: The two-sided 95 % point of the normal distribution.
Z = 1.959963984540054

_TERMS = "terms array<struct<column: string, op: string, number: double, word: string>>"


def wilson(successes: Column, attacks: Column) -> tuple[Column, Column]:
    """Ends of the Wilson score interval; null without attacks."""
    n, x = attacks.cast("double"), successes.cast("double")
    middle = F.try_divide(x + Z * Z / 2, n + Z * Z)
    half = Z / (n + Z * Z) * F.sqrt(F.greatest(F.try_divide(x * (n - x), n), F.lit(0.0)) + Z * Z / 4)
    return tuple(F.when(n > 0, clip01(e)) for e in (middle - half, middle + half))


def outcome(counts: DataFrame, *names: str) -> DataFrame:
    """names, attacks, successes, rate, low, high, baseline and risk from (names, attacks, successes, baseline)."""
    low, high = wilson(F.col("successes"), F.col("attacks"))
    rate = F.try_divide(F.col("successes"), F.col("attacks"))
    gain = F.when(F.col("baseline") >= 1, 0.0).otherwise(clip01((rate - F.col("baseline")) / (1 - F.col("baseline"))))
    risk = F.when(F.col("attacks") > 0, gain)  # null: nothing was tried
    return counts.select(*names, "attacks", "successes", rate.alias("rate"), low.alias("low"), high.alias("high"), "baseline", risk.alias("risk"))


def number(c: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def drawn(*parts) -> Column:
    """32 hexadecimal digits by which rows are drawn."""
    return F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def share(digest: Column, n: int) -> Column:
    """A number below n from the first digits."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")


def _cells(df: DataFrame, key: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """id, column, number, word: a row per cell, one of the two null."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cell = [F.struct(F.lit(c).alias("column"), number(c).alias("number"), text.alias("word")) for c in numeric]
    cell += [F.struct(F.lit(c).alias("column"), none.alias("number"), F.col(f"`{c}`").cast("string").alias("word")) for c in categorical]
    return df.select(F.col(f"`{key}`").cast("string").alias("id"), F.inline(F.array(*cell)))


def _equal() -> Column:
    return F.when(F.col("number").isNull() & F.col("word").isNull(), "null").otherwise("=")


def rare_values(synth: DataFrame, key: str, numeric: list[str], categorical: list[str], n: int = ATTACKS, seed: int = 0) -> DataFrame:
    """pid and terms of at most n drawn predicates on one column: values that one synthetic row has alone, and tails beyond the ends."""
    cells = _cells(synth, key, numeric, categorical)
    alone = cells.groupBy("column", "number", "word").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("column", _equal().alias("op"), "number", "word", "id")
    ends = cells.where("number IS NOT NULL").groupBy("column").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    tails = ends.select("column", F.inline(F.array(F.struct(F.lit("<=").alias("op"), F.col("lo").alias("number")), F.struct(F.lit(">=").alias("op"), F.col("hi").alias("number")))))
    tails = tails.select("column", "op", "number", F.lit(None).cast("string").alias("word"), F.lit("").alias("id"))
    every = alone.unionByName(tails).withColumn("pid", drawn(seed, F.col("column"), F.col("op"), F.col("id")))
    return every.orderBy("pid").limit(n).select("pid", F.array(F.struct("column", "op", "number", "word")).alias("terms"))


def medians(df: DataFrame, numeric: list[str]) -> dict[str, float]:
    """The lower median of each column, exact, from cumulative counts."""
    if not numeric:
        return {}
    cumulative = fq.ordered(fq.frequency(df, df.limit(0), numeric))
    got = cumulative.where(2 * F.col("cum_real") >= F.col("total_real")).groupBy("column").agg(F.min("value").alias("m")).collect()  # one row a column
    return {r["column"]: r["m"] for r in got}


def conjunctions(synth: DataFrame, key: str, numeric: list[str], categorical: list[str], n: int = ATTACKS, most: int = 3, seed: int = 0) -> DataFrame:
    """pid and terms of predicates from n drawn synthetic rows: `most` drawn columns each, numbers bounded on the side of the median away from it."""
    middle = medians(synth, numeric)
    rows = synth.orderBy(drawn(seed, "row", F.col(f"`{key}`"))).limit(n)
    m = F.coalesce(*(F.when(F.col("column") == c, F.lit(v)) for c, v in middle.items()), F.lit(None).cast("double"))
    terms = _cells(rows, key, numeric, categorical).withColumn("op", F.when(F.col("number") > m, ">=").when(F.col("number").isNotNull(), "<=").otherwise(_equal()))
    placed = terms.withColumn("by", drawn(seed, F.col("id"), F.col("column"))).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("by", "column", "op", "number", "word"))), 1, most).alias("t"))  # one row's columns
    return placed.select(drawn(seed, "conjunction", F.col("id")).alias("pid"), F.transform("t", lambda x: F.struct(x["column"], x["op"], x["number"], x["word"])).alias("terms"))


def guesses(synth: DataFrame, key: str, numeric: list[str], categorical: list[str], n: int = ATTACKS, seed: int = 0) -> DataFrame:
    """pid and terms of n predicates of a drawn column, comparison and row's value: what an attack must beat."""
    columns = [*numeric, *categorical]
    rows = synth.orderBy(drawn(seed, "guess", F.col(f"`{key}`"))).limit(n)
    cells = _cells(rows, key, numeric, categorical)
    chosen = F.element_at(F.array(*map(F.lit, columns)), share(drawn(seed, "column", F.col("id")), len(columns)) + 1)
    op = F.when(F.col("number").isNull(), _equal()).otherwise(F.element_at(F.array(F.lit("="), F.lit("<="), F.lit(">=")), share(drawn(seed, "op", F.col("id")), 3) + 1))
    return cells.where(F.col("column") == chosen).select(drawn(seed, "guess", F.col("id")).alias("pid"), F.array(F.struct("column", op.alias("op"), "number", "word")).alias("terms"))


class Index:
    """For each column, its cells and a row of bits in each: the predicates that a value in the cell leaves open.

    Numbers fall into the thresholds and the gaps between them, words onto the words named or none of them, and a missing value has a
    cell of its own. The and of a row's cells over the columns is the predicates that the row meets."""

    def __init__(self, predicates: list[list], numeric: list[str]):
        self.n = len(predicates)
        self.columns: list[tuple[str, bool, object, np.ndarray]] = []
        by: dict[str, list] = {}
        for p, terms in enumerate(predicates):
            for column, op, value, word in terms:
                by.setdefault(column, []).append((p, op, value, word))
        for column, terms in by.items():
            numbers = column in numeric
            keys = np.unique([v for _, _, v, _ in terms if v is not None]) if numbers else sorted({w for *_, w in terms if w is not None})
            size = 2 * len(keys) + 2 if numbers else len(keys) + 2  # the last one: missing
            held = np.ones((size, -(-self.n // 64) * 64), dtype=bool)
            cell = np.arange(size)
            for p, op, value, word in terms:
                if op == "null":
                    held[:, p] &= cell == size - 1
                    continue
                at = 2 * int(np.searchsorted(keys, value)) + 1 if numbers else keys.index(word) + 1
                held[:, p] &= (cell == at if op == "=" else cell <= at if op == "<=" else cell >= at) & (cell < size - 1)
            self.columns.append((column, numbers, keys, np.packbits(held, axis=1, bitorder="little").view(np.uint64)))

    def counts(self, batch: pa.RecordBatch) -> np.ndarray:
        """How many rows of the batch meet each predicate."""
        total = np.zeros(self.n, dtype=np.int64)
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            met = None
            for column, numbers, keys, bits in self.columns:
                values = part.column(column)
                if numbers:
                    x = values.to_numpy(zero_copy_only=False).astype(float)
                    at = np.searchsorted(keys, x)
                    cell = 2 * at + (np.append(keys, np.inf)[at] == x)
                    cell[np.isnan(x)] = len(bits) - 1
                    cell[x == np.inf] = 2 * at[x == np.inf] + (len(keys) > 0 and keys[-1] == np.inf)
                else:
                    cell = pc.fill_null(pc.index_in(values, value_set=pa.array(keys, pa.string())), -1).to_numpy() + 1
                    cell[values.is_null().to_numpy(zero_copy_only=False)] = len(bits) - 1
                met = bits[cell] if met is None else met & bits[cell]
            if met is not None:
                total += np.unpackbits(met.view(np.uint8), axis=1, bitorder="little")[:, : self.n].sum(axis=0, dtype=np.int64)
            else:
                total += part.num_rows
        return total


def count_matches(df: DataFrame, predicates: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """predicates with `matches`, the rows of df that meet all terms. One pass over df; the predicates, drawn and so few, are indexed on the driver."""
    few = predicates.select("pid", "terms").collect()  # ATTACKS rows by default
    index = Index([r["terms"] for r in few], numeric)
    held = df.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        total = np.zeros(held.value.n, dtype=np.int64)
        for batch in batches:
            total += held.value.counts(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["p", "n"])

    columns = [number(c).alias(c) for c in numeric] + [F.col(f"`{c}`").cast("string").alias(c) for c in categorical]
    got = df.select(*columns).mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("matches"))
    own = df.sparkSession.createDataFrame([(i, r["pid"], r["terms"]) for i, r in enumerate(few)], f"p long, pid string, {_TERMS}")
    return own.join(got, "p", "left").select("pid", "terms", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"))


def singling_out(real: DataFrame, synth: DataFrame, key: str, numeric: list[str], categorical: list[str], n: int = ATTACKS, most: int = 3, seed: int = 0) -> DataFrame:
    """A row for predicates on one column and one for conjunctions: do predicates that fit one synthetic row fit exactly one real row?"""
    kinds = [d.withColumn("mode", F.lit(m)) for m, d in (("univariate", rare_values(synth, key, numeric, categorical, n, seed)), ("multivariate", conjunctions(synth, key, numeric, categorical, n, most, seed)), ("guess", guesses(synth, key, numeric, categorical, n, seed)))]
    both = materialised(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("pid", F.concat_ws(" ", "mode", "pid")))
    alone = count_matches(synth, both.where("mode = 'multivariate'"), numeric, categorical).where("matches = 1").select("pid")
    used = both.where("mode <> 'multivariate'").unionByName(both.join(alone, "pid", "left_semi"))
    tried = count_matches(real, used, numeric, categorical).groupBy(F.substring_index("pid", " ", 1).alias("mode")).agg(F.count(F.lit(1)).alias("attacks"), F.count_if(F.col("matches") == 1).alias("successes"))
    tried = tried.groupBy().pivot("mode", ["univariate", "multivariate", "guess"]).agg(F.first("attacks").alias("a"), F.first("successes").alias("s"))
    base = F.coalesce(F.try_divide("guess_s", "guess_a"), F.lit(0.0))
    rows = [F.struct(F.lit(m).alias("mode"), F.coalesce(F.col(f"{m}_a"), F.lit(0)).alias("attacks"), F.coalesce(F.col(f"{m}_s"), F.lit(0)).alias("successes"), base.alias("baseline")) for m in ("univariate", "multivariate")]
    return outcome(tried.select(F.inline(F.array(*rows))), "mode")


def linkability(real: DataFrame, synth: DataFrame, key: str, left: tuple[list[str], list[str]], right: tuple[list[str], list[str]], k: int = NEAR, every: int = EVERY, **sizes) -> DataFrame:
    """One row: are the k nearest synthetic rows of a real one, by the columns `left` and by the columns `right` (numeric, categorical), the same for one at least?

    Attacks are the real rows whose key `every` divides. Guessing draws k rows twice."""
    targets = real.where(F.col(f"`{key}`") % every == 0)
    a, b = (nb.neighbours(targets, synth, key, *columns, k, **sizes) for columns in (left, right))
    linked = a.select("id", "near_id").join(b.select("id", "near_id"), ["id", "near_id"]).agg(F.count_distinct("id").alias("successes"))
    n = F.col("n")
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * F.greatest(n - k - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    counts = targets.agg(F.count(F.lit(1)).alias("attacks")).join(linked).join(synth.agg(F.count(F.lit(1)).alias("n")))  # one row each
    return outcome(counts.select("attacks", "successes", (1 - miss).alias("baseline")))


def default_secrets(columns: list[str]) -> list[str]:
    """Without a choice, the last three columns."""
    return columns[-3:]


def inference(real: DataFrame, synth: DataFrame, key: str, numeric: list[str], categorical: list[str], secrets: list[str] | None = None, k: int = NEAR, every: int = EVERY, tolerance: float = TOLERANCE, **sizes) -> DataFrame:
    """A row per secret column: does the vote of a real row's k nearest synthetic rows, by the other columns, tell its secret?

    Neighbours weigh 1 - distance. The heaviest category wins, ties go to the smaller one; a number is their mean and right within `tolerance`
    of the true value. Guessing always says the synthetic side's most frequent category, or its mean. Attacks are the real rows whose key
    `every` divides and whose secret isn't null."""
    secrets = default_secrets([*numeric, *categorical]) if secrets is None else secrets
    known = [[c for c in columns if c not in secrets] for columns in (numeric, categorical)]
    targets = real.where(F.col(f"`{key}`") % every == 0)
    near = materialised(nb.neighbours(targets, synth, key, *known, k, **sizes).select("id", "near_id", F.round((1 - F.col("distance")) * 1e9).cast("long").alias("weight")))
    out = None
    for c in secrets:
        value = number(c) if c in numeric else F.col(f"`{c}`").cast("string")
        theirs = synth.select(F.col(f"`{key}`").alias("near_id"), value.alias("value")).where("value IS NOT NULL")
        truth = targets.select(F.col(f"`{key}`").alias("id"), value.alias("truth")).where("truth IS NOT NULL")
        votes = near.join(theirs, "near_id")
        if c in numeric:
            said = votes.groupBy("id").agg(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum("weight")).alias("said"))
            guess = theirs.agg(F.avg("value").alias("guess"))
            right = lambda x: F.abs(F.col(x) - F.col("truth")) <= tolerance * F.abs(F.col("truth"))
        else:
            said = votes.groupBy("id", "value").agg(F.sum("weight").alias("w")).groupBy("id").agg(F.min_by("value", F.struct(-F.col("w"), F.col("value"))).alias("said"))
            guess = theirs.groupBy("value").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("guess"))
            right = lambda x: F.col(x) == F.col("truth")
        own = truth.join(said, "id", "left").join(F.broadcast(guess)).agg(F.count(F.lit(1)).alias("attacks"), F.count_if(right("said")).alias("successes"), F.coalesce(F.try_divide(F.count_if(right("guess")), F.count(F.lit(1))), F.lit(0.0)).alias("baseline"))  # guess: one row
        own = own.withColumn("secret", F.lit(c))
        out = own if out is None else out.unionByName(own)
    return outcome(out, "secret")


def membership(members: DataFrame, others: DataFrame, synth: DataFrame, key: str, numeric: list[str], categorical: list[str], shadows: int = SHADOWS, seed: int = 0, **sizes) -> DataFrame:
    """One row: do members of the training data lie nearer to synthetic rows than others do, each measured by its own difficulty?

    A row's difficulty is its mean distance to the nearest row of those of `shadows` halves of all rows (drawn by md5) that it is not part of;
    its score is difficulty less the distance to the nearest synthetic row, 0 if it is part of all halves. Keys are unique over both sides.
    Areas and rates come from cumulative counts of the scores; the interval is Hanley and McNeil's."""
    if not 0 < shadows <= 32:
        raise ValueError("shadows: 1 to 32")
    everyone = members.withColumn("__member", F.lit(1)).unionByName(others.withColumn("__member", F.lit(0)))
    scale = nb.ranges([everyone, synth], numeric)
    rows = materialised(nb.encode(everyone, key, scale, categorical).withColumn("draw", drawn(seed, F.col("id"))))
    bits = lambda keep: sum((F.when(keep(F.substring("draw", i + 1, 1) < "8"), F.lit(1 << i)).otherwise(0).cast("long") for i in range(shadows)), F.lit(0).cast("long"))
    halves = nb.nearest_of_parts(rows.withColumn("want", bits(lambda x: ~x)), rows.withColumn("mask", bits(lambda x: x)), **sizes)
    difficulty = halves.groupBy("id").agg(F.avg("distance").alias("difficulty"))
    near = nb.join(rows.drop("draw"), nb.encode(synth, key, scale, categorical), 1, **sizes).select("id", "distance")
    scored = everyone.select(F.col(f"`{key}`").alias("id"), "__member").join(near, "id").join(difficulty, "id", "left").select("__member", F.round(F.coalesce(F.col("difficulty") - F.col("distance"), F.lit(0.0)), 14).alias("score"))  # a mean of at most 32 distances of nine decimals has at most 14 that matter
    scored = materialised(scored)
    c = fq.ordered(fq.frequency(scored.where("__member = 1"), scored.where("__member = 0"), ["score"]))
    n, m = F.col("total_real"), F.col("total_synth")
    tpr, fpr = (n - F.col("cum_real") + F.col("n_real")) / n, (m - F.col("cum_synth") + F.col("n_synth")) / m
    got = c.where((n > 0) & (m > 0)).agg(
        F.first(n).alias("members"), F.first(m).alias("others"),
        (F.sum(F.col("n_real") / n * ((F.col("cum_synth") - F.col("n_synth") / 2) / m))).alias("auc"),
        F.greatest(F.max(tpr - fpr), F.lit(0.0)).alias("advantage"), F.coalesce(F.max(F.when(fpr <= 0.01, tpr)), F.lit(0.0)).alias("tpr_at_fpr_001"),
    )
    a, n, m = F.col("auc"), F.col("members"), F.col("others")
    error = F.sqrt(F.greatest((a * (1 - a) + (n - 1) * (a / (2 - a) - a * a) + (m - 1) * (2 * a * a / (1 + a) - a * a)) / (n * m), F.lit(0.0)))
    return got.select(F.lit(shadows).alias("shadows"), "members", "others", "auc", *(F.when(a.isNotNull(), clip01(a + s * Z * error)).alias(e) for e, s in (("low", -1), ("high", 1))), "advantage", "tpr_at_fpr_001")


def linked_rows(real: DataFrame, synth: DataFrame, aux: DataFrame, columns: list[str], key: str, within: float = 0.5, every: int = EVERY, **sizes) -> DataFrame:
    """(linked, probes, risk): auxiliary rows whose key `every` divides and whose nearest synthetic row lies within `within` of a real row, by all rows of both sides."""
    whole = [d.select(F.col(f"`{key}`"), *(number(c).alias(c) for c in columns)).dropna() for d in (real, synth, aux)]
    spread = whole[0].agg(*(F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns))).first()
    scale = {c: 1 / ((spread[f"s{i}"] or 0.0) + 1e-8) for i, c in enumerate(columns)}
    r, s, a = (nb.encode(d, key, scale, []) for d in whole)
    near = materialised(nb.join(a.where(F.col("id") % every == 0), s, 1, "euclid", **sizes).select("id", "near_id"))
    reached = s.join(near.select(F.col("near_id").alias("id")).distinct(), "id", "left_semi")
    close = nb.join(reached, r, 1, "euclid", **sizes).where(F.col("distance") < within).select(F.col("id").alias("near_id"), F.lit(1).alias("hit"))
    return near.join(close, "near_id", "left").agg(F.count("hit").alias("linked"), F.count(F.lit(1)).alias("probes")).withColumn("risk", F.coalesce(F.try_divide("linked", "probes"), F.lit(0.0)))
