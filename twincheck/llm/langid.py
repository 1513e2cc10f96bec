"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives, from any place of a text, the longest match
that occurs in the language's sample. Cutting a text into such longest phrases is cross-parsing;
the number of phrases, times the bits that point to one, over the text's length estimates the cross-entropy,
and the language with the least wins.

The automaton's transitions fill a dense table, in which a missing transition leads to where the root goes
and carries a flag: one look-up per byte and language, for thousands of text windows at once. Windows of
`WINDOW` bytes are first parsed from the root; then each that does not begin its text is parsed again from the state
in which its predecessor ended, until no such state changes. Where phrases are about as long as windows (runs of digits, text of the
sample itself) each round moves the states of all later windows; so after `ROUNDS` rounds what is left is parsed window after window,
once. So phrases cross windows, as in a parse of the whole text, in time linear in it.

Bytes are folded to 64 classes: ASCII letters by lower case, other ASCII as space, and bytes above 127
by their value modulo 37.

Defined results: `und` with score 0 for a null text and for one without any letter; also if no labelled text
exists. A letter is a character of Unicode's letter categories. Ties go to the first language by name. Repeated
rows are predicted each on its own. Null langs and null texts teach nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, portions, remainder, text_bytes

#: Bytes of sample per language that the automaton holds.
SAMPLE_BYTES = 40_000
#: All languages' tables together, which every worker holds; with many languages each sample is shorter.
MODEL_BYTES = 256 << 20
#: Of a longer row the sample holds a stretch of so many bytes, from a place chosen by its hash.
ROW_BYTES = 4096
#: Candidate rows per language from which the sample is filled; by a hash of their ids and texts, the least always.
SAMPLE_ROWS = 256
WINDOW = 256
ROUNDS = 4
CLASSES = 64

FOLD = np.zeros(256, dtype=np.int64)
for _c in range(26):
    FOLD[ord("a") + _c] = FOLD[ord("A") + _c] = 1 + _c
FOLD[128:] = 27 + np.arange(128) % 37


def automaton(text: np.ndarray) -> np.ndarray:
    """Dense transitions of the suffix automaton of a sequence of classes: state x class, -1 where none."""
    n = 2 * len(text) + 2
    step, link, length = np.full((n, CLASSES), -1, dtype=np.int32), [-1] * n, [0] * n
    last, size = 0, 1
    for c in text.tolist():
        cur, size = size, size + 1
        length[cur] = length[last] + 1
        p = last
        while p >= 0 and step[p, c] < 0:
            step[p, c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = int(step[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy, size = size, size + 1
                length[copy] = length[p] + 1
                step[copy] = step[q]
                link[copy] = link[q]
                while p >= 0 and step[p, c] == q:
                    step[p, c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step[:size]


def parser(text: np.ndarray) -> np.ndarray:
    """Flat table: entry (state * CLASSES + class) is 2 * next state * CLASSES, plus 1 where a new phrase begins."""
    step = automaton(text)
    root = np.maximum(step[0], 0)
    gone = step < 0
    return (np.where(gone, root[None, :], step) * (2 * CLASSES) + gone).astype(np.int32).ravel()


def phrases(tables: list[np.ndarray], data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows x languages: phrases of the cross-parsing of each row."""
    size = np.diff(offsets)
    parts = -(-size // window)
    row = np.repeat(np.arange(len(size)), parts)
    first = np.concatenate([[0], np.cumsum(parts)])
    begin = offsets[row] + (np.arange(len(row)) - first[row]) * window
    long = np.minimum(window, offsets[row + 1] - begin)
    heads = np.zeros(len(row), dtype=bool)
    heads[first[:-1][parts > 0]] = True
    folded = FOLD[data]
    out = np.zeros((len(size), len(tables)))

    def parse(table: np.ndarray, which: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in the windows `which`, entered in these states, and the states at their ends."""
        order = np.argsort(-long[which], kind="stable")  # windows that end leave at the end
        at, left, state = begin[which][order], long[which][order], state[order].copy()
        count = np.zeros(len(order), dtype=np.int32)
        for i, n in enumerate(np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")):
            got = table[state[:n] + folded[at[:n] + i]]
            count[:n] += got & 1
            state[:n] = got >> 1
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return count[back], state[back]

    def walk(table: np.ndarray, stale: np.ndarray, entry: np.ndarray, count: np.ndarray, end: np.ndarray) -> None:
        """Parse from each stale window on until one is entered as it was before."""
        step, done = memoryview(table), 0
        for w in stale.tolist():
            while done <= w < len(row) and not heads[w] and end[w - 1] != entry[w]:
                entry[w] = state = int(end[w - 1])
                new = 0
                for c in folded[begin[w] : begin[w] + long[w]].tolist():
                    got = step[state + c]
                    new += got & 1
                    state = got >> 1
                count[w], end[w] = new, state
                w += 1
                done = w

    for k, table in enumerate(tables):
        entry = np.zeros(len(row), dtype=np.int64)
        count, end = parse(table, np.arange(len(row)), entry)
        for turn in range(ROUNDS + 1):
            want = np.where(heads, 0, np.concatenate([[0], end[:-1]])) if len(row) else entry
            stale = np.flatnonzero(want != entry)
            if turn == ROUNDS:
                walk(table, stale, entry, count, end)
            elif len(stale):
                entry[stale] = want[stale]
                count[stale], end[stale] = parse(table, stale, entry[stale])
            else:
                break
        out[:, k] = np.bincount(row, weights=count + heads, minlength=len(size))  # a text's first phrase needs no miss
    return out


class Model:
    """A parser per language, and the bits that point to a place in its sample."""

    def __init__(self, langs: list[str], tables: list[np.ndarray], bits: np.ndarray):
        self.langs, self.tables, self.bits = langs, tables, bits

    @classmethod
    def of(cls, langs: list[str], samples: list[bytes]) -> Model:
        texts = [FOLD[np.frombuffer(s, dtype=np.uint8)] for s in samples]
        return cls(langs, [parser(t) for t in texts], np.array([np.log2(max(2, len(t))) for t in texts]))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each row: the runner-up's share of the two best entropies' sum."""
        h = phrases(self.tables, data, offsets) * self.bits
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        if h.shape[1] > 1:
            second = np.partition(h, 1, axis=1)[:, 1]
            score = second / np.maximum(least + second, 1e-9)
        else:
            score = np.ones(len(h))
        return best, score


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES, row_bytes: int = ROW_BYTES) -> Model:
    """docs(lang, text, id): about `rows` rows of each language by a hash of id and text, of which `most` bytes. Every language with text gets a sample."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select("lang", F.col("text").cast("binary").alias("text"), F.xxhash64("id", "text").alias("h"))
    place = F.pmod("h", F.lit(1 << 30))
    counts = {r["lang"]: (r["n"], r["least"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()}
    upto = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(max(least, int(min(1.0, rows / n) * (1 << 30))))) for lang, (n, least) in sorted(counts.items())), F.lit(-1))
    first = F.pmod("h", F.greatest(F.octet_length("text") - row_bytes + 1, F.lit(1))).cast("int") + 1
    chosen = known.where(place <= upto).select("lang", F.substring("text", first, F.lit(row_bytes)).alias("text"), "h").distinct()

    most = max(1024, min(most, MODEL_BYTES // (8 * CLASSES * max(1, len(counts)))))

    def sample(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["h", "text"])
        take = own["text"][own["text"].map(len).cumsum() <= most + row_bytes]
        return pd.DataFrame({"lang": own["lang"].iloc[:1], "sample": [b"\n".join(map(bytes, take))[:most]]})

    got = chosen.groupBy("lang").applyInPandas(sample, "lang string, sample binary").toPandas().sort_values("lang")
    return Model.of(list(got["lang"]), [bytes(x) for x in got["sample"]])


def identify(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. Rows whose remainder is `held` teach nothing."""
    out = remainder(F.col("doc_id"), modulus) == held
    learned = train(docs.where(~out).select("lang", "text", F.col("doc_id").alias("id")))
    model = docs.sparkSession.sparkContext.broadcast(learned)  # MODEL_BYTES at most, up to thousands of languages

    def run(batches):
        langs = model.value.langs
        for batch in batches:
            data, at = buffers(batch.column(1))
            pred, score = [], []
            for i, j in portions(at, 1 << 21):
                part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                whole = part.tobytes()
                letters = [any(map(str.isalpha, whole[s:e].decode())) for s, e in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                if langs:
                    best, value = model.value.predict(part, own)
                    pred += [langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters, strict=True)]
                    score += [v if ok else 0.0 for v, ok in zip(value.tolist(), letters, strict=True)]
                else:
                    pred += ["und"] * (j - i)
                    score += [0.0] * (j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
