"""Peak memory of the steps that hold most of a task."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from twincheck.llm import lm, packing, toxicity
from twincheck.llm.common import prefix_hash, range_hash


def peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def some_texts(n: int, words: int) -> list[bytes]:
    rnd = random.Random(1)
    known = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(2000)]
    return [" ".join(rnd.choices(known, k=words)).encode() for _ in range(n)]


def test_lm_strings_memory():
    texts = some_texts(500, 400)
    (key, bounds), most = peak(lambda: lm.strings(texts))
    assert len(key) == bounds[-1] == sum(map(len, texts)) + len(texts)
    assert most < 24 * len(key)  # 33 with a copy of 64 bits for each byte and one for each shift


def test_lm_answers_are_not_copied_whole():
    """The words' and strings' answers of a chunk are read in batches: less is held than their rows as Python objects."""
    table = pa.table({"text": pa.array([b"Ab cd", b"", b"cd"]), "held_out": [False, True, True]})
    words, names, counts = lm.questions(table)
    assert words == {b"ab": 1, b"cd": 1} and counts.sum() == 6  # five bytes and the end of the text that teaches
    rows = 200_000
    batch = lambda word, gram, value: pa.record_batch({"word": pa.array(word, pa.binary()), "gram": pa.array(gram, pa.int64()), "value": pa.array(value, pa.float64())})
    far = [batch([b"cd"] * 10_000, [None] * 10_000, [2.0] * 10_000) for _ in range(rows // 10_000)]
    known = pa.Table.from_batches([*far, batch([None] * len(names), names.tolist(), [-1.0] * len(names))])
    (n, found, base, score), most = peak(lambda: lm.answered(table, known, 3, 4, 1))
    assert (n, found, score.tolist()) == ([3, 1, 2], [3, 1, 2], [-6.0, -1.0, -3.0])
    assert most < 20 * rows  # a list of the words alone takes over 40 bytes a row


def test_toxicity_fit_memory():
    """The driver fits the odds in arrays: with objects for each word and stem it took over 1,000 bytes a word."""
    rnd = random.Random(2)
    words = list({"".join(rnd.choices("abcdefghij", k=rnd.randint(1, 9))).encode() for _ in range(40_000)})
    toxic, clean = (np.array([rnd.randint(0, 5) for _ in words]) for _ in range(2))
    prefix_hash(np.zeros(400_000, dtype=np.uint8))  # the powers stay
    model, most = peak(lambda: toxicity.fit_odds(words, toxic, clean))
    assert most < 400 * len(words)
    base = {}  # the definition, in plain loops
    share = np.array([toxic.sum(), clean.sum()]) / (toxic.sum() + clean.sum())
    for n, keys, odds in zip((3, 4, 5, 6, None), model.keys, model.odds, strict=True):
        own = {}
        for w, a, b in zip(words, toxic, clean, strict=True):
            own[w[:n]] = own.get(w[:n], 0) + np.array([a, b], dtype=float)
        assert len(own) == len(keys) and (np.diff(keys.astype(object)) > 0).all()
        base = {s: (c + 5 * base.get(s[: n - 1] if n else s[:6], share)) / (c.sum() + 5) for s, c in own.items()}
        for s in rnd.sample(sorted(own), 50):
            p, k = base[s], own[s].sum() + 5
            gain = min(8, np.log((p[0] + 1e-9) / (p[1] + 1e-9)) - np.log((share[0] + 1e-9) / (share[1] + 1e-9))) - 3 * np.sqrt(1 / max(0.5, p[0] * k) + 1 / max(0.5, p[1] * k)) - 0.7
            h = range_hash(prefix_hash(np.frombuffer(s, dtype=np.uint8)), np.array([0]), np.array([len(s)]))[0]
            assert abs(odds[np.searchsorted(keys, h)] - max(-3, gain if gain > 0 else min(-0.1, gain))) < 1e-9


def test_driver_keeps_no_tokenizer():
    before = set(packing._held)
    assert packing.kept(public_tokenizers.path("word_bpe_49k.json")) == "<u2"
    assert set(packing._held) == before
