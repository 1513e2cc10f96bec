"""Packing by content: neighbours meet however many shards there are."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from twincheck.llm import packing, queries


def test_shards_hold_documents_of_like_content(spark):
    path, rng, rows = public_tokenizers.path(queries.WORD_TOKENIZER), np.random.default_rng(3), []
    word = sorted(w[:-4] for w in Tokenizer.from_file(path).get_vocab() if w[:-4].isalpha() and w[:-4].isascii() and w.endswith("</w>") and len(w) > 9)[::7]
    for i in range(1200):
        topic = i % 24
        rows.append((i, " ".join(word[topic * 40 + w] if rng.random() < 0.7 else word[1000 + w] for w in rng.integers(0, 40, 60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pieces = packing.pack(docs, path, window=512, shard_bytes=60_000).collect()
    assert {p.doc_id for p in pieces} == set(range(1200))
    shards = {}
    for p in pieces:
        if p.start == 0:
            shards.setdefault(p.sequence_id >> 32, []).append(p.doc_id % 24)
    assert len(shards) >= 10
    spread = Counter(t for own in shards.values() for t in set(own))
    assert np.mean([spread[t] for t in range(24)]) < 4  # a random deal spreads each topic over all shards


def test_repeated_rows_spread_over_shards(spark):
    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    rows = [(7, "the same old row again and again and once more")] * 1500 + [(i, f"row number {i} stands on its own here") for i in range(100, 1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pieces = packing.pack(docs, path, window=512, shard_bytes=6_000).collect()
    assert sum(p.start == 0 for p in pieces) == 3000
    sizes = Counter(p.sequence_id >> 32 for p in pieces)
    repeated = Counter(p.sequence_id >> 32 for p in pieces if p.doc_id == 7 and p.start == 0)
    assert len(repeated) >= 4 and max(repeated.values()) < 600 and max(sizes.values()) < 900


def packed(docs, window):
    docs = [np.array([*d, packing.END], dtype=np.uint32) for d in docs]
    df = np.bincount(np.concatenate([np.unique(d[:-1]) for d in docs]))
    return packing.fill(docs, packing.Corpus(len(docs), sum(len(d) - 1 for d in docs), df), window)


def test_a_window_takes_every_neighbour_of_its_seed_first():
    rng = np.random.default_rng(0)
    docs = [rng.integers(100 + 100 * (i % 3), 120 + 100 * (i % 3), 19) for i in range(90)]
    first = [d % 3 for d, _, _, sequence, _ in packed(docs, 500) if sequence == 0]
    assert first == [0] * 25  # 12 neighbours would leave half of the window to the other topics


def test_every_term_of_a_seed_counts():
    docs = [[*range(100, 140), 50], [60, 61], [62, 63], [50, 64]]
    assert [d for d, *_ in packed(docs, 1000)][:2] == [0, 3]


def test_added_tokens_keep_their_ids():
    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    texts = ["a <|endoftext|> b", "x<|startoftext|>Y <|ENDOFTEXT|>", "no < | token <|", "Plain Words here", "", "<|endoftext|>"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in packing.Words(path).encode([t.encode() for t in texts])] == want
    assert 49407 in want[0] and 49406 in want[1]


def test_words_equal_whole_texts():
    """Words cut at signs and encoded many a call give the plain tokenizer's ids, whatever letters, marks and signs meet."""
    path, draw = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    parts = ["a", "B", "z", "s", "'", "'s", "'re", ".", ",", "$", "=", "<", "|", ">", "\u00e9", "e\u0301", "\u0338", "\u0130", "\u2126", "9", "\u00bd", "\u5b57", "\u2014", "\ufb01", "\u00aa", "_", "-", "\x1c", " ", " ", "\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(20_000)]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    got = packing.Words(path).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [x.ids for x in want]


def test_words_are_held_in_arrays():
    """Ids equal the tokenizer's whatever is remembered, kept or forgotten, and a word takes tens of bytes, not hundreds."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(3)
    made = ["".join(rnd.choices("abcdefgÄéß1'#", k=rnd.randint(1, 12))) for _ in range(30_000)]
    texts = [" ".join(rnd.choices(made, k=300)) for _ in range(300)] + ["", " \t", "It's <|endoftext|> x", "A.b,C'd  é f", "don't"]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    words = packing.Words(path)
    tracemalloc.start()
    assert words.encode([t.encode() for t in texts]) == want
    words.forget()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 150 * words.held.n  # as objects of a dictionary about 200
    words.held.keep(1000)
    assert words.held.n == 1000
    assert words.encode([t.encode() for t in texts]) == want
    held = packing.MEMORY
    try:
        packing.MEMORY = 500
        assert words.encode([t.encode() for t in texts]) == want
    finally:
        packing.MEMORY = held
