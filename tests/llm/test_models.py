"""The learned and scored parts against definitions by brute force."""

import functools
import math
import zlib

import numpy as np
import pytest

from twincheck.llm import langid, lm, minhash, quality, rules, suffix_dedup, toxicity


def ctw(train, texts, depth):
    """Context-tree weighting by its definition: log10 probability of each text and its end."""
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    places = lambda t: ((d[i - depth : i], d[i]) for d in [b"\0" * depth + t + b"\0"] for i in range(depth, len(d)))
    counts, kids = {}, {}
    for t in train:
        for context, byte in places(t):
            for i in range(8):
                for d in range(depth + 1):
                    counts.setdefault((context[depth - d :], (1 << i) | (byte >> (8 - i))), [0, 0])[(byte >> (7 - i)) & 1] += 1
    for c, node in counts:
        if c:
            kids.setdefault((c[1:], node), []).append((c, node))

    @functools.cache
    def weight(c, node):
        own = kt(*counts[c, node])
        return own if len(c) == depth else np.logaddexp(own, below(c, node)) - math.log(2)

    def below(c, node):
        return sum(weight(*k) for k in kids.get((c, node), []))

    def score(t):
        total = 0.0
        for context, byte in places(t):
            for i in range(8):
                node, p, left = (1 << i) | (byte >> (8 - i)), 0.0, 1.0
                for d in range(depth + 1):
                    k = (context[depth - d :], node)
                    if k not in counts:
                        p += left / 2
                        break
                    a, b = counts[k]
                    share = 1.0 if d == depth else 1 / (1 + math.exp(max(-700, min(700, below(*k) - kt(a, b)))))
                    p, left = p + left * share * (b + 0.5) / (a + b + 1), left * (1 - share)
                total += math.log10(p if (byte >> (7 - i)) & 1 else 1 - p)
        return total

    return [score(t) for t in texts]


def test_lm_score(spark):
    texts = ["the cat sat on the mat", "the cat sat on the hat", "a dog", "", None, "Été à la mer", "the the the", "zzz", "abcabcabcabc", "The cat"] * 2
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    low = [(t or "").encode().lower() for t in texts]
    want = ctw([b for i, b in enumerate(low) if zlib.crc32(str(i).encode()) % 7 != 2], low, lm.DEPTH)
    for i, w in enumerate(want):
        assert got[i].score == pytest.approx(w, abs=1e-6)
        assert got[i].bits_per_byte == pytest.approx(-w / math.log10(2) / (len(low[i]) + 1), abs=1e-6)


def test_cross_parse_is_that_of_the_whole_text():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 105, rng.integers(2, 7)).astype(np.uint8)) for _ in range(60)]
    text = lambda n: b" ".join(words[i] for i in rng.integers(0, 60, n))
    sample, docs = text(800), [b"", b"zzzz", text(3), text(700), b"a" * 5000, text(1500)]
    fold = lambda b: langid.FOLD[np.frombuffer(b, dtype=np.uint8)].astype(np.uint8).tobytes()
    held, want = fold(sample), []
    for d in map(fold, docs):
        i = n = 0
        while i < len(d):
            j = i + 1
            while j <= len(d) and d[i:j] in held:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
        want.append(n)
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = langid.phrases(langid.Model.of(["x"], [sample]).tables, np.frombuffer(b"".join(docs), dtype=np.uint8), at)
    # a byte that the sample lacks ends a phrase of its own at a text's begin, which counts once more
    assert [int(x) for x in got[:, 0]] == [w + (d[:1] == b"z") for w, d in zip(want, docs, strict=True)]


def test_und_without_letters(spark):
    rows = [(1, "½ ² Ⅳ", "en"), (2, "some words", "en"), (3, "more words", "en"), (4, "x y", "en"), (5, "12 !!", "en"), (6, None, "en")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in range(1, 7)] == ["und", "en", "en", "en", "und", "und"]


def test_maximal_segments():
    rng = np.random.default_rng(2)

    def split(scores, at):  # the definition: the best segment (leftmost, shortest), then both sides of it
        best = max(((sum(scores[i:j]), -i, -(j - i)) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[1], -best[1] - best[2]
        return split(scores[:i], at) + [(at + i, at + j)] + split(scores[j:], at + j)

    for _ in range(50):
        scores = rng.normal(-0.2, 1, 14)
        assert [(s, e) for _, s, e in toxicity.segments(scores)] == split(list(scores), 0)


def test_toxic_passages_are_those_of_few_expected():
    words = [b"foul", b"nasty", b"kind", b"table", b"chair", b"green"]
    model = toxicity.fit_odds(words, np.array([90, 80, 1, 2, 2, 2]), np.array([1, 1, 90, 95, 90, 92]))
    text = b"green table chair kind foul nasty foul nasty foul nasty green chair"
    data, at = np.frombuffer(text + b"kind table", dtype=np.uint8), np.array([0, len(text), len(text) + 10])
    found = toxicity.toxic_passages(model, data, at)
    assert [(row, text[s:e]) for row, s, e, _ in found] == [(0, b"foul nasty foul nasty foul nasty")]


def test_scores_without_labels(spark):
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(8)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def test_gradient_steps():
    rows = [(np.array([1, 2]), np.array([0.5, 0.5], dtype=np.float32)), (np.array([3]), np.array([1.0], dtype=np.float32)), (np.array([2, 3]), np.array([0.25, 0.75], dtype=np.float32))]
    labels = np.array([1, 0, 1])
    odds, bias = quality.fit(rows, labels, buckets=8, dim=2, epochs=2, rate=0.1, seed=3)
    rng = np.random.default_rng(3)
    v, out = rng.uniform(-1, 1, (8, 2)).astype(np.float32), np.zeros((2, 2), dtype=np.float32)
    b, step = np.log(np.array([1 / 3, 2 / 3])).astype(np.float32), 0
    for _ in range(2):
        for i in rng.permutation(3):
            ids, share = rows[i]
            lr, step = 0.1 * (1 - step / 6), step + 1
            hidden = sum(s * v[k] for k, s in zip(ids, share, strict=True))
            p = np.exp(out @ hidden + b) / np.exp(out @ hidden + b).sum()
            p[labels[i]] -= 1
            back = p @ out
            out = out - lr * np.outer(p, hidden)
            for k, s in zip(ids, share, strict=True):
                v[k] = v[k] - lr * s / (share @ share) * back
    assert np.allclose(odds, v @ (out[1] - out[0]), atol=1e-5) and bias == pytest.approx(math.log(2), abs=1e-5)


def test_votes_by_expectation_maximisation():
    # two rules that agree, one that says nothing: what both reject is bad, what both accept is good
    prior, odds = rules.estimate({(1, 1, 0): 90, (-1, -1, 0): 10, (1, -1, 0): 2}, 3)
    sure = lambda *v: prior + sum(odds[k][x] for k, x in enumerate(v))
    assert sure(1, 1, 0) > 2 and sure(-1, -1, 0) < -2 and odds[2] == {-1: -rules.LEAST_ODDS, 0: 0.0, 1: 0.0}


def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_near_copies_of_shared_ids_and_hostile_words(spark):
    one = thue_morse(11)
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, "one two three"), (3, "other text here"), (4, base), (5, base + " x"), (5, "fully different words"), (None, base + " y"), (None, "lonely one"), (8, base), (8, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 99, 4, True), (5, 100, 4, False), (5, 2, 5, True), (None, 100, 4, False), (None, 1, None, True), (8, 99, 4, False), (8, 99, 4, False)], key=str)
    left = {(r.doc_id, r.text) for r in minhash.drop_near_copies(docs, 2).collect()}
    assert left == {(i, t) for i, t in rows} - {(5, base + " x"), (None, base + " y"), (8, base)}


def test_a_crowd_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 1)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, base = np.random.default_rng(4), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in rng.choice(59, 7, replace=False):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t in rows]
    root = list(range(40))
    for i in range(40):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 60).collect()}
    assert [got[i] for i in range(40)] == root


def covered(texts, m):
    seen = {}
    for b in texts:
        for j in range(len(b) - m + 1):
            seen[b[j : j + m]] = seen.get(b[j : j + m], 0) + 1
    return [sum(any(seen[b[j : j + m]] > 1 for j in range(max(0, k - m + 1), min(k, len(b) - m) + 1)) for k in range(len(b))) for b in texts]


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 3])
def test_repeats_in_crowds(spark, monkeypatch, crowd):
    whole = suffix_dedup.intervals
    monkeypatch.setattr(suffix_dedup, "intervals", lambda docs, lengths=(400,), gram=32: whole(docs, lengths, gram, crowd))
    rng = np.random.default_rng(0)
    noise = lambda n: rng.choice(np.frombuffer(b"abcdefghij  ", dtype=np.uint8), n).tobytes()
    passage, short, line, texts = noise(425), noise(390), noise(60) + b"\n", []
    for i in range(60):
        t = noise(int(rng.integers(0, 400)))
        t += (passage[i % 30 :] + noise(int(rng.integers(0, 300))), short + noise(200), line * (1 + i % 20) + noise(100), texts[i // 2][: len(texts[i // 2]) // 2] if texts else b"")[i % 4]
        texts.append(t)
    texts.append(texts[2])
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_passage) for r in suffix_dedup.measure(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(covered(texts, 400), covered(texts, 240), strict=True))
