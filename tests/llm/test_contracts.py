"""The numbered queries against brute force, on the smallest tables and on hand-made edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from twincheck.llm import bpe, exact_dedup, langid, lm, minhash, packing, quality, queries, rules, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]"
EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Two words"), (6, "two  WORDS"), (7, "a b c d e f g h i " * 60), (8, "a b c d e f g h i " * 60),
    (8, "a b c d e f g h i " * 60), (9, "é" * 3000), (10, "x" * 9000), (11, "12 34 !!"), (12, " zeile zwei"),
]


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def words(t):
    return [w for w in re.split(SPACE + "+", t) if w]


@pytest.fixture(scope="module", params=["table", "edges", "empty"])
def docs(request, spark):
    if request.param == "table":
        return spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(i, t, "en", "s", 0, "clash", 1.0, 7) for i, t in EDGES] if request.param == "edges" else []
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, comp double, n int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def read(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_lm_base(docs):
    own = read(docs)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in own}
    tokens = lambda t: [*words(lower(t)), None]
    c = Counter(w for i, t in own if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = lm.score_texts(docs).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], [(i, held[i], len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in own])
    assert all(r.score <= 0 for r in got)


def test_packing(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENIZER))
    want = Counter()
    for i, t in read(docs):
        want[i, tuple(tokenizer.encode(t, add_special_tokens=False).ids) + (2,)] += 1
    pieces = packing.pack(docs, public_tokenizers.path(queries.WORD_TOKENIZER)).collect()
    # each document is cut into pieces that follow each other: its ids lie in exactly one piece each
    got = Counter((p.doc_id, p.doc_tokens, p.start, p.length, p.ids_crc32) for p in pieces)
    for i, ids in want:
        starts = Counter({p.start: 0 for p in pieces if p.doc_id == i})
        at = 0
        while at < len(ids):
            fits = [(k, n) for k, n in got.items() if k[0] == i and k[1] == len(ids) and k[2] == at and zlib.crc32(np.array(ids[at : at + k[3]], dtype="<u4").tobytes()) == k[4]]
            assert fits, (i, at, starts)
            at += fits[0][0][3]
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    at = {}
    for s, o, n in sorted((p.sequence_id, p.offset, p.length) for p in pieces):
        assert at.get(s, 0) == o
        at[s] = o + n
    assert all(n <= 4096 for n in at.values())
    shards = Counter(s >> 32 for s in at)
    assert sum(n < 4096 for n in at.values()) <= len(shards)  # only a shard's last sequence is padded


@pytest.mark.parametrize("bits", [256, 2])
def test_exact_dedup(docs, bits):
    from pyspark.sql import functions as F

    own = read(docs)
    groups = {}
    for i, t in own:
        groups.setdefault(re.sub(SPACE, "", t), []).append((-len(t), i))
    want = []
    for norm, members in groups.items():
        keep = min(members)[1]
        want += [(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    weak = lambda text: F.unhex(F.rpad(F.substring(F.sha2(text.cast("binary"), 256), 1, 1), 64, "0"))
    got = (exact_dedup.exact_groups(docs, memtable=64) if bits == 256 else exact_dedup.exact_groups(docs, digest=weak, memtable=64)).collect()
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], want)
    assert sum(r.kept for r in got) == len(groups)


def test_rules(docs):
    want = []
    for i, t in read(docs):
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        seen, covered = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7)), set()
        for j in range(len(w) - 7):
            if seen[tuple(w[j : j + 8])] > 1:
                covered.update(range(j, j + 8))
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = rules.judge(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], want)
    assert not any(r.kept and r.base_failed for r in got)


def test_byte_bpe(docs):
    path = public_tokenizers.path(queries.BYTE_RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(ids), digest(" ".join(map(str, ids)).encode()), digest(t.encode())) for i, t in read(docs) for ids in [oracle.encode_ordinary(t)]]
    same(bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect(), want)


def test_suffix_dedup(docs):
    own, m, seen, want = [(i, t.encode()) for i, t in read(docs)], 400, Counter(), []
    for _, b in own:
        seen.update(b[j : j + m] for j in range(len(b) - m + 1))
    for i, b in own:
        gone = np.zeros(len(b) + 1, dtype=int)
        for j in range(len(b) - m + 1):
            if seen[b[j : j + m]] > 1:
                gone[j] += 1
                gone[j + m] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix_dedup.measure(docs).collect()
    same([tuple(r)[:5] for r in got], want)
    assert all(r.n_passage >= r.n_removed for r in got)


def test_minhash(docs):
    sets = {}
    for i, t in read(docs):
        w = words(lower(t))
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    same(minhash.near_groups(docs).collect(), [(i, len(sets[i]), find(i), find(i) == i) for i, _ in read(docs)])


def test_scores_are_defined(docs, labels):
    n = docs.count()
    for got in (quality.score_quality(docs, labels).collect(), toxicity.score_toxicity(docs, labels).collect()):
        assert len(got) == n and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    got = langid.identify(docs).collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3, 11) and docs.schema.names[-1] == "n")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for got, c in ((quality.score_quality(docs, marks), "quality"), (toxicity.score_toxicity(docs, marks), "toxic")):
        held = got.where("held_out").join(marks, "doc_id").selectExpr(f"avg(cast(predicted = {c} AS double)) AS acc").first()
        assert held["acc"] > 0.9
    lang = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang_pred = lang AS double)) AS acc").first()
    assert lang["acc"] > 0.97
