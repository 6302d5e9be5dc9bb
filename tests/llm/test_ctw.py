"""Context-tree weighting against a recursive version on small texts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from voxelkeel.llm import ctw

DEPTH = ctw.DEPTH
TEXTS = [(k, t) for k, t in enumerate(["the cat sat on the mat", "the cat", "", None, "a", "AbAb abab é\n", "the dog sat on the mat again", "zz\x00zz", "the the the", "mat cat", "b" * 3000, "on the mat", "Cat sat"] * 2)]


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7


def coded(text):
    return [0xFF] * DEPTH + list((text or "").encode()) + [0xFF]


def brute(rows):
    """Score of each text by trees of dictionaries: node (context, bit prefix) -> counts."""
    counts: dict = defaultdict(lambda: [0, 0])
    for doc_id, text in rows:
        if fold(doc_id) == 2:
            continue
        seq = coded(text)
        for at in range(DEPTH, len(seq)):
            for depth in range(DEPTH + 1):
                context, prefix = tuple(seq[at - depth : at]), 1
                for shift in range(7, -1, -1):
                    bit = seq[at] >> shift & 1
                    counts[context, prefix][bit] += 1
                    prefix = prefix << 1 | bit
    children: dict = defaultdict(set)
    for context, prefix in counts:
        if context:
            children[context[1:], prefix].add(context)
    known: dict = {}

    def own(key):
        a, b = counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(key):
        if key not in known:
            context, prefix = key
            if len(context) == DEPTH:
                known[key] = own(key)
            else:
                split = sum(weighted((c, prefix)) for c in children[key])
                hi, lo = max(own(key), split), min(own(key), split)
                known[key] = hi + math.log1p(math.exp(lo - hi)) - math.log(2)
        return known[key]

    def one(seq, at, prefix, depth=0):
        key = (tuple(seq[at - depth : at]), prefix)
        if key not in counts:
            return None
        a, b = counts[key]
        estimate = (b + 0.5) / (a + b + 1)
        deeper = one(seq, at, prefix, depth + 1) if depth < DEPTH else None
        if deeper is None:
            return estimate
        w = math.exp(own(key) - math.log(2) - weighted(key))
        return w * estimate + (1 - w) * deeper

    out = []
    for _, text in rows:
        seq, total = coded(text), 0.0
        for at in range(DEPTH, len(seq)):
            prefix = 1
            for shift in range(7, -1, -1):
                bit = seq[at] >> shift & 1
                p = one(seq, at, prefix)
                p = 0.5 if p is None else p
                total += math.log10(p if bit else 1 - p)
                prefix = prefix << 1 | bit
        out.append(total)
    return out


def base(rows):
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    split = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for _, t in rows]
    counts = Counter(w for (d, _), words in zip(rows, split) if fold(d) != 2 for w in words)
    total, distinct = sum(counts.values()), len(counts)
    return [(len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)) for w in split]


@pytest.mark.parametrize("block", [12 << 20, 50])
def test_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", block)
    df = spark.createDataFrame([(t, k, "x") for k, t in TEXTS], "text string, doc_id long, score string").repartition(3)
    got = {r.doc_id: r for r in ctw.score_texts(df).collect()}
    assert len(got) == len(TEXTS)
    for (k, text), score, (tokens, known, total, plain) in zip(TEXTS, brute(TEXTS), base(TEXTS)):
        r = got[k]
        assert r.held_out == (fold(k) == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(plain, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)


def test_probabilities_sum_to_one(spark):
    """All continuations of a context together have probability one."""
    context = int.from_bytes(b"abcab"[:DEPTH], "big")
    runs = [(context << 8 | s, 3 if s in (32, 97) else 0) for s in range(256)]
    rows = spark.createDataFrame([(r, n, r >> 8 & 0xFFFF) for r, n in runs], "run long, n long, pair long").repartition(2, "pair").sortWithinPartitions("pair")
    prices = ctw.price(rows, *ctw.fit_tree(rows)).collect()
    assert sum(10**r.price for r in prices) == pytest.approx(1.0, abs=1e-9)


def test_no_training_rows_and_empty_table(spark):
    held = [k for k in range(200) if fold(k) == 2][:3]
    df = spark.createDataFrame([(k, "ab") for k in held], "doc_id long, text string")
    got = ctw.score_texts(df).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-24 * math.log10(2)) and r.base_score == 0 for r in got) and len(got) == 3
    assert ctw.score_texts(df.limit(0)).count() == 0


def test_long_and_repeated_rows(spark):
    rows = [(1, "long text " * 50_000), (5, "same"), (5, "same"), (None, "null id")]
    got = ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and all(r.score < 0 for r in got)
