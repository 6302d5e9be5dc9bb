"""The similarity join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelkeel.llm import jaccard
from voxelkeel.llm.components import connected

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def tokens_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, percent):
    sets = [tokens_of(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, size=220):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(3)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 120, 150, 300]))] for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "a b"), (6, "a  B"), (7, "a b c")]
    for k in range(8, size):
        words = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        if rng.random() < 0.3:
            text += "\n" + rng.choice(passage)
        rows.append((k, text.upper() if rng.random() < 0.1 else text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, percent, frequent, part", [(4, 85, 512, 1000), (5, 80, 4, 7), (4, 85, 2, 3)])
def test_components(spark, monkeypatch, n, percent, frequent, part):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LIST_PART", part)
    rows = corpus(n * percent + frequent)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(4)
    got = sorted((tuple(r) for r in jaccard.similarity_components(df, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Edits far apart: many pairs lie just under the bound, and what links must still be found."""
    monkeypatch.setattr(jaccard, "LIST_PART", 64)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(400):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(150)] = f"e{rng.randrange(300)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in jaccard.similarity_components(df, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_repeated_rows_and_empty_table(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (3, "other words here now"), (None, "a b c d e"), (5, "A b c d e"), (None, "lone text of five words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.similarity_components(df, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)
    assert jaccard.similarity_components(df.limit(0), 4, 85).count() == 0
    kept = jaccard.keep_one_of_each(df, 4, 85).collect()
    assert len(kept) == 6 and not any(r.doc_id == 5 for r in kept)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for trial in range(300):
        n = int(rng.integers(1, 400))
        pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
        table = pool[rng.random(3000) < rng.random()]
        known = jaccard.KnownTokens(table, rng.integers(1, 1500, len(table)))
        percent = int(rng.choice([80, 85, 95]))
        a = np.unique(rng.choice(pool, n, replace=False))
        lack = int(rng.integers(0, n - -(-percent * n // 100) + 1))
        b = np.unique(np.concatenate([rng.choice(a, n - lack, replace=False), rng.integers(1 << 62, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.signatures(a, known, percent), jaccard.signatures(b, known, percent))), (trial, n, percent)


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for n in (5, 900, 3000, 20_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, 4)) :], rng.integers(0, 1 << 63, 3).astype(np.uint64)]))
        s, t = jaccard.sketch(a), jaccard.sketch(b)
        size = min(len(s), len(t))
        assert np.bitwise_count(jaccard.folded(s, size) ^ jaccard.folded(t, size)).sum() <= len(np.setxor1d(a, b))


def test_connected(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (105, 101), (7, 7)] + [(200, k) for k in range(201, 300)]
    got = {r.id: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100, 105: 100, **{k: 200 for k in range(201, 300)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
