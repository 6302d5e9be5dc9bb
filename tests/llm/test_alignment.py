"""Tokenizer alignment against a plain count over every byte of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelkeel.llm import alignment
from voxelkeel.llm.packing import byte_letters

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(both, texts):
    """The contract read literally: whole texts, every byte its A and its B token."""
    a, b = both
    byte_of = {c: k for k, c in enumerate(byte_letters())}
    read, counts = [], Counter()
    for text in texts:
        xs = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ys = b.encode(text) if text else []
        x_bytes = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in xs]
        pieces = [b.id_to_piece(i) for i in ys]
        y_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(x_bytes) != (" " + text).encode() or b"".join(y_bytes) != (" " + text).encode():
            read.append(None)
            continue
        of_x = [k for k, t in enumerate(x_bytes) for _ in t]
        of_y = [k for k, t in enumerate(y_bytes) for _ in t]
        links = [(xs[i], ys[j]) for i, j in sorted(set(zip(of_x, of_y)))]
        counts.update(links)
        ends = sorted(set(np.cumsum([len(t) for t in x_bytes]).tolist()) & set(np.cumsum([len(t) for t in y_bytes]).tolist()))
        groups, begin = [], 0
        for end in ends:
            groups.append(",".join(str(xs[k]) for k in sorted(set(of_x[begin:end]))) + "|" + ",".join(str(ys[k]) for k in sorted(set(of_y[begin:end]))))
            begin = end
        read.append((len(xs), len(ys), groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for entry in read:
        if entry is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = entry
        out.append((n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(11)
    odd = [None, "", " ", "  two  spaces ", "tab\there", "a \n b", "\n\nlead", "end\n", "end ", "word\n\n\nword x\r\n", "<|endoftext|> is plain", "</s><s>", "▁under", "naïve café — “quoted”", "日本語 テキスト 混ぜ", "é ǆ ﬁ", "🙂🙂 ok 👩‍👩‍👧", " nbsp  x", "　wide 　x", "x\x00y \x1f z", "'s don't it's 's", "<0x41> <unk>", "100,000.5 -- !!", "a b c", "-" * 300]
    words = ["the", "Thing.", "über", "1,234", "x\ny", "(foo)", "…", "ﬀ", "naïve", "\ttab", "", "\n", "日本"]
    mixed = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    return [*odd, *mixed, mixed[0], mixed[0]]


def run(spark, given, **more):
    df = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(given)], SCHEMA).repartition(3)
    out = alignment.align_tokenizers(df, **more)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("known_pairs", [alignment.KNOWN_PAIRS, 40, 0])
def test_against_every_byte(spark, both, known_pairs):
    given = texts()
    want = Counter((k if k % 9 else None, *row) for k, row in enumerate(plain(both, given)))
    assert run(spark, given, known_pairs=known_pairs) == want


def test_given_documents(spark, both):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    out = alignment.align_tokenizers(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, out)) == Counter((r.doc_id, *row) for r, row in zip(rows, plain(both, [r.text for r in rows])))


def test_store_that_fills_up(spark, both, monkeypatch):
    """More pieces than a worker keeps: the store starts anew, nothing changes."""
    store = alignment.Pieces(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    given = [t for t in texts() if t]
    want = store.texts(given)
    for _ in range(2):
        store.reset()
        again = [store.texts([t])[0] for t in given]
        assert [(n, g, x.tolist()) for n, g, x in again] == [(n, g, x.tolist()) for n, g, x in want]


def test_very_long_text_clashing_columns_and_empty_table(spark, both):
    long = "word another, thing.\n" * 60_000
    df = spark.createDataFrame([(1, long, 5)], "doc_id long, text string, row_id int").withColumn("pair", F.lit(1)).withColumn("links", F.lit("x"))
    assert [tuple(r)[1:] for r in alignment.align_tokenizers(df).collect()] == plain(both, [long])
    assert alignment.align_tokenizers(spark.createDataFrame([], SCHEMA)).collect() == []


def test_intervals():
    rng = random.Random(2)
    for _ in range(200):
        start = np.array([rng.randint(0, 30) for _ in range(rng.randint(1, 12))])
        end = start + np.array([rng.randint(1, 6) for _ in start])
        group = alignment.coalesce_intervals(start, end)
        reached = {k: {k} for k in range(len(start))}
        for _ in start:
            for i in reached:
                reached[i] |= {j for k in list(reached[i]) for j in range(len(start)) if start[j] < end[k] and start[k] < end[j]}
        assert all((group[i] == group[j]) == (j in reached[i]) for i in reached for j in reached)
