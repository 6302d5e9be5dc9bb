"""Packing: ids, gapless places, and the programme against an exhaustive one."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxelkeel.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = [
    "", None, " \n\t ", "Don't they've I'm 'S it's...,", "Éléphant ÀÉÎ façade naïve ß ẞ İstanbul ΣΊΣΥΦΟΣ", "é Å x̀.", "a b c\x1cd\x1fe\u0085f",
    "<|endoftext|> hi <|STARTOFTEXT|> <|startoftext|>x", "12,345.67% #tag $$$ foo,bar. (x) y. Z,", "日本語テキスト 한국어 🙂🙂 ‍", "a" * 500 + ". " + "B" * 70, "Kelvin K ohm Ω. fi ﬁ, ÷ ×.",
    "x." * 30, ",. . , .,", "́. á.", "no sentence end " * 4000,
]


def test_ids_are_the_tokenizers(tokenizer):
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    alphabet = "abcXYZ éÉßñ'.,!?-_0123\n\t\x0b́ |<>你"
    for text in [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(1500))]:
        ids, ends = words.encode(text)
        assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], repr(text)
        assert all(0 < e < len(ids) for e in ends)


def test_small_store_of_words_forgets(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 5)
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(30):
        text = f"word{k} other{k * 7}, again."
        assert words.encode(text)[0].tolist()[:-1] == tokenizer.encode(text, add_special_tokens=False).ids


def exhaustive(places, cost, length):
    at = [0, *places]

    @lru_cache(None)
    def spent(j):
        return 0.0 if j == 0 else min(spent(i) + length - (at[j] - at[i]) + cost[j - 1] for i in range(j) if at[j] - at[i] <= length)

    def tail(i):
        left = at[-1] - at[i]
        return spent(i) + (min(length - left, packing.INNER_CUT * (bin(left).count("1") - 1)) if left else 0)

    return min(tail(i) for i in range(len(at)) if at[-1] - at[i] <= length)


def test_programme_finds_the_least_cost():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.choice([16, 64])
        gaps = [rng.randint(1, length // 2) for _ in range(rng.randint(1, 25))]
        places = np.cumsum(gaps).tolist()
        cost = [rng.choice([0.0, 2.0, 8.0]) for _ in places]
        cuts = packing.best_cuts(places, cost, True, length)
        assert cuts[-1] == places[-1]
        begin = 0
        for end in cuts:
            size = end - begin
            assert 0 < size <= length
            begin = end
        # cost of the same cuts: a stretch of powers of two at the end, or a padded rest
        best = exhaustive(tuple(places), tuple(cost), length)
        for split in range(len(cuts) + 1):
            head, rest = cuts[:split], cuts[split:]
            if any(h not in places for h in head):
                continue
            total = sum(length - (b - a) + cost[places.index(b)] for a, b in zip([0, *head], head))
            left = places[-1] - (head[-1] if head else 0)
            total += min(length - left, packing.INNER_CUT * (left.bit_count() - 1)) if 0 < left <= length else 0 if not left else 1e9
            if abs(total - best) < 1e-9:
                break
        else:
            raise AssertionError((places, cost, cuts, best))


def check_pieces(pieces, texts, tokenizer):
    """``texts``: list of (doc_id, text), each packed once per row."""
    want = [(i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in texts]
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for found in by_sequence.values():
        place = 0
        for offset, length in sorted(found):
            assert offset == place and length > 0
            place += length
        assert place <= packing.LENGTH
    ids = defaultdict(list)
    for i, t in want:
        ids[i].append(t)
    assert by_doc.keys() == ids.keys()
    for i, copies in ids.items():
        assert sum(n for _, n, _, _ in by_doc[i]) == sum(map(len, copies))
        if len(set(copies)) == 1:
            whole = np.array(copies[0], "<u4")
            for start, n, crc, tokens in by_doc[i]:
                assert tokens == len(whole) and crc == zlib.crc32(whole[start : start + n].tobytes())
    return by_sequence


def test_round_trip(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-k - 1, t, "x") for k, t in enumerate(ODD)] + [(-3, " \n\t ", "x"), (None, "null id", "x")]
    both = docs.selectExpr("doc_id", "text", "'x' as start").unionByName(spark.createDataFrame(odd, "doc_id long, text string, start string"))
    texts = [(r.doc_id, r.text) for r in both.collect()]
    pieces = packing.pack_documents(both).collect()
    sequences = check_pieces(pieces, texts, tokenizer)
    tokens = sum(r.length for r in pieces)
    padding = 0
    for found in sequences.values():
        size = sum(n for _, n in found)
        padding += 0 if size.bit_count() == 1 else packing.LENGTH - size
    assert padding < 0.01 * tokens
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_blocks_carry_on(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_IDS", 6000)
    stream = packing.Stream(0)
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng, rows, texts = random.Random(5), [], []
    for k in range(300):
        text = " ".join(rng.choice(["one", "two.", "three", "pneumonoultramicroscopic"]) for _ in range(rng.randint(0, 400)))
        texts.append((k, text))
        stream.add(k, *words.encode(text))
        if stream.waiting >= packing.BLOCK_IDS:
            rows += stream.lay_out(False).itertuples()
    rows += stream.lay_out(True).itertuples()
    check_pieces(rows, texts, tokenizer)
    order = [(r.sequence_id, r.offset, r.doc_id) for r in rows]
    assert order == sorted(order)


class Counted:
    """A tokenizer that counts what it is asked: whole texts, and pieces of its model."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.texts, self.pieces = tokenizer, self, [], []

    def encode(self, text, **how):
        self.texts.append(text)
        return self.tokenizer.encode(text, **how)

    def tokenize(self, piece):
        self.pieces.append(piece)
        return self.tokenizer.model.tokenize(piece)


def test_each_piece_is_worked_out_once(tokenizer):
    """Signs behind a word neither cost a run of the whole tokenizer nor the word's ids anew."""
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words.tokenizer = Counted(tokenizer)
    text = "Alpha*** alpha, Straße?! ALPHA. alpha beta### straße, beta Beta. *** it's 12"
    assert words.encode(text)[0].tolist()[:-1] == tokenizer.encode(text, add_special_tokens=False).ids
    assert set(words.tokenizer.texts) <= {"", "***", "it's", "12"}
    letters = [p for p in words.tokenizer.pieces if p[0].isalpha()]
    assert len(letters) == len(set(letters)) == 3


def test_words_that_differ_in_signs_share_a_piece(tokenizer):
    """The store grows with pieces: a word's letters are kept once, whatever stands behind them."""
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"{w}{s}" for w in ("alpha", "Über", "gamma") for s in ("", ".", ",", "?!", "...", "_", ")."))
    ids, ends = words.encode(text)
    assert ids.tolist()[:-1] == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(words) == 3 + 7 and len(ends) == 3 * 4


def test_texts_together_are_as_alone(tokenizer, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    texts = [*ODD, *(" ".join(rng.choice(["one", "Two.", " ", "\n\n", "three!!", "x\x1cy", "ÉTÉ,", "a1"]) for _ in range(rng.randrange(60))) for _ in range(200))]
    for chars in (1, 50, 1 << 22):
        monkeypatch.setattr(packing, "CHUNK_CHARS", chars)
        together = list(packing.WordIds(path).encode_all(texts))
        assert [ids.tolist() for ids, _ in together] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]
        alone = packing.WordIds(path)
        assert [ends.tolist() for _, ends in together] == [alone.encode(t)[1].tolist() for t in texts]
    assert list(packing.WordIds(path).encode_all([])) == []
