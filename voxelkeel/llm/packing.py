"""Packing token ids into sequences by an order-preserving dynamic programme.

Documents keep their order within a scan partition, and no row is shuffled. Cuts between sequences may lie at
document ends, at sentence ends, and, in long sentences, at fixed steps; the programme picks
the cuts that minimise padding plus a penalty for every document cut. A window is at most ``LENGTH``
ids, so the best earlier cut is the minimum over a sliding range, kept by a monotone queue. What is
left at the end of a partition is either padded or laid out in lengths that are powers of two, which
need no padding, whichever costs less.

Defined results: a null text is empty and has the end id alone; equal rows are packed one by one; an
empty table gives no piece; other columns are ignored; a text longer than a sequence is spread over
several; rows with a null id are packed under a null id.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 4096
END_ID = 2
#: Cost in ids of padding of cutting a document at a sentence's end, or within a sentence.
SENTENCE_CUT, INNER_CUT = 2.0, 6.0
#: Least ids between two sentence cuts, and the step of cuts within long sentences.
LEAST_GAP, INNER_STEP = 16, 32
#: Ids that are laid out at a time; pieces of words whose ids are kept.
BLOCK_IDS, KEPT_WORDS = 2 << 20, 300_000
#: Characters of texts that are split into words at a time.
CHUNK_CHARS = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Words of letters that neither composition nor the tokenizer's lower-casing changes otherwise than str.lower does, and the signs behind them.
PLAIN = r"^(?P<letters>[a-zß-öø-ÿÀ-ÖØ-Þ]+)(?P<signs>[!-/:-@\[-`{-~]*)$"
#: What goes to the model directly: such letters alone, or signs alone.
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[!-/:-@\[-`{-~]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for byte in range(256):
        if byte in own:
            letters[byte] = chr(byte)
        else:
            letters[byte], spare = chr(spare), spare + 1
    return letters


class WordIds(dict):
    """Ids of the pieces of lower-cased words, each worked out once: piece -> row of ``first`` and ``count``.

    White space is dropped by the vocabulary's splitting rule, so a text's ids are those of its
    words. Plain letters and the signs behind them are a piece each and go to the model directly, other words
    are a piece as they are and go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pending: list[bytes] = []
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.used, self.rows = np.zeros(4096, np.uint32), 0, 0

    def __missing__(self, piece: bytes) -> int:
        row = self[piece] = len(self)
        self.pending.append(piece)
        return row

    def _learn(self) -> None:
        tokenize, ids, count = self.tokenizer.model.tokenize, [], []
        for piece in self.pending:
            text = piece.decode("utf-8")
            if not text:
                found = []
            elif _PIECE.fullmatch(text):
                found = [t.id for t in tokenize(text if text.isascii() else "".join([self.letters[b] for b in piece]))]
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids += found
            count.append(len(found))
        rows, used = self.rows + len(count), self.used + len(ids)
        while rows > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : used], self.count[self.rows : rows] = ids, count
        self.first[self.rows : rows] = self.used + np.cumsum(count) - count
        self.used, self.rows, self.pending = used, rows, []

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """The row of each of ``pieces``; those not met before wait in ``pending``."""
        known = pieces.dictionary_encode()
        found = known.dictionary.cast(pa.large_binary()).to_pylist()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))[known.indices.to_numpy()]

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct ``words``, one after another, and where each word's begin and how many they are."""
        parts = pc.extract_regex(words, pattern=PLAIN)
        letters, signs = pc.struct_field(parts, "letters"), pc.struct_field(parts, "signs")
        pieces = np.column_stack([self._rows(pc.coalesce(pc.utf8_lower(letters), words)), self._rows(pc.fill_null(signs, ""))]).ravel()
        if self.pending:
            self._learn()
        count = self.count[pieces]
        behind = np.cumsum(count)
        ids = self.ids[np.arange(behind[-1] if len(pieces) else 0) - np.repeat(behind - count - self.first[pieces], count)]
        count = count[::2] + count[1::2]
        return ids, behind[1::2] - count, count

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``text`` with the end id behind, and the places behind sentence ends."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``encode`` gives, for each of ``texts`` in turn, whose words are looked up together."""
        chunk, chars = [], 0
        for text in texts:
            chunk.append(text or "")
            chars += len(chunk[-1])
            if chars >= CHUNK_CHARS:
                yield from self._encode(chunk)
                chunk, chars = [], 0
        yield from self._encode(chunk)

    def _encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(self) > KEPT_WORDS:
            self.reset()
        # one that may hold the string of a special token is left out here, as that is found before anything else
        special = ["<|" in text for text in texts]
        given = pa.array([b"" if s else t.encode("utf-8", "replace") for t, s in zip(texts, special)], pa.large_string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(given))
        known = split.flatten().dictionary_encode()
        words, rows = known.dictionary, known.indices.to_numpy()
        word_ids, first, count = self._word_ids(words)
        ends = pc.match_substring_regex(words, "[.!?]$").to_numpy(zero_copy_only=False)
        first, count = first[rows], count[rows]
        behind = np.cumsum(count)
        ids = word_ids[np.arange(behind[-1] if len(rows) else 0) - np.repeat(behind - count - first, count)]
        ending = np.flatnonzero(ends[rows])
        places = behind[ending]
        bounds = split.offsets.to_numpy()
        at, among = np.concatenate([[0], behind])[bounds].tolist(), np.searchsorted(ending, bounds).tolist()
        for k, text in enumerate(texts):
            if special[k]:
                found = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)
                yield found, np.arange(INNER_STEP, len(found), INNER_STEP)
                continue
            found = np.full(at[k + 1] - at[k] + 1, END_ID, np.uint32)
            found[:-1] = ids[at[k] : at[k + 1]]
            yield found, places[among[k] : among[k + 1]] - at[k]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One store of words per vocabulary and Python worker, which serves one task after another."""
    return WordIds(path)


def cut_places(size: int, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of ``size`` ids may be cut and what each cut costs; its end costs nothing."""
    kept: list[int] = []
    last = 0
    for place in sentence_ends.tolist():
        if place - last >= LEAST_GAP and size - place >= LEAST_GAP:
            kept.append(place)
            last = place
    at = np.array([0, *kept, size], np.int64)
    places, gaps = at[1:], at[1:] - at[:-1]
    cost = np.full(len(places), SENTENCE_CUT)
    cost[-1] = 0.0
    if gaps.max() > 2 * INNER_STEP:
        inner = np.concatenate([np.arange(b - g + INNER_STEP, b, INNER_STEP) for b, g in zip(places, gaps) if g > 2 * INNER_STEP])
        places, cost = np.concatenate([places, inner]), np.concatenate([cost, np.full(len(inner), INNER_CUT)])
        order = np.argsort(places)
        places, cost = places[order], cost[order]
    return places, cost


def best_cuts(places: list[int], cost: list[float], final: bool, length: int = LENGTH) -> list[int]:
    """Ends of the sequences over ids 0..places[-1]; no two neighbouring places are over ``length`` apart.

    With ``final`` all ids are laid out and the rest at the end may become powers of two; without,
    the layout stops at the cheapest cut within the last ``length`` ids.
    """
    at, spent, came = [0, *places], [0.0], [0]
    queue: deque[int] = deque([0])  # rising in spent + at
    for j in range(1, len(at)):
        end = at[j]
        while at[queue[0]] < end - length:
            queue.popleft()
        i = queue[0]
        paid = spent[i] + at[i] + length - end + cost[j - 1]
        spent.append(paid)
        came.append(i)
        key = paid + end
        while queue and spent[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    total, tail = at[-1], []
    near = [i for i in range(len(at) - 1, -1, -1) if total - at[i] <= length]
    if final:
        def rest(i: int) -> float:
            left = total - at[i]
            return spent[i] + (min(length - left, INNER_CUT * (left.bit_count() - 1)) if left else 0.0)

        stop = min(near, key=rest)
        left = total - at[stop]
        if left and INNER_CUT * (left.bit_count() - 1) < length - left:
            place = at[stop]
            for k in range(left.bit_length() - 1, -1, -1):
                if left >> k & 1:
                    place += 1 << k
                    tail.append(place)
        elif left:
            tail = [total]
    else:
        # as if every layout went on from its cut at no further loss
        stop = min(near, key=lambda i: spent[i] + (total - at[i]) * 1e-9)
    cuts = []
    while stop:
        cuts.append(at[stop])
        stop = came[stop]
    return cuts[::-1] + tail


class Stream:
    """Documents waiting to be laid out, the first perhaps in part."""

    def __init__(self, sequence_base: int):
        self.docs: list[tuple] = []
        self.waiting, self.next_sequence = 0, sequence_base

    def add(self, doc_id: int | None, ids: np.ndarray, sentence_ends: np.ndarray) -> None:
        places, cost = cut_places(len(ids), sentence_ends)
        self.docs.append((doc_id, 0, len(ids), ids, places, cost))
        self.waiting += len(ids)

    def lay_out(self, final: bool) -> pd.DataFrame:
        offsets = np.cumsum([0, *(len(d[3]) for d in self.docs)])
        places = np.concatenate([d[4] + o for d, o in zip(self.docs, offsets)]) if self.docs else np.zeros(0, np.int64)
        cost = np.concatenate([d[5] for d in self.docs]) if self.docs else np.zeros(0)
        cuts = best_cuts(places.tolist(), cost.tolist(), final) if self.docs else []
        rows, k, begin = [], 0, 0
        for end in cuts:
            place = begin
            while place < end:
                doc_id, before, doc_tokens, ids, _, _ = self.docs[k]
                a, b = place - offsets[k], min(end - offsets[k], len(ids))
                rows.append((doc_id, before + a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), doc_tokens, self.next_sequence, place - begin))
                place += b - a
                if b == len(ids):
                    k += 1
            begin, self.next_sequence = end, self.next_sequence + 1
        left = self.docs[k:]
        if left and begin > offsets[k]:
            doc_id, before, doc_tokens, ids, places, cost = left[0]
            used = int(begin - offsets[k])
            live = places > used
            left[0] = (doc_id, before + used, doc_tokens, ids[used:], places[live] - used, cost[live])
        self.docs, self.waiting = left, self.waiting - begin
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text), with the sequence and place of each.

    ``vocabulary`` is the path of a tokenizer file every executor has; the public word vocabulary if
    none is given.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        words = word_ids(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        stream = Stream(TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc_id, found in zip(batch.doc_id, words.encode_all(batch.text)):
                stream.add(None if pd.isna(doc_id) else int(doc_id), *found)
                if stream.waiting >= BLOCK_IDS:
                    yield stream.lay_out(False)
        yield stream.lay_out(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(pack, PIECES)
