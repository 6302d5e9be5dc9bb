"""Alignment of two tokenizers' tokens by interval coalescing, with corpus-wide counts of linked ids.

Tokens of both vocabularies are byte intervals of one text. All intervals of a block are sorted by
start (``lexsort``), the running maximum of their ends is accumulated, and a group ends where a start reaches
that maximum; within a group every A token is linked with the B tokens that its bytes overlap.

Both vocabularies break a text at each single space in front of a word, so a text with no other use of
spaces is cut there, each piece is tokenized and aligned once per Python worker and the texts are put
together from the pieces. Any other text is aligned as a whole. Texts are tokenized once: their linked pairs
of ids are written to the shared folder beside their counts, and both the corpus-wide counts and
their sums per text are taken from there.

The ``KNOWN_PAIRS`` most frequent pairs are sent to every task, a fixed bound; links of all other pairs
leave the second pass as (text, pair, links) rows and meet their counts in a shuffle, so no pair is left out at
any number of distinct pairs.

Defined results: texts that are null or empty, or whose joined token bytes are not a space and the text in
either vocabulary, have no tokens: zeros and an empty string; rows with equal or null ids are told apart;
equal rows count as often as they are there; an empty table gives no row; other columns are ignored; a text
of any length is read whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import staged
from voxelkeel.llm.packing import byte_letters

#: Pairs whose counts every task gets, and pieces a worker keeps.
KNOWN_PAIRS, KEPT_PIECES = 1 << 20, 250_000
#: Pieces that are aligned at a time.
BLOCK_ROWS = 2000
#: Characters of texts that are read at a time, and links that are counted at a time.
BLOCK_CHARS, BLOCK_LINKS = 2 << 20, 1_000_000
#: A space at an end of the text or in front of white space.
ODD_SPACE = re.compile(r"(?:^| )(?:\s|\Z)")

#: Texts that A's splitting rule cuts into letters, stops and line ends only, and those parts.
PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ.,!?;:]++|\n(?!\n|\Z))++")
PARTS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[.,!?;:]+|\n")

PAIRS = "pair long, links long"
TEXTS = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
SCORED = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>"


def coalesce_intervals(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of the group of each interval, in the order of the rows; groups are the connected unions."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group


def overlapping(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of A and of B that overlap; both are sorted and each is without overlap in itself."""
    first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    count = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(a_start)), count)
    within = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    return a, np.repeat(first, count) + within


class Vocabularies:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        single = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = single.fullmatch(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        # ids as text, and pairs of ids as one number
        self.a_text, self.b_text = (list(map(str, range(len(x)))) for x in (self.a_bytes, self.b_bytes))
        self.b_ids = len(self.b_bytes)
        self.kind = np.dtype("<u4" if len(self.a_bytes) * self.b_ids <= 1 << 32 else "<u8")
        self.letters = byte_letters()
        #: ids of short parts, stops above all
        self.stops: dict[str, list[int]] = {}
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text, without the space that A is given in front and B adds."""
        tokenize = self.a.model.tokenize
        a: list = []
        for text in texts:
            if text.isascii() and text.isalpha():
                a.append([t.id for t in tokenize("Ġ" + text)])
            else:
                a.append(self._by_parts(text) if PLAIN.fullmatch(text) else None)
        rest = [k for k, ids in enumerate(a) if ids is None]
        for k, found in zip(rest, self.a.encode_batch([" " + texts[k] for k in rest], add_special_tokens=False)):
            a[k] = found.ids
        return a, self.b.encode(texts, num_threads=1)

    def _by_parts(self, text: str) -> list[int]:
        """A's ids of a text of plain letters, stops and single line ends, which A takes apart before it joins bytes."""
        ids: list[int] = []
        for part in PARTS.findall(" " + text):
            found = self.stops.get(part)
            if found is None:
                mapped = "".join([self.letters[b] for b in part.encode()])
                found = [t.id for t in self.a.model.tokenize(mapped)]
                if len(part) <= 2:
                    self.stops[part] = found
            ids += found
        return ids


class Grown:
    """A numpy array that values are added to."""

    def __init__(self, size: int = 1024):
        self.values, self.used = np.zeros(size, np.int64), 0

    def add(self, more: np.ndarray) -> None:
        end = self.used + len(more)
        if end > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(end, np.int64)])
        self.values[self.used : end] = more
        self.used = end

    @property
    def now(self) -> np.ndarray:
        return self.values[: self.used]


class Aligned:
    """Alignments of a list of texts: per text counts (columns of ``n``), groups as text and whether it is whole; links in one array."""

    FIELDS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, vocabularies: Vocabularies, texts: list[str]):
        v = vocabularies
        a_ids, b_ids = v.encode(texts)
        a_bytes, b_bytes = v.a_bytes.__getitem__, v.b_bytes.__getitem__
        self.whole = [b"".join(map(a_bytes, a)) == b" " + text.encode() == b"".join(map(b_bytes, b)) for text, a, b in zip(texts, a_ids, b_ids)]
        if not all(self.whole):
            a_ids, b_ids = ([ids if ok else [] for ids, ok in zip(x, self.whole)] for x in (a_ids, b_ids))
        # one line of bytes for all texts
        a_list, b_list = list(chain.from_iterable(a_ids)), list(chain.from_iterable(b_ids))
        a, b = np.array(a_list, np.int64), np.array(b_list, np.int64)
        a_end, b_end = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
        a_start, b_start = a_end - v.a_size[a], b_end - v.b_size[b]
        group = coalesce_intervals(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]))
        left, right = overlapping(a_start, a_end, b_start, b_end)
        self.links = a[left] * v.b_ids + b[right]
        n_groups = int(group.max()) + 1 if len(group) else 0
        numbers = np.arange(n_groups + 1)
        a_cut, b_cut = np.searchsorted(group[: len(a)], numbers).tolist(), np.searchsorted(group[len(a) :], numbers).tolist()
        xs, ys = list(map(v.a_text.__getitem__, a_list)), list(map(v.b_text.__getitem__, b_list))
        parts = [f"{','.join(xs[p:q])}|{','.join(ys[r:s])}" for p, q, r, s in zip(a_cut, a_cut[1:], b_cut, b_cut[1:])]
        a_at, b_at = (np.cumsum([0, *map(len, x)]) for x in (a_ids, b_ids))
        group_at = np.append(group[: len(a)], n_groups)[a_at]
        self.groups = [";".join(parts[p:q]) for p, q in pairwise(group_at.tolist())]
        self.n = [np.diff(x) for x in (a_at, b_at, group_at, np.searchsorted(left, a_at))]


class Pieces(dict):
    """Pieces of text, each aligned once: piece -> row of the arrays."""

    def __init__(self, a_path: str, b_path: str):
        self.vocabularies = Vocabularies(a_path, b_path)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pending: list[str] = []
        self.groups: list[str] = []
        self.broken: set[int] = set()
        self.n = [Grown() for _ in Aligned.FIELDS]
        self.links = Grown()

    def __missing__(self, piece: str) -> int:
        row = self[piece] = len(self)
        self.pending.append(piece)
        return row

    def learn(self) -> None:
        for begin in range(0, len(self.pending), BLOCK_ROWS):
            block = Aligned(self.vocabularies, self.pending[begin : begin + BLOCK_ROWS])
            if not all(block.whole):
                self.broken.update(len(self.groups) + k for k, ok in enumerate(block.whole) if not ok)
            for grown, n in zip(self.n, block.n):
                grown.add(n)
            self.groups += block.groups
            self.links.add(block.links)
        self.pending = []

    def rows(self, text: str) -> np.ndarray | None:
        """Rows of the pieces of ``text``, to be learnt before they are read; None if it has to be aligned as a whole."""
        if ODD_SPACE.search(text):
            return None
        pieces = text.split(" ")
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))

    def texts(self, texts: list[str | None]) -> list[tuple[list[int], str, np.ndarray]]:
        """Counts, groups as text and linked pairs of each text."""
        found = [self.rows(t) if t else None for t in texts]
        self.learn()
        n, links = [x.now for x in self.n], self.links.now
        ends = np.cumsum(n[3])
        out = []
        for text, rows in zip(texts, found):
            if not text:
                out.append(([0] * 4, "", links[:0]))
            elif rows is None or (self.broken and not self.broken.isdisjoint(rows.tolist())):
                whole = Aligned(self.vocabularies, [text])
                out.append(([int(x[0]) for x in whole.n], whole.groups[0], whole.links))
            else:
                mine = n[3][rows]
                total = int(mine.sum())
                at = np.arange(total) - np.repeat(np.cumsum(mine) - ends[rows], mine)
                out.append(([*(int(x[rows].sum()) for x in n[:3]), total], ";".join(map(self.groups.__getitem__, rows.tolist())), links[at]))
        return out


@lru_cache(maxsize=2)
def pieces_of(a_path: str, b_path: str) -> Pieces:
    """One store per pair of vocabularies and Python worker, which serves one task after another."""
    return Pieces(a_path, b_path)


def _store(a_path: str | None, b_path: str | None) -> Pieces:
    import public_tokenizers

    store = pieces_of(a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))
    if len(store) > KEPT_PIECES:
        store.reset()
    return store


def linked_texts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Counts, groups and links of each row of ``docs`` (doc_id, text); ``pairs`` holds A's id times the number of B's ids plus B's id of each link."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(a_path, b_path)
        kind = store.vocabularies.kind
        next_row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and chars < BLOCK_CHARS:
                    chars += len(texts[end] or "")
                    end += 1
                found = store.texts(texts[begin:end])
                sizes = np.cumsum([0, *(len(links) for _, _, links in found)])
                links = np.concatenate([links for _, _, links in found]).astype(kind)
                digests = [hashlib.sha256(groups.encode()).hexdigest() if groups else "" for _, groups, _ in found]
                columns = [pa.array(range(next_row, next_row + len(found)), pa.int64()), pa.array(ids[begin:end], pa.int64()), *(pa.array([n[k] for n, _, _ in found], pa.int64()) for k in range(4)), pa.array(digests)]
                columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer((sizes * kind.itemsize).astype(np.int32)), pa.py_buffer(links)]))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TEXTS.split(", ")])
                next_row, begin = next_row + len(found), end
                if len(store) > KEPT_PIECES:
                    store.reset()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(align, TEXTS)


def _blocks(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with about ``BLOCK_LINKS`` links, a row at least, and their links as one array of pairs."""
    for batch in batches:
        ends = np.cumsum(batch.column("n_links").to_numpy())
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + BLOCK_LINKS, "right")))
            part = batch.slice(begin, end - begin)
            column = part.column("pairs")
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            yield part, np.frombuffer(column.buffers()[2], kind)[at[0] // kind.itemsize : at[-1] // kind.itemsize].astype(np.int64)
            begin = end


def pair_counts(texts: DataFrame, kind: np.dtype) -> DataFrame:
    """How many links hold each pair of ids linked, over all ``texts`` (n_links, pairs): pair, links."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, pairs in _blocks(batches, kind):
            more, times = np.unique(pairs, return_counts=True)
            found, place = np.unique(np.concatenate([found, more]), return_inverse=True)
            old, links = links, np.zeros(len(found), np.int64)
            np.add.at(links, place, np.concatenate([old, times]))
            if len(found) > BLOCK_LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(links)], names=["pair", "links"])
                found, links = found[:0], links[:0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(links)], names=["pair", "links"])

    return texts.select("n_links", "pairs").mapInArrow(count, PAIRS).groupBy("pair").agg(F.sum("links").alias("links"))


def with_best(counts: DataFrame, b_ids: int) -> DataFrame:
    """``counts`` with ``best``: no pair of the same B id has more links."""
    b = F.col("pair") % b_ids
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of tokens, groups and links, links that are their B id's most frequent, and a hash of the groups.

    ``a_path`` and ``b_path`` are vocabulary files that the driver and every executor have; the public ones if none are
    given. At most ``known_pairs`` counts are sent to the tasks; others are joined.
    """
    vocabularies = _store(a_path, b_path).vocabularies
    kind, b_ids = vocabularies.kind, vocabularies.b_ids
    texts = staged(linked_texts(docs, a_path, b_path), "linked")
    counts = staged(with_best(staged(pair_counts(texts, kind), "pairs"), b_ids), "counts")
    top = counts.orderBy(F.desc("links"), "pair").limit(known_pairs).toPandas().sort_values("pair")
    shared = docs.sparkSession.sparkContext.broadcast((top.pair.to_numpy(np.int64), top.links.to_numpy(np.int64), top.best.to_numpy(bool)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, best = shared.value
        for batch, pairs in _blocks(batches, kind):
            cuts = np.concatenate([[0], np.cumsum(batch.column("n_links").to_numpy())])
            if len(known):
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                there = known[at] == pairs
                columns = [np.diff(np.concatenate([[0], np.cumsum(x[at] * there, dtype=np.int64)])[cuts]) for x in (best, links)]
            else:
                there, columns = np.zeros(len(pairs), bool), [np.zeros(batch.num_rows, np.int64)] * 2
            rest = np.concatenate([[0], np.cumsum(~there)])[cuts].astype(np.int32)
            kept = [batch.column(c) for c in ("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns), pa.ListArray.from_arrays(pa.array(rest), pa.array(pairs[~there]))], names=[c.split()[0] for c in SCORED.split(", ")])

    scored = texts.mapInArrow(score, SCORED)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if len(top) < known_pairs:
        return scored.select(*columns)
    scored = staged(scored, "aligned")
    links = scored.select("row_id", F.explode("rest").alias("pair")).groupBy("row_id", "pair").count()
    more = links.join(counts, "pair").groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("count")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("count")).alias("more_sum"))
    whole = scored.drop("rest").join(more, "row_id", "left")
    for name, extra in (("n_best", "more_best"), ("count_sum", "more_sum")):
        whole = whole.withColumn(name, F.col(name) + F.coalesce(F.col(extra), F.lit(0)))
    return whole.select(*columns)
