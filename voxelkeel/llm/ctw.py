"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a tree of contexts: the up to ``DEPTH`` bytes before it.
Every node keeps the two counts of the training texts, estimates by Krichevsky and Trofimov's rule, and
weighs its own estimate against its children's by the probability that each gave to the training
data. A text's score is the sum of log10 probabilities of its bytes and of one end mark; a path stops
at the deepest context that training saw.

The counts are those of all training texts, so they grow with the input. They are never gathered in one
place: documents are dealt to blocks, each block asks for the distinct byte runs it holds, the runs are
counted and priced in groups of one two-byte context (all levels from there down), and only the two upper
levels, at most 256 * 255 + 255 numbers whatever the input, are shared. Words for the unigram base go
the same way.

Defined results: a null text is empty, and an empty text is its end mark alone; without training rows
every decision has probability 1/2 and every word count is 0; equal texts get equal scores; equal rows
are scored one by one; an empty table gives an empty result; other columns are ignored; texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import crc_mod, shuffle_partitions, staged

DEPTH = 4
#: The end mark, also the context before a text; never a byte of UTF-8.
END = 0xFF
#: About as many bytes of text make a block.
BLOCK_BYTES = 12 << 20
#: Byte runs that are priced together, a bound on a task's memory.
PRICED_RUNS = 40_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def byte_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte and end mark of ``texts`` with the ``DEPTH`` bytes before it, as one number; and each text's count."""
    pad = b"\xff" * DEPTH
    joined = np.frombuffer(pad + b"\xff".join(texts) + b"\xff", np.uint8).astype(np.int64)
    runs = joined[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        runs |= joined[DEPTH - back : len(joined) - back] << (8 * back)
    # what stands before a text's first byte is the end mark, whatever the text before it was
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for k in range(DEPTH):
        runs[starts[sizes > k] + k] |= ((1 << 8 * (DEPTH - k)) - 1) << 8 * (k + 1)
    return runs, sizes


def plain_words(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()


def word_key(word: bytes) -> int:
    return -1 - (xxhash.xxh3_64_intdigest(word) >> 1)


def with_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text, train and a block for each row; blocks hold about ``BLOCK_BYTES`` of text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (crc_mod(F.col("doc_id"), 7) != 2).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    # long texts are dealt like short ones: a row is never split, and a hash spreads equal ids by their text
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long")).repartition(max(blocks, shuffle_partitions(docs.sparkSession)), "block")


def _texts_of(batches: Iterator[pd.DataFrame], most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes], list[bool]]]:
    """Rows of a partition by block, in pieces of bounded size."""
    held: dict[int, tuple[list[bytes], list[bool], int]] = {}
    for batch in batches:
        for block, text, train in zip(batch.block, batch.text, batch.train):
            texts, flags, size = held.get(block, ([], [], 0))
            raw = text.encode("utf-8", "replace")
            texts.append(raw)
            flags.append(bool(train))
            held[block] = (texts, flags, size + len(raw))
            if size + len(raw) > most:
                yield block, *held.pop(block)[:2]
    for block, (texts, flags, _) in held.items():
        yield block, texts, flags


def _pieces(texts: list[bytes], flags: list[bool], most: int = 1 << 20) -> Iterator[tuple[list[bytes], bool]]:
    """Training texts and others apart, about ``most`` bytes at a time."""
    for train in (True, False):
        part, size = [], 0
        for text, flag in zip(texts, flags):
            if flag == train:
                part.append(text)
                size += len(text)
                if size > most:
                    yield part, train
                    part, size = [], 0
        if part:
            yield part, train


def ask(blocked: DataFrame) -> DataFrame:
    """What each block holds, once each: byte runs and words, with their counts in training rows.

    Rows (block, key, n). The key of a run is the run, that of a word a negative 63-bit hash.
    """

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, texts, flags in _texts_of(batches):
            found = np.zeros(0, np.int64), np.zeros(0)
            for part, train in _pieces(texts, flags):
                runs, times = np.unique(byte_runs(part)[0], return_counts=True)
                found = _group(np.concatenate([found[0], runs]), np.concatenate([found[1], times * float(train)]))
            yield pd.DataFrame({"block": block, "key": found[0], "n": found[1].astype(np.int64)})
            counts: dict[bytes, int] = {}
            for raw, step in zip(texts, flags):
                for word in plain_words(raw):
                    counts[word] = counts.get(word, 0) + step
            if counts:
                yield pd.DataFrame({"block": block, "key": np.fromiter(map(word_key, counts), np.int64, len(counts)), "n": np.fromiter(counts.values(), np.int64, len(counts))})

    return blocked.select("block", "text", "train").mapInPandas(distinct, "block long, key long, n long")


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the probability Krichevsky and Trofimov's estimator gives to a zeros and b ones."""
    return _log_gamma_half(a) + _log_gamma_half(b) - _log_factorial(a + b) - np.log(np.pi)


def _stirling(x: np.ndarray) -> np.ndarray:
    """log gamma(x) for x >= 8."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    low = x < 8
    moved = _stirling(np.where(low, x + 8, x))
    if low.any():
        y = x[low]
        fall = y.copy()
        for k in range(1, 8):
            fall *= y + k
        moved[low] -= np.log(fall)
    return moved


def _log_gamma_half(a: np.ndarray) -> np.ndarray:
    return _log_gamma(np.asarray(a, np.float64) + 0.5)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    return _log_gamma(np.asarray(n, np.float64) + 1.0)


def _decisions(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree node (1..255) and bit of each of a byte's eight decisions: rows x 8."""
    wide, place = symbols[:, None], np.arange(8)
    return (1 << place) + (wide >> (8 - place)), (wide >> (7 - place)) & 1


class Level:
    """The nodes of one depth that occur: sorted keys (context, tree node), counts of both bits, own weight."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.weight = np.ones(len(keys))

    def weigh(self, children: np.ndarray | None) -> np.ndarray:
        """Log of the weighted probability of every node; ``children`` is the sum of its children's logs."""
        own = kt_log(self.zeros, self.ones)
        if children is None:
            return own
        mixed = np.logaddexp(own, children) - np.log(2)
        self.weight = np.exp(np.minimum(0, own - np.log(2) - mixed))
        return mixed

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key occurs, its estimate of a one, its weight."""
        if not len(self.keys):
            return np.zeros(keys.shape, bool), np.full(keys.shape, 0.5), np.ones(keys.shape)
        row = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[row] == keys, (self.ones[row] + 0.5) / (self.zeros[row] + self.ones[row] + 1), self.weight[row]


def _keys_of(runs: np.ndarray, nodes: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the nodes of ``runs`` at ``depth``: rows x 8."""
    return ((runs >> 8) & ((1 << 8 * depth) - 1))[:, None] << 8 | nodes


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same tree nodes with contexts cut to ``depth`` bytes."""
    return (keys >> 8 & ((1 << 8 * depth) - 1)) << 8 | keys & 0xFF


def _group(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and each of ``values`` added up by key."""
    found, owner = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(owner, v, len(found)) for v in values)


def lower_levels(runs: np.ndarray, n: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Levels from two-byte contexts down to the deepest, weighed, and the logs of the first."""
    nodes, bits = _decisions(runs & 0xFF)
    times = np.repeat(n, 8).astype(np.float64)
    one = bits.ravel()
    level = Level(*_group(_keys_of(runs, nodes, DEPTH).ravel(), times * (1 - one), times * one))
    levels, logs = [level], level.weigh(None)
    for depth in range(DEPTH - 1, 1, -1):
        keys, zeros, ones, below = _group(_shorter(level.keys, depth), level.zeros, level.ones, logs)
        level = Level(keys, zeros, ones)
        levels, logs = [level, *levels], level.weigh(below)
    return levels, logs


def _by_pair(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs sorted by their two-byte context, whole contexts together, many contexts at a time."""
    left: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        left.append((batch.run.to_numpy(np.int64), batch.n.to_numpy(np.int64)))
        size += len(batch)
        if size > PRICED_RUNS:
            runs, n = (np.concatenate(x) for x in zip(*left))
            pair = (runs >> 8) & 0xFFFF
            cut = int(np.searchsorted(pair, pair[-1]))
            if cut:
                yield runs[:cut], n[:cut]
                left, size = [(runs[cut:], n[cut:])], len(runs) - cut
    if size:
        yield tuple(np.concatenate(x) for x in zip(*left))


def fit_tree(counts: DataFrame) -> tuple[Level, Level]:
    """The two upper levels, one-byte contexts and none, from ``counts`` (run, n, pair) dealt and sorted by pair."""

    def logs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs, n in _by_pair(batches):
            if (n > 0).any():
                levels, weighted = lower_levels(runs[n > 0], n[n > 0])
                keys, zeros, ones, below = _group(_shorter(levels[0].keys, 1), levels[0].zeros, levels[0].ones, weighted)
                yield pd.DataFrame({"key": keys, "zeros": zeros, "ones": ones, "logs": below})

    # a byte and a tree node each: 256 * 255 rows at most, whatever the input
    small = counts.mapInPandas(logs, "key long, zeros double, ones double, logs double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "logs")]).orderBy("key").toPandas()
    first = Level(*(small[c].to_numpy() for c in ("key", "zeros", "ones")))
    inner = first.weigh(small["logs"].to_numpy())
    keys, zeros, ones, below = _group(_shorter(first.keys, 0), first.zeros, first.ones, inner)
    root = Level(keys, zeros, ones)
    root.weigh(below)
    return first, root


def price(counts: DataFrame, first: Level, root: Level) -> DataFrame:
    """log10 probability of the last byte of every run, given those before it: run, price."""
    shared = counts.sparkSession.sparkContext.broadcast((root, first))

    def prices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs, n in _by_pair(batches):
            nodes, bits = _decisions(runs & 0xFF)
            levels = [*shared.value, *(lower_levels(runs[n > 0], n[n > 0])[0] if (n > 0).any() else [])]
            # from the root down: `share` is what the deeper contexts are worth, `p` what is settled,
            # `settled` the estimate of the deepest node seen so far
            p, share, settled = np.zeros(nodes.shape), np.ones(nodes.shape), np.full(nodes.shape, 0.5)
            for depth, level in enumerate(levels):
                seen, own, weight = level.at(_keys_of(runs, nodes, depth))
                p = np.where(seen, p + share * weight * own, p)
                share = np.where(seen, share * (1 - weight), share)
                settled = np.where(seen, own, settled)
            one = p + share * settled
            yield pd.DataFrame({"run": runs, "price": np.log10(np.where(bits == 1, one, 1 - one)).sum(axis=1)})

    return counts.mapInPandas(prices, "run long, price double")


class RunPrices:
    """Prices of a block's runs, found by dense steps: three bytes first, then one more at a time."""

    def __init__(self, runs: np.ndarray, prices: np.ndarray):
        # the byte itself and the two before it, then each byte further back
        self.column = np.zeros(256, np.int64)
        used = np.unique(np.concatenate([(runs >> 8 * k) & 0xFF for k in range(DEPTH + 1)])) if len(runs) else np.zeros(1, np.int64)
        self.column[used] = np.arange(len(used))
        self.width = len(used)
        self.start, self.steps = np.zeros(1 << 24, np.int32), []
        known, row = np.unique(runs & 0xFFFFFF, return_inverse=True)
        self.start[known] = np.arange(len(known))
        count = len(known)
        for k in range(3, DEPTH + 1):
            cell = row * self.width + self.column[(runs >> 8 * k) & 0xFF]
            cells, row = np.unique(cell, return_inverse=True)
            step = np.zeros(count * self.width, np.int32)
            step[cells] = np.arange(len(cells))
            self.steps.append(step)
            count = len(cells)
        self.prices = np.zeros(max(1, count))
        self.prices[row] = prices

    def total(self, runs: np.ndarray) -> float:
        row = self.start[runs & 0xFFFFFF].astype(np.int64)
        for k, step in enumerate(self.steps, 3):
            row = step[row * self.width + self.column[(runs >> 8 * k) & 0xFF]].astype(np.int64)
        return float(self.prices[row].sum())


def score_blocks(blocked: DataFrame, answers: DataFrame, unknown: float) -> DataFrame:
    """Score every row from its block's ``answers`` (block, key, value): prices of runs, log10 of words.

    ``unknown`` is the value of a word that training doesn't have; known words are worth more.
    """
    columns = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    names = [c.split()[0] for c in columns.split(", ")]

    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        key, value = answers.key.to_numpy(), answers.value.to_numpy()
        prices = RunPrices(key[key >= 0], value[key >= 0])
        words = dict(zip(key[key < 0].tolist(), value[key < 0].tolist()))
        seen: dict[bytes, float] = {}
        out = []
        for doc_id, text, train in zip(docs.doc_id, docs.text, docs.train):
            raw = text.encode("utf-8", "replace")
            found = plain_words(raw)
            for word in found:
                if word not in seen:
                    seen[word] = words[word_key(word)]
            base = np.fromiter(map(seen.__getitem__, found), np.float64, len(found))
            known = int((base > unknown + 1e-12).sum())
            out.append((doc_id, train, len(found) + 1, known, float(base.sum()), prices.total(byte_runs([raw])[0]), len(raw)))
        return pd.DataFrame(out, columns=names)

    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, columns)


def score_texts(docs: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), learning from those outside fold 2 of 7.

    The end token of the base is counted once a text; ``bits_per_byte`` is the code length.
    """
    spark = docs.sparkSession
    blocked = with_blocks(docs)
    asked = staged(ask(blocked), "asked")
    runs, words = asked.filter("key >= 0").withColumnRenamed("key", "run"), asked.filter("key < 0")
    partitions = shuffle_partitions(spark)
    pair = F.shiftrightunsigned("run", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))
    counts = staged(runs.groupBy("run").agg(F.sum("n").alias("n")).withColumn("pair", pair), "run-counts").repartition(partitions, "pair").sortWithinPartitions("pair")
    priced = price(counts, *fit_tree(counts))
    word_counts = staged(words.groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
    seen = word_counts.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    texts = docs.filter(crc_mod(F.col("doc_id"), 7) != 2).count()
    total, distinct = int(seen["total"]) + texts, int(seen["distinct"]) + (texts > 0)
    log_of = lambda n: float(np.log10((n + 1) / (total + distinct + 1)))
    values = word_counts.select("key", (F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))).alias("value"))
    # a block that asked in several pieces may get an answer twice, which changes nothing
    answers = runs.select("block", F.col("run").alias("key")).join(priced.withColumnRenamed("run", "key").withColumnRenamed("price", "value"), "key")
    answers = answers.unionByName(words.select("block", "key").join(values, "key"))
    scored = score_blocks(blocked, staged(answers.select("block", "key", "value"), "answers"), log_of(0))
    end = log_of(texts)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + int(texts > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + end).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
