"""Quality classifier by positive-unlabelled learning.

A small network is fitted to trusted positives and unlabelled web text under the non-negative unbiased
risk: with class prior ``pi``, the risk of the negatives is that of the unlabelled rows less ``pi`` times
that of the positives taken as negatives, and where a batch drives it under zero its gradient is turned
round. The prior is the lower end of the confidence interval of the labelled rows' share of positives: with
too high a prior bad text is learnt as good, and few labels say little about it. How many steps are taken is chosen by
the non-negative risk of held-back rows, over ``FOLDS`` parts that are held back in turn, and the score is
the mean of ``NETWORKS`` networks fitted to all drawn rows. Features describe a whole text: shares of kinds of
characters, repetition of words, pairs and lines, and how far the text compresses.

Defined results: a null or empty text is scored like a text without words; equal texts get equal
scores; an empty table gives an empty result; without a positive row every score is the prior (0.5
without any label); other columns are ignored; texts of any length are read whole, one at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import crc_mod

#: Bounds of the samples the network is fitted to.
POSITIVES, UNLABELLED = 6000, 12000
HIDDEN, STEPS, THRESHOLD = 16, 1500, 0.3
FOLDS, NETWORKS = 3, 3
#: The held-back risk is read so often; standard deviations of the prior's lower end.
LOOK_EVERY, CONFIDENCE = 50, 1.96
FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "exclaim", "bar", "punctuation", "other_ascii", "non_ascii", "line_feeds",
    "distinct_words", "equal_neighbours", "distinct_pairs", "distinct_lines", "longest_run", "deflated", "lettered_words",
)
_KINDS = np.zeros((256, 9), np.float64)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=+_\\{}[]", b"!", b"|", b".,;:?'\"-()/")):
    _KINDS[list(_bytes), _kind] = 1
_KINDS[10, 8] = 1
_KINDS[128:, 7] = 1
_KINDS[33:127, 6] = 1
_KINDS[33:127, 6] -= _KINDS[33:127, :6].sum(axis=1)
_KINDS[97:123, 6] = 0


def describe(text: str | None) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "replace")
    found = raw.split()
    n, size = len(found), max(1, len(raw))
    kinds = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS) / size
    lines = [line for line in raw.split(b"\n") if line.strip()]
    equal = run = longest = 0
    for before, word in zip(found, found[1:]):
        if before == word:
            equal += 1
            run += 1
            longest = max(longest, run)
        else:
            run = 0
    pairs = max(1, n - 1)
    return [
        np.log1p(n), sum(map(len, found)) / max(1, n) / 10, *kinds.tolist(),
        len(set(found)) / max(1, n) ** 0.9, equal / pairs, len(set(zip(found, found[1:]))) / pairs if n > 1 else 1.0,
        len(set(lines)) / max(1, len(lines)) if lines else 1.0, np.log1p(longest), len(zlib.compress(raw, 1)) / size if raw else 1.0,
        sum(word.isalpha() or word[:-1].isalpha() or word[0] > 127 for word in found) / max(1, n),
    ]


def feature_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``features`` of every row of ``docs`` (doc_id, text)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "features": [describe(t) for t in batch.text]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(rows, "doc_id long, features array<double>")


class Network:
    """One hidden layer on standardised features; the output is the log odds of good text."""

    def __init__(self, seen: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = seen.mean(axis=0), seen.std(axis=0) + 1e-3
        self.p = [rng.normal(size=(seen.shape[1], HIDDEN)) / np.sqrt(seen.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(z @ self.p[0] + self.p[1])
        return hidden, hidden @ self.p[2] + self.p[3]

    def backward(self, z: np.ndarray, hidden: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        d_hidden = np.outer(d, self.p[2]) * (1 - hidden * hidden)
        return [z.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d, np.array([d.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.standard(x))[1], -30, 30)))


logistic = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def pu_risk(net: Network, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """Risk of the positives and of the negatives (unlabelled less positives) on standardised rows; logistic loss."""
    sp, su = net.forward(p)[1], net.forward(u)[1]
    return prior * np.logaddexp(0, -sp).mean(), np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()


def pu_gradient(net: Network, p: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
    """Gradient of the risk, or, where the negatives' is under zero, of its opposite."""
    (hu, su), (hp, sp) = net.forward(u), net.forward(p)
    as_negative = [a - b for a, b in zip(net.backward(u, hu, logistic(su) / len(su)), net.backward(p, hp, prior * logistic(sp) / len(sp)))]
    if np.logaddexp(0, su).mean() < prior * np.logaddexp(0, sp).mean():
        return [-g for g in as_negative]
    return [a + b for a, b in zip(net.backward(p, hp, prior * (logistic(sp) - 1) / len(sp)), as_negative)]


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3, steps: int = STEPS, held: tuple[np.ndarray, np.ndarray] | None = None, batch: int = 512, rate: float = 0.01) -> tuple[Network, list[float]]:
    """Minimise the non-negative risk by Adam for ``steps``; also the risk of ``held`` rows every ``LOOK_EVERY`` steps."""
    net, rng = Network(unlabelled, seed + 2), np.random.default_rng(seed)
    p_all, u_all = net.standard(positive), net.standard(unlabelled)
    first, second, seen = [np.zeros_like(v) for v in net.p], [np.zeros_like(v) for v in net.p], []
    for step in range(1, steps + 1):
        gradient = pu_gradient(net, p_all[rng.integers(0, len(p_all), batch)], u_all[rng.integers(0, len(u_all), batch)], prior)
        now = rate * (1 - 0.9 * step / STEPS)
        for k, g in enumerate(gradient):
            g = g + 1e-4 * net.p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.p[k] = net.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if held is not None and step % LOOK_EVERY == 0:
            good, bad = pu_risk(net, net.standard(held[0]), net.standard(held[1]), prior)
            seen.append(good + max(0.0, bad))
    return net, seen


class Ensemble:
    """The mean score of several networks."""

    def __init__(self, networks: list[Network]):
        self.networks = networks

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([net.score(x) for net in self.networks], axis=0)


def fit_ensemble(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3) -> Ensemble:
    """Networks with as many steps as make the held-back risk least."""
    rng, steps = np.random.default_rng(seed), STEPS
    if min(len(positive), len(unlabelled)) >= FOLDS:
        p_fold, u_fold = (rng.permutation(len(x)) % FOLDS for x in (positive, unlabelled))
        risks = [fit_pu(positive[p_fold != f], unlabelled[u_fold != f], prior, seed + f, held=(positive[p_fold == f], unlabelled[u_fold == f]))[1] for f in range(FOLDS)]
        steps = LOOK_EVERY * (1 + int(np.argmin(np.mean(risks, axis=0))))
    return Ensemble([fit_pu(positive, unlabelled, prior, seed + 10 + k, steps)[0] for k in range(NETWORKS)])


def least_share(good: int, bad: int, deviations: float = CONFIDENCE) -> float:
    """Lower end of the score interval of the share of ``good`` among ``good + bad``."""
    n, z = good + bad, deviations**2
    share = good / n
    low = (share + z / (2 * n) - deviations * np.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)
    return float(min(0.98, max(0.02, low)))


def draw(rows: DataFrame, most: int, total: int, salt: str) -> DataFrame:
    """About ``most`` of ``total`` rows, by a hash of the id; never over twice as many."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000))
    return (rows if total <= most else rows.filter(place < int(1_000_000 * most / total))).limit(2 * most)


def fit_quality(docs: DataFrame, labels: DataFrame) -> tuple[Ensemble | None, float]:
    """Networks and class prior from the rows outside fold 0 of 5, by ``labels`` (doc_id, quality)."""
    learn = crc_mod(F.col("doc_id"), 5) != 0
    known = labels.filter(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    counted = {r["quality"]: r["n"] for r in known.filter(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counted.get(1, 0), counted.get(0, 0)
    if not good:
        return None, 0.5
    prior = least_share(good, bad)
    pool = docs.filter(learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = draw(known.filter("quality = 1").select("doc_id").distinct(), POSITIVES, good, "trusted")
    # the drawn ids are at most 2 * POSITIVES
    positive = pool.join(F.broadcast(trusted), "doc_id", "left_semi").select("doc_id", "text", F.lit(1).alias("trusted"))
    web = draw(pool, UNLABELLED, pool.count(), "web").withColumn("trusted", F.lit(0))
    sample = feature_rows(positive).withColumn("trusted", F.lit(1)).unionByName(feature_rows(web).withColumn("trusted", F.lit(0))).toPandas().sort_values(["trusted", "doc_id"], kind="stable")
    if not (sample.trusted == 1).any() or not (sample.trusted == 0).any():
        return None, prior
    stack = lambda flag: np.array(sample.features[sample.trusted == flag].tolist())
    return fit_ensemble(stack(1), stack(0), prior), prior


def score_documents(docs: DataFrame, net: Ensemble | None, prior: float) -> DataFrame:
    """``doc_id``, ``score`` of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for batch in batches:
            x = np.array([describe(t) for t in batch.text]).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": fitted.score(x) if fitted else np.full(len(batch), prior)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(rows, "doc_id long, score double")


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every row of ``docs``: doc_id, held_out, score, predicted."""
    net, prior = fit_quality(docs, labels)
    held = crc_mod(F.col("doc_id"), 5) == 0
    return score_documents(docs, net, prior).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with the columns of ``docs``.

    The rows themselves pass through the scoring task, so nothing is joined back.
    """
    net, prior = fit_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        fitted = shared.value
        x = np.array([describe(t) for t in text]).reshape(len(text), len(FEATURES))
        return pd.Series(fitted.score(x) if fitted else np.full(len(text), prior))

    return docs.filter(score(F.col("text").cast("string")) >= THRESHOLD)
