"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of ``WINDOW`` places, forwards and backwards, labels
every place with language probabilities, and a document's probabilities are the mean over all its
places. It is written and trained in numpy: backpropagation through time over windows drawn from a
bounded sample of labelled rows (``SAMPLE_DOCS`` per language, ``PIECES`` windows each, at hashed places
of the whole text).

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal texts get equal
results; an empty table gives an empty result; without any labelled row everything is ``und``; other
columns of the input are ignored. Texts of any length are read whole, a bounded block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import crc_mod

HIDDEN = 8
WINDOW = 128
#: Bounds of the labelled sample: documents per language, windows per document, languages.
SAMPLE_DOCS, PIECES, MAX_LANGUAGES = 500, 4, 64
#: Windows that run through the network together.
BLOCK = 4096
UNDETERMINED = "und"
SCORES = "doc_id long, lang_pred string, score double"


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def init_parameters(languages: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters of both directions, stacked in the first axis: 0 forward, 1 backward."""
    rng = np.random.default_rng(seed)
    scale = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    return {
        "byte": scale(2, 256, 3 * HIDDEN),
        "gates": scale(2, HIDDEN, 2 * HIDDEN),
        "cell": scale(2, HIDDEN, HIDDEN),
        "out": scale(2 * HIDDEN, languages),
        "bias": np.zeros(languages, np.float32),
    }


def run_direction(p: dict[str, np.ndarray], way: int, text: np.ndarray, keep: bool = False):
    """States after each place of ``text`` (places x windows), in reading order of this direction."""
    places, n = text.shape
    states = np.empty((places, n, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    kept = []
    for t in range(places):
        x = p["byte"][way].take(text[t], axis=0)
        gates = x[:, : 2 * HIDDEN] + h @ p["gates"][way]
        sigmoid(gates)
        reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
        gated = reset * h
        cell = x[:, 2 * HIDDEN :] + gated @ p["cell"][way]
        cell *= 2
        sigmoid(cell)
        cell *= 2
        cell -= 1  # tanh
        new = cell - h
        new *= update
        new += h
        if keep:
            kept.append((h, gates, gated, cell))
        states[t] = h = new
    return (states, kept) if keep else states


def label_places(p: dict[str, np.ndarray], text: np.ndarray) -> np.ndarray:
    """Language probabilities of every place: places x windows x languages."""
    scores = run_direction(p, 0, text) @ p["out"][:HIDDEN]
    scores += run_direction(p, 1, text[::-1])[::-1] @ p["out"][HIDDEN:]
    scores += p["bias"]
    scores -= scores.max(axis=-1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=-1, keepdims=True)
    return scores


def gradients(p: dict[str, np.ndarray], text: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the labelled places and its gradient, by backpropagation through time."""
    places, n = text.shape
    forward, f_kept = run_direction(p, 0, text, True)
    backward, b_kept = run_direction(p, 1, text[::-1], True)
    states = np.concatenate([forward, backward[::-1]], axis=2)
    scores = states @ p["out"] + p["bias"]
    scores -= scores.max(axis=-1, keepdims=True)
    probabilities = np.exp(scores)
    probabilities /= probabilities.sum(axis=-1, keepdims=True)
    live = (np.arange(places)[:, None] < lengths[None, :]).astype(np.float32)
    total = live.sum()
    loss = -float((np.log(probabilities[:, np.arange(n), labels] + 1e-9) * live).sum() / total)
    d_scores = probabilities
    d_scores[:, np.arange(n), labels] -= 1
    d_scores *= (live / total)[:, :, None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"] = np.einsum("tnh,tnl->hl", states, d_scores, optimize=True)
    g["bias"] = d_scores.sum(axis=(0, 1))
    d_states = d_scores @ p["out"].T
    for way, kept, d_way, read in ((0, f_kept, d_states[:, :, :HIDDEN], text), (1, b_kept, d_states[::-1, :, HIDDEN:], text[::-1])):
        d_h = np.zeros((n, HIDDEN), np.float32)
        for t in range(places - 1, -1, -1):
            h, gates, gated, cell = kept[t]
            reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
            d_h = d_h + d_way[t]
            d_cell = d_h * update * (1 - cell * cell)
            d_update = d_h * (cell - h) * update * (1 - update)
            d_gated = d_cell @ p["cell"][way].T
            d_reset = d_gated * h * reset * (1 - reset)
            d_gates = np.concatenate([d_reset, d_update], axis=1)
            g["gates"][way] += h.T @ d_gates
            g["cell"][way] += gated.T @ d_cell
            np.add.at(g["byte"][way], read[t], np.concatenate([d_gates, d_cell], axis=1))
            d_h = d_h * (1 - update) + d_gated * reset + d_gates @ p["gates"][way].T
    return loss, g


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: int, steps: int = 350, batch: int = 96, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam over random batches of windows (windows x places)."""
    p, rng = init_parameters(languages), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    by_language = [np.flatnonzero(labels == k) for k in range(languages)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, -(-batch // languages)) for rows in by_language])
        _, g = gradients(p, np.ascontiguousarray(windows[pick].T), lengths[pick], labels[pick])
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return p


def labelled_windows(labelled: DataFrame) -> pd.DataFrame:
    """A bounded sample of (lang, piece): hashed documents of each language, hashed places of their texts."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    if not counts:
        return pd.DataFrame({"lang": [], "piece": []})
    draw = (F.xxhash64("doc_id", F.lit("sample")) % 1_000_000 + 1_000_000) % 1_000_000
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, SAMPLE_DOCS / r["count"])).otherwise(share)
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    pieces = F.array(*[F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, {k}), _room) as int), {WINDOW})") for k in range(PIECES)])
    sample = rows.filter(draw < share * 1_000_000).withColumn("_room", room).select("doc_id", "lang", F.posexplode(pieces).alias("k", "piece"))
    return sample.limit(4 * SAMPLE_DOCS * PIECES * max(1, len(counts))).toPandas().sort_values(["lang", "doc_id", "k"])


def fit_language_network(labelled: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and network, learnt from ``labelled`` (doc_id, text, lang)."""
    sample = labelled_windows(labelled)
    languages = sorted(set(sample.lang))
    if not languages:
        return [], {}
    coded = [piece.encode("utf-8", "replace")[:WINDOW] for piece in sample.piece]
    windows = np.zeros((len(coded), WINDOW), np.uint8)
    for row, piece in zip(windows, coded):
        row[: len(piece)] = np.frombuffer(piece, np.uint8)
    lengths = np.array([len(piece) for piece in coded])
    labels = np.searchsorted(languages, sample.lang.to_numpy())
    return languages, train(windows, lengths, labels, len(languages))


def pool_texts(p: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text's places: texts x languages. Every text has a byte at least."""
    languages = len(p["bias"])
    sizes = np.array([len(t) for t in texts])
    per_text = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), per_text)
    padded = np.zeros(int(per_text.sum()) * WINDOW, np.uint8)
    starts = np.concatenate([[0], np.cumsum(per_text)[:-1]]) * WINDOW
    for text, start in zip(texts, starts):
        padded[start : start + len(text)] = np.frombuffer(text, np.uint8)
    windows = padded.reshape(-1, WINDOW)
    ordinal = np.arange(len(owner)) - np.repeat(starts // WINDOW, per_text)
    live = np.minimum(sizes[owner] - ordinal * WINDOW, WINDOW)
    # a short window ends in zero bytes, in training too, so it does not matter what it runs with
    sums = np.zeros((len(owner), languages))
    place = np.arange(WINDOW)[:, None]
    for at in range(0, len(owner), BLOCK):
        probabilities = label_places(p, np.ascontiguousarray(windows[at : at + BLOCK].T))
        short = np.flatnonzero(live[at : at + BLOCK] < WINDOW)
        probabilities[:, short] *= (place < live[at : at + BLOCK][short])[:, :, None]
        sums[at : at + BLOCK] = probabilities.sum(axis=0)
    pooled = np.zeros((len(texts), languages))
    np.add.at(pooled, owner, sums)
    return pooled / sizes[:, None]


def label_documents(docs: DataFrame, languages: list[str], p: dict[str, np.ndarray], block_bytes: int = 4 << 20) -> DataFrame:
    """Language and score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, p))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, network = shared.value
        for batch in batches:
            predicted, score = np.full(len(batch), UNDETERMINED, object), np.zeros(len(batch))
            held: list[tuple[int, bytes]] = []
            size = 0
            wanted = np.flatnonzero(batch.lettered.to_numpy(bool)) if names else []
            for n, i in enumerate(wanted):
                text = batch.text.iat[i].encode("utf-8", "replace")
                held.append((i, text))
                size += len(text)
                if size >= block_bytes or n + 1 == len(wanted):
                    pooled = pool_texts(network, [t for _, t in held])
                    at = [k for k, _ in held]
                    predicted[at] = np.array(names, object)[pooled.argmax(axis=1)]
                    score[at] = np.clip(pooled.max(axis=1), 0, 1)
                    held, size = [], 0
            yield pd.DataFrame({"doc_id": batch.doc_id, "lang_pred": predicted, "score": score})

    return rows.mapInPandas(label, SCORES)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, lang) outside fold 2 of 4; label every row."""
    fold = crc_mod(F.col("doc_id"), 4)
    languages, p = fit_language_network(docs.filter(fold != 2))
    held = crc_mod(F.col("doc_id"), 4) == 2
    return label_documents(docs, languages, p).select("doc_id", held.alias("held_out"), "lang_pred", "score")
