"""Similarity join on word n-grams with token-combination prefixes, and its components.

A document's tokens are its distinct word n-grams. Texts with equal token sets become one class. Tokens
are ordered from rare to frequent. Two sets that are similar enough share a token within short
prefixes of that order; here a prefix runs on until enough of it is left whatever the other set may
lack, and is indexed by single tokens for rare ones and by pairs of tokens of one part (of ``PARTS``) for
frequent ones, which alone would be shared by many unrelated texts. Sets below ``SMALL`` tokens are indexed by
single tokens throughout; sizes near the bound are indexed both ways, so any two similar sets meet.

Candidates are verified in steps that lose nothing. First every member of an index list against one
member of the list, whose links are joined to components. Then, in lists that still hold several
components, all members of different components, list part against list part, by sketches that
bound the difference of two sets from below: of what a sketch can't refute, only enough pairs to join
what might be joined are compared token by token, and when most of a group has so become one
component, all that is left between components. So large groups of near copies cost a few
comparisons a member, not one a pair.

Defined results: a document without words, or null, has no tokens, is linked with nothing and is its own
component; with fewer than ``n`` words its whole sequence is its one token; equal rows are in one class; a
null id gets the smallest id of its component, if any; an empty table gives an empty result; other
columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import join_keeping_hot, shuffle_partitions, staged
from voxelkeel.llm.components import connected

#: Frequent tokens that tasks know: at most so many, so their broadcast has a fixed bound.
KNOWN = 1 << 20
#: A token in more texts than this is indexed by pairs.
FREQUENT = 512
PARTS, SMALL = 64, 128
#: Members of a list part that one task compares with another part's.
LIST_PART = 1000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX[1]
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX[0]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 2
        return value


def token_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.int64, len(found)).view(np.uint64)
    if len(h) < n:
        whole = np.uint64(len(h))
        for x in h:
            whole = mixed(np.array([whole * _MIX[2] + x], np.uint64))[0]
        return np.array([whole], np.uint64)
    span = len(h) - n + 1
    total = np.zeros(span, np.uint64)
    for k in range(n):
        total = (total + h[k : k + span]) * _MIX[k % 4]
    total = np.sort(mixed(total))
    return total if (total[1:] != total[:-1]).all() else np.unique(total)


class KnownTokens:
    """Counts of the frequent tokens; 0 for all others."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.tokens & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def count(self, tokens: np.ndarray) -> np.ndarray:
        found = np.zeros(len(tokens), np.int64)
        if len(self.tokens):
            maybe = np.flatnonzero(self.bits[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens[maybe]
            found[maybe[hit]] = self.counts[at[hit]]
        return found


def signatures(tokens: np.ndarray, known: KnownTokens, percent: int) -> np.ndarray:
    """What a set is indexed by."""
    n = len(tokens)
    spare = n - -(-percent * n // 100)  # tokens that a similar set may lack
    count = known.count(tokens)
    order = np.argsort(count, kind="stable")  # tokens are sorted, so ties stay in their order
    ranked, count = tokens[order], count[order]
    out = []
    if n < SMALL:
        out.append(mixed(ranked[: spare + 1] ^ _MIX[3]))
    if n >= -(-percent * SMALL // 100):
        rare = int(np.searchsorted(count, FREQUENT, side="right"))
        singles = ranked[: min(rare, spare + 1)]
        out.append(mixed(singles))
        need = spare + 1 - len(singles)
        if need > 0:
            frequent = ranked[rare:]
            part = (frequent & np.uint64(PARTS - 1)).astype(np.int64)
            # of each part all tokens but one count, since a lone token makes no pair
            first = np.zeros(len(part), bool)
            first[np.unique(part, return_index=True)[1]] = True
            enough = int(np.searchsorted(np.cumsum(~first), need)) + 1
            frequent, part = frequent[:enough], part[:enough]
            for p in np.unique(part):
                own = np.sort(frequent[part == p])
                a, b = np.triu_indices(len(own), 1)
                out.append(mixed(mixed(own[a]) * _MIX[2] + own[b]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch_bits(n: int) -> int:
    return 1024 if n <= 1024 else 2048 if n <= 4096 else 8192 if n <= 16384 else 32768


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of token counts by bit; two sketches differ in no more bits than their sets differ in tokens."""
    size = sketch_bits(len(tokens))
    bits = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch brought to ``size`` bytes: bit n goes to bit n modulo the new length."""
    wide = np.frombuffer(raw, np.uint8)
    return np.bitwise_xor.reduce(wide.reshape(-1, size), axis=0)


def may_be_similar(n_a, n_b, differing, percent: int):
    """Can sets of these sizes, which differ in at least so many tokens, be similar enough?"""
    sizes = (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
    return sizes & (differing * (100 + percent) <= (100 - percent) * (n_a + n_b))


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_tokens(docs: DataFrame, n: int) -> KnownTokens:
    """The most frequent tokens, at most ``KNOWN``, from tokens that recur within a scan partition's pieces."""

    def recurring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, size = WordHashes(), [], 0

        def counted() -> pd.DataFrame:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"token": tokens[times > 1].view(np.int64), "n": times[times > 1].astype(np.int64)})

        for batch in batches:
            for text in batch.text:
                held.append(token_set(text, n, hashes))
                size += len(held[-1])
                if size > 4_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = staged(_text_rows(docs).mapInPandas(recurring, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 3"), "recurring")
    step = F.floor(F.log2(F.col("n"))).cast("int")
    sizes = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}
    least, total = 64, 0
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > KNOWN:
            break
        least = s
    table = counts.filter(step >= least).toPandas()
    return KnownTokens(table.token.to_numpy(np.int64).view(np.uint64), table.n.to_numpy(np.int64))


def index_rows(docs: DataFrame, known: KnownTokens, n: int, percent: int) -> DataFrame:
    """A row for every document: doc_id, digest of its token set, n_shingles, signatures, sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, tokens_known = WordHashes(), shared.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                out = []
                for text in part.text:
                    tokens = token_set(text, n, hashes)
                    out.append((xxhash.xxh3_128_digest(tokens.tobytes()), len(tokens), signatures(tokens, tokens_known, percent).view(np.int64), sketch(tokens)) if len(tokens) else (None, 0, None, None))
                yield pd.DataFrame(out, columns=["digest", "n_shingles", "sigs", "sketch"]).assign(doc_id=part.doc_id.array)[["doc_id", "digest", "n_shingles", "sigs", "sketch"]]

    return _text_rows(docs).mapInPandas(rows, "doc_id long, digest binary, n_shingles long, sigs array<long>, sketch binary")


def token_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``id`` and ``tokens`` of the classes in ``wanted`` (id, digest, min_doc), from a text of each."""
    ids = wanted.select("min_doc").distinct()
    rows = _text_rows(docs)
    texts = rows.join(ids, rows["doc_id"].eqNullSafe(ids["min_doc"]), "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                found = [token_set(t, n, hashes) for t in batch.text.iloc[at : at + 500]]
                yield pd.DataFrame({"digest": [xxhash.xxh3_128_digest(t.tobytes()) for t in found], "tokens": [t.view(np.int64) for t in found]})

    found = texts.mapInPandas(sets, "digest binary, tokens array<long>")
    return found.join(wanted.select("id", "digest"), "digest").select("id", "tokens").dropDuplicates(["id"])


def refute_by_sketch(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches leave possible."""
    side = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_a, n_b = batch.n_a.to_numpy(), batch.n_b.to_numpy()
            differing = np.zeros(len(batch), np.int64)
            for i, (s, t) in enumerate(zip(batch.s_a, batch.s_b)):
                size = min(len(s), len(t))
                differing[i] = np.bitwise_count(folded(s, size) ^ folded(t, size)).sum()
            yield batch.loc[may_be_similar(n_a, n_b, differing, percent), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").filter(sizes).mapInPandas(keep, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar enough, compared token by token."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = staged(token_sets(docs, classes.select("id", "digest", "min_doc").join(ids, "id", "left_semi"), n), "sets")
    side = lambda k: sets.select(F.col("id").alias(k), F.col("tokens").alias(f"t_{k}"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * both >= percent * (F.size("t_a") + F.size("t_b") - both)).select("a", "b")


def _forest(passing: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of possible pairs as few as join every label that any of them joins, best-connected members first."""
    group = np.unique(label, return_inverse=True)[1]
    left, right = [], []
    for k in np.argsort(-passing.sum(axis=1), kind="stable"):
        near = np.flatnonzero(passing[k])
        near = near[group[near] != group[k]]
        if near.size:
            groups, first = np.unique(group[near], return_index=True)
            left.append(np.full(len(first), k))
            right.append(near[first])
            group[np.isin(group, groups)] = group[k]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def across_components(lists: DataFrame, percent: int, partitions: int, forest: bool) -> DataFrame:
    """Pairs (sig, a, b) of different components in one list that sizes and sketches leave possible.

    ``lists`` has sig, size (of the list), id, label, n, sketch. A long list is split into parts, and
    each part meets each other part in a task of its own. With ``forest`` only pairs enough to
    join what all of them would join are given.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / LIST_PART)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = lists.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label", "n", "sketch")
    rows = rows.repartition(partitions, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def compare(ids: np.ndarray, label: np.ndarray, n: np.ndarray, own: np.ndarray, sketches: list, i: int, j: int):
        if (label == label[0]).all():
            return None
        size = min(map(len, sketches))
        wide = np.array([np.frombuffer(s, np.uint8) if len(s) == size else folded(s, size) for s in sketches]).view(np.uint64)
        passing = np.zeros((len(ids), len(ids)), bool)
        for k in np.flatnonzero(own == i):
            apart = label != label[k]
            if i != j:
                apart &= own == j
            other = np.flatnonzero(apart & may_be_similar(n[k], n, 0, percent))
            if other.size:
                differing = np.bitwise_count(wide[other] ^ wide[k]).sum(axis=1).astype(np.int64)
                passing[k, other[may_be_similar(n[k], n[other], differing, percent)]] = True
        if not passing.any():
            return None
        passing |= passing.T
        left, right = _forest(passing, label) if forest else np.nonzero(np.triu(passing))
        return np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch, last in _with_last(batches):
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            sig, i, j = (rest[c].to_numpy() for c in ("sig", "i", "j"))
            edges = np.flatnonzero((sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = [0, *edges.tolist(), *([len(rest)] if last else [])]
            ids, label, n, own = (rest[c].to_numpy() for c in ("id", "label", "n", "own"))
            sketches = rest.sketch.tolist()
            out = []
            for a, b in zip(edges, edges[1:]):
                if b - a > 1 and (found := compare(ids[a:b], label[a:b], n[a:b], own[a:b], sketches[a:b], i[a], j[a])) is not None:
                    out.append((np.full(len(found[0]), sig[a]), *found))
            if out:
                yield pd.DataFrame(dict(zip(("sig", "a", "b"), map(np.concatenate, zip(*out)))))
            rest = rest.iloc[edges[-1] :]

    return rows.mapInPandas(pairs, "sig long, a long, b long")


def _with_last(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
    before = None
    for batch in batches:
        if len(batch):
            if before is not None:
                yield before, False
            before = batch
    if before is not None:
        yield before, True


def similar_classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indexed documents, classes of equal token sets, and the root of every class that is joined to a smaller one."""
    spark = docs.sparkSession
    rows = staged(index_rows(docs, frequent_tokens(docs, n), n, percent), "indexed")
    grouped = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("min_doc"), F.count(F.lit(1)).alias("members"), F.first(F.struct(F.col("n_shingles").alias("n"), "sigs", "sketch")).alias("x"))
    classes = staged(grouped.select(F.monotonically_increasing_id().alias("id"), "digest", "min_doc", "members", "x.n", "x.sigs", "x.sketch"), "classes")
    postings = classes.select("id", F.explode("sigs").alias("sig"))
    heads = postings.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("head")).filter("size > 1").select("sig", "size", F.col("head.id").alias("head"))
    shared = staged(postings.join(heads, "sig"), "shared")
    stars = shared.filter("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    possible = staged(refute_by_sketch(stars, classes, percent), "stars")
    links = staged(verified(possible, docs, classes, n, percent), "links")
    roots, tested = connected(links), possible
    # lists of two have been compared in full
    lists, sketches = shared.filter("size > 2").select("sig", "size", "id"), classes.select("id", "n", "sketch")
    for forest in (True, True, False):
        labelled = staged(lists.join(roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root"), "labelled")
        split = labelled.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("sig")
        members = labelled.join(split, "sig", "left_semi").join(sketches, "id")
        found = staged(across_components(members, percent, shuffle_partitions(spark), forest), "across")
        fresh = staged(found.select("a", "b").distinct(), "pairs").join(tested, ["a", "b"], "left_anti")
        fresh = staged(fresh, "fresh")
        if not fresh.isEmpty():
            links = links.unionByName(staged(verified(fresh, docs, classes, n, percent), "links"))
            roots, tested = connected(links), tested.unionByName(fresh)
        # a list in which nothing was possible has been settled for good
        lists = lists.join(found.select("sig").distinct(), "sig", "left_semi")
    return rows, classes, roots


def similarity_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Component of every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when the shared tokens are at least ``percent`` per cent of their joint ones; a
    component is named by its smallest doc_id.
    """
    rows, classes, roots = similar_classes(docs, n, percent)
    labelled = staged(classes.select("id", "digest", "min_doc", "members").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "roots")
    names = labelled.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    named = labelled.join(names, "root").select("digest", "members", "component_id")
    plain = rows.select("doc_id", "n_shingles", "digest")
    some = join_keeping_hot(plain.filter("digest is not null"), named, "digest", "members", rows.count()).select("doc_id", "n_shingles", "component_id")
    return some.unionByName(plain.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id.

    All rows that carry the keeper's doc_id stay, and so do rows with a null id.
    """
    components = similarity_components(docs, n, percent)
    dropped = components.filter("n_shingles > 0 and doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
