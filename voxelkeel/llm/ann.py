"""Approximate nearest neighbours by inner product over balanced posting lists.

Equal vectors are indexed once, with the smallest ids that carry them. Vectors get one more component
so that nearness by distance is nearness by inner product. Centroids come from halving a bounded
sample at medians until the parts are small, so lists hold about as many vectors each. A graph over the
centroids, kept in memory, finds the lists of a vector: a vector is written to its nearest list and,
near a boundary, to further ones that lie in other directions; a query reads all lists whose distance
is within a ratio of the nearest one's, however many. The ratio is the least at which a bounded sample
of the queries, compared with all vectors, finds ``TARGET`` of its true neighbours. Within lists, scores
are exact.

Defined results: vectors that are null, zero, of another length than most, or hold a null or non-finite
component take no part, nor do rows with a null id; rows with equal ids and vectors count once, ties go to smaller ids; with fewer
candidates than asked for, all that were found are returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelkeel.llm.common import shuffle_partitions, staged

#: Vectors a list is meant to hold, and bounds of the sample and of the number of lists.
LIST_SIZE, SAMPLE, MOST_LISTS = 100, 100_000, 16_384
#: Neighbours of a centroid in the graph, and candidates a search keeps.
DEGREE, BEAM = 24, 96
#: A vector is written to at most so many lists, within this ratio of the nearest squared distance.
REPLICAS, WRITE_RATIO = 3, 1.5
#: Share of true neighbours that the read ratio is set to find, queries it is set by, and lists read at least.
TARGET, CALIBRATION, LEAST_READ = 0.97, 256, 8
#: Rows of scores a task holds before it sends on the best of each query.
HELD_SCORES = 1_000_000
NEIGHBOURS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fine)
    width = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("embedding") == (width["d"] if width else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: its ``k + 1`` smallest ids, which are all that a search can return.

    Batches are reduced before anything is shuffled, so a vector that fills the table costs a few
    ids a batch.
    """

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for vector, ids in zip(batch.embedding, batch.ids):
                found.setdefault((np.asarray(vector, np.float64) + 0.0).tobytes(), []).extend(ids)
            yield pd.DataFrame({"embedding": [np.frombuffer(v) for v in found], "ids": [sorted(set(i))[: k + 1] for i in found.values()]})

    schema = "embedding array<double>, ids array<long>"
    local = rows.select("embedding", F.array("vec_id").alias("ids")).mapInPandas(smallest, schema)
    key = F.xxhash64("embedding")
    pieces = local.groupBy("embedding", (F.col("ids")[0] % 16).alias("salt")).agg(F.flatten(F.collect_list("ids")).alias("ids"))
    short = lambda c: F.slice(F.sort_array(F.array_distinct(c)), 1, k + 1)
    pieces = pieces.select("embedding", short("ids").alias("ids"))
    whole = pieces.groupBy("embedding").agg(short(F.flatten(F.collect_list("ids"))).alias("ids"))
    return whole.select(F.col("ids")[0].alias("rep"), "ids", "embedding", key.alias("key"))


def halve(points: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Centres of parts of about equal size: each part is cut at the median along its two means' line."""
    parts, done = [points], []
    while parts:
        part = parts.pop()
        if len(part) <= most:
            done.append(part.mean(axis=0))
            continue
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(4):
            side = ((part - (a + b) / 2) @ (a - b)) > 0
            if side.all() or not side.any():
                break
            a, b = part[side].mean(axis=0), part[~side].mean(axis=0)
        along = part @ (a - b)
        order = np.argsort(along, kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return done


class CentroidGraph:
    """Centroids, each joined to near ones, with a beam search over many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.float32)
        self.norms = (self.centroids**2).sum(axis=1)
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        self.near = np.zeros((n, degree), np.int64)
        for at in range(0, n, 1024):
            block = self.centroids[at : at + 1024]
            apart = self.norms[None, :] - 2 * block @ self.centroids.T
            apart[np.arange(len(block)), at + np.arange(len(block))] = np.inf
            if degree:
                near = np.argpartition(apart, degree - 1, axis=1)[:, :degree]
                self.near[at : at + len(block)] = np.take_along_axis(near, np.take_along_axis(apart, near, axis=1).argsort(axis=1), axis=1)
        nearest = self.near[:, :1] if degree else np.arange(n)[:, None]
        apart = ((self.centroids - self.centroids[nearest[:, 0]]) ** 2).sum(axis=1)
        #: The usual squared distance of a centroid from its own neighbours.
        self.spacing = float(np.median(apart))
        # a few edges to anywhere keep the graph in one piece
        rng = np.random.default_rng(1)
        self.near = np.concatenate([self.near, rng.integers(0, n, (n, min(4, n)))], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))

    def distances(self, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances less the vectors' own squared norm."""
        return self.norms[at] - 2 * np.einsum("bd,bmd->bm", vectors, self.centroids[at])

    def search(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``k`` near centroids of each vector, nearest first, and their squared distances; -1 for none."""
        b = len(vectors)
        vectors = vectors.astype(np.float32)
        beam = max(BEAM, k)
        pool = np.full((b, beam), -1, np.int64)
        far = np.full((b, beam), np.inf, np.float32)
        opened = np.ones((b, beam), bool)
        fresh = np.repeat(self.entries[None, :], b, axis=0)
        rows = np.arange(b)
        for _ in range(beam):
            apart = self.distances(vectors, fresh)
            apart[(fresh[:, :, None] == pool[:, None, :]).any(axis=2)] = np.inf
            ids = np.concatenate([pool, fresh], axis=1)
            apart = np.concatenate([far, apart], axis=1)
            was = np.concatenate([opened, np.zeros(fresh.shape, bool)], axis=1)
            order = np.lexsort((ids, apart), axis=1)[:, :beam]
            pool, far, opened = (np.take_along_axis(x, order, axis=1) for x in (ids, apart, was))
            twin = np.zeros(pool.shape, bool)
            twin[:, 1:] = pool[:, 1:] == pool[:, :-1]
            far[twin] = np.inf
            gone = ~np.isfinite(far)
            pool[gone], opened[gone] = -1, True
            if opened.all():
                break
            nearest = np.argmin(opened, axis=1)  # the first not yet opened
            live = ~opened[rows, nearest]
            opened[rows, nearest] = True
            fresh = self.near[np.where(live, pool[rows, nearest], 0)]
        own = (vectors**2).sum(axis=1, keepdims=True)
        return pool[:, :k], np.maximum(far[:, :k] + own, 0)

    def ratios(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances of all centroids as multiples of the nearest one's, which counts as a tenth of the spacing at least."""
        vectors = vectors.astype(np.float32)
        apart = self.norms[None, :] - 2 * vectors @ self.centroids.T + (vectors**2).sum(axis=1, keepdims=True)
        apart = np.maximum(apart, 0)
        return apart / np.maximum(apart.min(axis=1, keepdims=True), 0.1 * self.spacing + 1e-9)


def spread_out(graph: CentroidGraph, found: np.ndarray, apart: np.ndarray, most: int, ratio: float) -> np.ndarray:
    """Which of the found lists a vector is written to: within the ratio, and not behind a list already chosen.

    In many dimensions a vector is further from every centroid than these are from one another, so two lists
    count as in one direction by the centroids' own spacing.
    """
    chosen = np.zeros(found.shape, bool)
    chosen[:, 0] = True
    for m in range(1, found.shape[1]):
        inside = (found[:, m] >= 0) & (apart[:, m] <= ratio * apart[:, 0] + 1e-9) & (chosen.sum(axis=1) < most)
        for earlier in range(m):
            step = graph.centroids[found[:, m]] - graph.centroids[found[:, earlier]]
            inside &= ~chosen[:, earlier] | ((step**2).sum(axis=1) * 1.5 > np.minimum(apart[:, m], graph.spacing))
        chosen[:, m] = inside
    return chosen


def read_ratio(unique: DataFrame, asked: np.ndarray, k: int, graph: CentroidGraph, lift, aim) -> float:
    """The least ratio at which the queries ``asked`` find ``TARGET`` of their true neighbours among all vectors."""
    best = unique.sparkSession.sparkContext.broadcast(asked)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = best.value
        own = (queries**2).sum(axis=1, keepdims=True)
        score = np.zeros((len(queries), 0))
        held = np.zeros((len(queries), 0, queries.shape[1]))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                x = np.stack(batch.embedding.iloc[at : at + 4096].to_numpy())
                new = queries @ x.T
                # what the query itself is, is no neighbour
                row, column = np.nonzero(np.abs(new - own) <= 1e-9 * own)
                same = (queries[row] == x[column]).all(axis=1)
                new[row[same], column[same]] = -np.inf
                near = np.argpartition(-new, min(k, len(x)) - 1, axis=1)[:, :k]
                score = np.concatenate([score, np.take_along_axis(new, near, axis=1)], axis=1)
                held = np.concatenate([held, x[near]], axis=1)
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, held = np.take_along_axis(score, order, axis=1), np.take_along_axis(held, order[:, :, None], axis=1)
        row, column = np.nonzero(np.isfinite(score))
        yield pd.DataFrame({"asked": row, "score": score[row, column], "embedding": pd.Series(list(held[row, column]), dtype=object)})

    found = unique.select("embedding").mapInPandas(compare, "asked long, score double, embedding array<double>")
    order = Window.partitionBy("asked").orderBy(F.desc("score"))
    true = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("asked", "embedding").toPandas()
    if not len(true):
        return 1.0
    lists, apart = graph.search(lift(np.stack(true.embedding.to_numpy())), 3 * REPLICAS)
    written = spread_out(graph, lists, apart, REPLICAS, WRITE_RATIO)
    ratios = graph.ratios(aim(asked))[true.asked.to_numpy()]
    needed = np.where(written, np.take_along_axis(ratios, np.maximum(lists, 0), axis=1), np.inf).min(axis=1)
    return float(np.quantile(needed, TARGET, method="higher"))


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """The ``k`` nearest found of every row of ``vectors`` (vec_id, embedding) for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    unique = staged(distinct_vectors(rows, k), "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    known = unique.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).first()
    n, largest = known["n"], known["largest"] or 1.0
    drawn = unique.filter(F.pmod("key", F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, n)))).limit(2 * SAMPLE).select("embedding").toPandas()
    lists = max(1, min(MOST_LISTS, n // LIST_SIZE))
    partitions = shuffle_partitions(spark)

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x / largest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1, keepdims=True)))], axis=1)

    def aimed(x: np.ndarray) -> np.ndarray:
        return lifted(x * (largest / np.sqrt((x**2).sum(axis=1, keepdims=True))))

    sample = lifted(np.stack(drawn.embedding.to_numpy()) if len(drawn) else np.zeros((1, 1)))
    del drawn
    graph = CentroidGraph(np.array(halve(sample, -(-len(sample) // lists), np.random.default_rng(0))))
    shared = spark.sparkContext.broadcast(graph)
    # lists that lie side by side are dealt together, so a query meets several of them in one row
    together = max(1, len(graph.centroids) // (2 * partitions))

    asking = rows.filter(is_query)
    asked = asking.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(CALIBRATION).toPandas()
    ratio = read_ratio(unique, np.stack(asked.embedding.to_numpy()), k, graph, lifted, aimed) if len(asked) else 1.0

    def grouped(row: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Row, group and lists of every group that a row has lists in."""
        order = np.lexsort((of, row))
        row, of = row[order], of[order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (of[1:] // together != of[:-1] // together)])
        return row[new], of[new] // together, np.split(of, new[1:])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                found, apart = graph.search(lifted(np.stack(part.embedding.to_numpy())), 3 * REPLICAS)
                row, column = np.nonzero(spread_out(graph, found, apart, REPLICAS, WRITE_RATIO))
                row, group, of = grouped(row, found[row, column])
                yield pd.DataFrame({"group": group, "lists": of, "ids": part.ids.to_numpy()[row], "embedding": part.embedding.to_numpy()[row]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                ratios = graph.ratios(aimed(np.stack(part.embedding.to_numpy())))
                least = min(LEAST_READ, ratios.shape[1]) - 1
                row, column = np.nonzero(ratios <= np.maximum(ratio * (1 + 1e-5), np.partition(ratios, least, axis=1)[:, least : least + 1]))
                row, group, of = grouped(row, column)
                yield pd.DataFrame({"group": group, "lists": of, "query_id": part.vec_id.to_numpy()[row], "embedding": part.embedding.to_numpy()[row]})

    postings = unique.repartition(partitions).mapInPandas(write, "group long, lists array<int>, ids array<long>, embedding array<double>")
    queries = asking.dropDuplicates(["vec_id", "embedding"]).repartition(partitions).mapInPandas(read, "group long, lists array<int>, query_id long, embedding array<double>")

    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(found).drop_duplicates().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return every[every.groupby("query_id").cumcount() < k]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups follow one another, in each first the vectors, then the queries, which pass by in batches."""
        group, held, members, found, waiting = None, [], None, [], 0
        for batch in batches:
            for (at, asks), part in batch.groupby(["group", "asks"]):
                if at != group:
                    group, held, members = at, [], None
                if not asks:
                    held.append(part[["lists", "ids", "embedding"]])
                    continue
                if not held:
                    continue
                if members is None:
                    whole = pd.concat(held)
                    x, ids, members = np.stack(whole.embedding.to_numpy()), whole.ids.to_numpy(), places(whole.lists)
                    width = np.array([len(i) for i in ids])
                q, names = np.stack(part.embedding.to_numpy()), part.query_id.to_numpy().astype(np.int64)
                for number, readers in places(part.lists).items():
                    if number not in members:
                        continue
                    inside = members[number]
                    y = x[inside]
                    for block in range(0, len(readers), 512):
                        some = readers[block : block + 512]
                        scores = q[some] @ y.T
                        keep = min(k + 1, len(y))
                        # ties at the edge stay in: whatever is as near as the last kept
                        edge = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                        row, column = np.nonzero(scores >= edge[:, None] - 1e-9 * np.abs(edge[:, None]))
                        exact = np.einsum("nd,nd->n", q[some[row]], y[column])
                        times = width[inside[column]]
                        got = pd.DataFrame({"query_id": np.repeat(names[some[row]], times), "vec_id": np.concatenate(ids[inside[column]]).astype(np.int64), "score": np.repeat(exact, times)})
                        found.append(got[got.query_id != got.vec_id])
                        waiting += len(found[-1])
                        if waiting > HELD_SCORES:
                            found = [best(found)]
                            waiting = len(found[0])
                            if waiting > HELD_SCORES // 2:
                                yield found[0]
                                found, waiting = [], 0
        if found:
            yield best(found)

    none = lambda kind: F.lit(None).cast(kind)
    dealt = postings.select("group", F.lit(False).alias("asks"), "lists", "ids", none("long").alias("query_id"), "embedding").unionByName(queries.select("group", F.lit(True).alias("asks"), "lists", none("array<long>").alias("ids"), "query_id", "embedding"))
    found = dealt.repartition(partitions, "group").sortWithinPartitions("group", "asks").mapInPandas(scan, NEIGHBOURS).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def places(lists: pd.Series) -> dict[int, np.ndarray]:
    """Positions of the rows that name each list."""
    flat = np.concatenate(lists.to_numpy())
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    number, start = np.unique(flat[order], return_index=True)
    return dict(zip(number.tolist(), np.split(row[order], start[1:])))
