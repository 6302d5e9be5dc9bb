"""Neighbours against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelkeel.llm import ann

SF = "/root/testdata/sf0.1"


def brute(vectors, queries, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        score = x @ np.array(vectors[q], np.float64)
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall_of(got, want):
    return np.mean([len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) / len(w) for q, w in want.items()])


def collect(df):
    got: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    want = brute(vectors, [v for v in vectors if v % 20 == 0], 20)
    got = collect(ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall_of(got, want) > 0.95
    for q, found in got.items():
        for v, score in found:
            assert abs(score - float(np.dot(np.float64(vectors[q]), np.float64(vectors[v])))) < 1e-9


def test_recall_with_unequal_norms_and_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 12)) * rng.uniform(0.2, 3, (3000, 1))
    x[500:1500] = x[500]
    vectors = {k: v.tolist() for k, v in enumerate(x)}
    df = spark.createDataFrame([(k, v, "x") for k, v in vectors.items()], "vec_id long, embedding array<double>, rank string").repartition(5)
    want = brute(vectors, range(0, 3000, 20), 20)
    got = collect(ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0))
    assert recall_of(got, want) > 0.9
    assert [v for v, _ in got[600][:3]] == [v for v, _ in want[600][:3]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 2.0]), (8, [0.5, 0.5]), (9, [-1.0, 0.0]), (20, [0.0, 0.0]), (8, [0.5, 0.5]), (40, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(40, 1.0), (8, 0.5), (9, -1.0)], 40: [(0, 1.0), (8, 0.5), (9, -1.0)]}
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    points = np.random.default_rng(0).normal(size=(1000, 5))
    assert len(ann.halve(points, 40, np.random.default_rng(0))) == 32


def test_recall_with_many_lists(spark):
    """Thousand lists, of which none need be near: far more than a fixed number of lists must be read."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(100_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    asked = np.arange(0, len(x), 250)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    want = {int(q): [(int(v), 0.0) for v in np.argpartition(-s, 20)[:20]] for q, s in zip(asked, score)}
    got = collect(ann.nearest_neighbours(df, F.col("vec_id") % 250 == 0))
    assert got.keys() == want.keys()
    assert recall_of(got, want) > 0.95


def test_boundary_vectors_are_written_to_several_lists():
    x = np.random.default_rng(3).normal(size=(20_000, 64))
    graph = ann.CentroidGraph(np.array(ann.halve(x, 100, np.random.default_rng(0))))
    found, apart = graph.search(x[:500], 3 * ann.REPLICAS)
    copies = ann.spread_out(graph, found, apart, ann.REPLICAS, ann.WRITE_RATIO).sum(axis=1)
    assert copies.mean() > 1.5 and copies.max() <= ann.REPLICAS
