"""The quality classifier: held-out labels, odd texts, the risk."""

import numpy as np

from voxelkeel.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word"), (-4, "#$% " * 50_000), (None, "the and of")], "doc_id long, text string")
    got = quality.judge_quality(docs.select("doc_id", "text").unionByName(odd), labels).collect()
    assert len(got) == docs.count() + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [(r.quality, by_id[r.doc_id]) for r in labels.collect() if by_id[r.doc_id].held_out]
    good, bad = [s.predicted for q, s in held if q == 1], [s.predicted for q, s in held if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15
    assert by_id[-4].predicted == 0


def test_keep_good_keeps_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.keep_good(docs.withColumnRenamed("source", "score"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "score", "n_chars"]
    assert 0.8 < kept.count() / docs.count() < 0.95


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.judge_quality(docs, labels).collect()] == [0.5] * 3
    assert quality.judge_quality(docs.limit(0), labels).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert quality.judge_quality(docs, nulls).count() == 3


def test_positive_unlabelled_learning_separates_hidden_negatives():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (2000, 3))
    hidden = rng.random(6000) < 0.3
    unlabelled = np.where(hidden[:, None], rng.normal(-2, 1, (6000, 3)), rng.normal(2, 1, (6000, 3)))
    net = quality.fit_ensemble(positive, unlabelled, 0.7)
    score = net.score(unlabelled)
    assert (score[hidden] < 0.3).mean() > 0.95 and (score[~hidden] >= 0.3).mean() > 0.95


def test_risk_and_gradient_against_differences():
    """The risk in plain loops, and its gradient where it falls and where it is turned round."""
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (40, 4))
    net, seen = quality.Network(u), []
    by_score = lambda x: x[np.argsort(net.forward(x)[1])]
    for p, u, prior in ((p, u, 0.4), (by_score(p)[-1:], by_score(u)[:3], 0.02), (by_score(p)[-5:], by_score(u)[:9], 0.98)):
        one = lambda x: float(sum(np.tanh(sum(x[i] * net.p[0][i, h] for i in range(4)) + net.p[1][h]) * net.p[2][h] for h in range(quality.HIDDEN)) + net.p[3][0])  # noqa: B023, E731
        loss = lambda s: np.log1p(np.exp(s))
        good, bad = quality.pu_risk(net, p, u, prior)
        assert np.isclose(good, prior * np.mean([loss(-one(x)) for x in p]))
        assert np.isclose(bad, np.mean([loss(one(x)) for x in u]) - prior * np.mean([loss(one(x)) for x in p]))

        def turned():
            good, bad = quality.pu_risk(net, p, u, prior)  # noqa: B023
            return good + bad if bad >= 0 else -bad

        gradient = quality.pu_gradient(net, p, u, prior)
        for v, g in zip(net.p, gradient):
            for at in np.ndindex(v.shape):
                old = v[at]
                v[at] = old + 1e-5
                up = turned()
                v[at] = old - 1e-5
                assert np.isclose((up - turned()) / 2e-5, g[at], atol=1e-6)
                v[at] = old
        seen.append(bad >= 0)
    assert set(seen) == {True, False}


def test_prior_is_the_lower_end():
    assert quality.least_share(60, 8) < 60 / 68 and abs(quality.least_share(6_000_000, 800_000) - 60 / 68) < 1e-3
    assert quality.least_share(1, 0) < 0.5 and quality.least_share(0, 50) == 0.02


def test_describe_has_every_feature():
    for text in (None, "", " ", "a", "a a a\na a a", "É!", "x" * 100_000):
        row = quality.describe(text)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()
