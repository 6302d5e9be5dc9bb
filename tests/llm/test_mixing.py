"""Mixing: totals meet targets, rates stay valid, odd rows."""

import contextlib
import re

import numpy as np
import pytest
import xxhash

from voxelkeel.llm import mixing

SF = "/root/testdata/sf0.01"


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def posteriors(texts, model):
    """The memberships by numpy."""
    out = []
    for text in texts:
        words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in WORD.findall((text or "").lower())]
        buckets = [(w - (1 << 64) if w >> 63 else w) % mixing.BUCKETS for w in words]
        weight = min(mixing.EVIDENCE, len(words)) / max(1, len(words))
        scores = np.array([prior + weight * sum(logs[b] for b in buckets) for _, prior, logs in model])
        p = np.exp(scores - scores.max())
        out.append((len(words), p / p.sum()))
    return np.array([n for n, _ in out], float), np.array([p for _, p in out])


def rates(n, p, goal, least, steps=mixing.STEPS):
    """Projected gradient on the misses relative to present totals."""
    rate, present = np.ones(len(n)), n @ p
    for _ in range(steps):
        miss = (rate * n) @ p / present - goal / present
        if np.abs(miss).max() < mixing.CLOSE:
            break
        new = np.maximum(least, rate - p @ miss)
        still = np.abs((new - rate) * n @ p / present).max() < mixing.CLOSE
        rate = new
        if still:
            break
    return rate


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_posteriors_and_rates_against_numpy(spark, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = mixing.fit_domains(docs, "text", "lang")
    targets, report = {"de": 2, "en": 1, "es": 4, "fr": 1}, {}
    with pytest.warns(UserWarning) if least else contextlib.nullcontext():
        got = mixing.mix_documents(docs, targets=targets, total_tokens=500_000.0, least_rate=least, report=report).collect()
    n, p = posteriors([r.text for r in got], model)
    assert [r.n_tokens for r in got] == n.tolist()
    assert np.allclose([r.posterior for r in got], p.max(axis=1), atol=1e-9)
    assert [r.domain for r in got] == [model[k][0] for k in p.argmax(axis=1)]
    want = rates(n, p, np.array([2, 1, 4, 1]) / 8 * 500_000, least)
    assert np.allclose([r.rate for r in got], want, atol=1e-6)
    assert np.allclose([report[d][1] for d in ("de", "en", "es", "fr")], (want * n) @ p, rtol=1e-6)
    if not least:
        assert [report[d][1] for d in ("de", "en", "es", "fr")] == pytest.approx([125_000, 62_500, 250_000, 62_500], rel=1e-4)


def test_expected_tokens_meet_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    targets = {"de": 1, "en": 1, "es": 1, "fr": 1}
    out = mixing.mix_documents(docs, targets=targets, total_tokens=100_000.0)
    assert out.columns == ["doc_id", "text", "lang", "n_tokens", "domain", "posterior", "rate", "copies"]
    got = out.collect()
    assert sum(r.domain == r.lang for r in got) > 0.97 * docs.count()
    by = {d: sum(r.copies * r.n_tokens for r in got if r.domain == d) for d in targets}
    assert all(15_000 < v < 35_000 for v in by.values())


def test_targets_out_of_reach_are_reported(spark):
    docs = spark.createDataFrame([(k, "one two three " * 10, "xy"[k % 2]) for k in range(40)], "doc_id long, text string, lang string")
    report = {}
    with pytest.warns(UserWarning, match="targets not met"):
        mixing.mix_documents(docs, total_tokens=300.0, least_rate=1.0, report=report)
    assert sum(now for _, now in report.values()) == pytest.approx(1200) and sum(goal for goal, _ in report.values()) == pytest.approx(300)


def test_many_domains_long_texts_and_clashing_columns(spark):
    rows = [(k, f"w{k % 80} " * (50_000 if k == 3 else 20), f"d{k % 80}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ["_s", "_e", "_t", "_p", "_n", "_b", "_rate", "_final", "_row", "_text", "_draw", "_buckets"]
    for name in names:
        df = df.withColumn(name, mixing.F.lit("given"))
    out = mixing.mix_documents(df)
    assert out.columns == [*df.columns, *mixing.ADDED]
    got = out.collect()
    assert len(got) == 400 and len({r.domain for r in got}) > 70
    assert all(r[name] == "given" for r in got for name in names)
    assert mixing.repeat_by_copies(out, df.columns).columns == df.columns


def test_least_rate_keeps_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    mixed = mixing.mix_documents(docs, least_rate=1.0)
    assert all(r.rate >= 1 and r.copies >= 1 for r in mixed.collect())
    copies = mixing.repeat_by_copies(mixed, docs.columns)
    assert copies.columns == docs.columns and copies.count() > 1000
    assert copies.select("doc_id").distinct().count() == 1000


def test_rates_may_reach_zero(spark):
    rows = [(k, "alpha beta gamma " * 30 if k % 2 else "eins zwei drei " * 30, "x" if k % 2 else "y") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = mixing.mix_documents(docs, targets={"x": 1.0, "y": 0.0}, total_tokens=9000.0).collect()
    assert all(r.rate == pytest.approx(1.0 if r.lang == "x" else 0.0, abs=1e-3) for r in out)


def test_odd_rows(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "words of text", None, 1), (3, "words of text", None, 1), (None, "more words", "fr", 1), (4, "la le " * 30_000, "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate int")
    out = mixing.mix_documents(docs).collect()
    assert len(out) == 6 and all(r.rate >= 0 and r.copies >= 0 for r in out)
    twin = [r.rate for r in out if r.doc_id == 3]
    assert twin[0] == twin[1]
    bare = mixing.mix_documents(docs.withColumn("lang", mixing.F.lit(None).cast("string"))).collect()
    assert [r.rate for r in bare] == [1.0] * 6
    assert mixing.mix_documents(docs.limit(0)).count() == 0
