"""The language network: gradients by differences, held-out accuracy, odd texts."""

import numpy as np

from voxelkeel.llm import langid

SF = "/root/testdata/sf0.01"


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.init_parameters(3).items()}
    text = rng.integers(97, 101, (7, 4)).astype(np.uint8)
    lengths, labels = np.array([7, 5, 1, 6]), np.array([0, 2, 1, 1])
    langid_float = langid.np.float32
    _, g = langid.gradients(p, text, lengths, labels)
    for name in p:
        flat, grad = p[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:4]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = langid.gradients(p, text, lengths, labels)[0]
            flat[i] = old - 1e-2
            down = langid.gradients(p, text, lengths, labels)[0]
            flat[i] = old
            assert abs((up - down) / 2e-2 - grad[i]) < 2e-3 + 0.05 * abs(grad[i]), name
    assert langid_float is np.float32


def test_pooling_is_the_mean_over_places():
    p = langid.init_parameters(3)
    texts = [b"short", b"x" * 300, b"abc" * 129, b"z"]
    pooled = langid.pool_texts(p, texts)
    for text, got in zip(texts, pooled):
        total = np.zeros(3)
        for at in range(0, len(text), langid.WINDOW):
            part = text[at : at + langid.WINDOW]
            padded = np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)[:, None]
            total += langid.label_places(p, padded)[: len(part), 0].sum(axis=0)
        assert np.allclose(got, total / len(text), atol=1e-4)


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "12 34 !!", None), (-4, "the and of " * 20_000, None), (None, "the of and", None)], "doc_id long, text string, lang string")
    both = docs.unionByName(odd)
    got = langid.identify_languages(both).collect()
    assert len(got) == 1005
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (-1, -2, -3))
    assert by_id[-4].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [by_id[k].lang_pred == v for k, v in truth.items() if by_id[k].held_out]
    assert 150 < len(held) < 350 and np.mean(held) > 0.97


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify_languages(docs).collect()] == ["und"]
    assert langid.identify_languages(docs.limit(0)).count() == 0
