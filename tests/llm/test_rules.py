"""The rule ledger against a plain Python count."""

import random
import re

from pyspark.sql import functions as F

from voxelkeel.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    vocabulary = ["a", "bb", "cé", "d|", "#", "x!", "end."]
    out = [None, "", "  \n\t ", "one", "a b c d e", "a b c d e a b c d e", "x " * 500, "\n".join(["same line here", "other", "same line here", " "] * 4)]
    out += [" ".join(rng.choice(vocabulary[: rng.randint(1, 7)]) + rng.choice(["", "\n", "\x0b", " "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [*out, out[-1], "ab cd " * 40_000]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows: dict = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    given = texts()
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(given)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.rule_ledger(df).collect()}
    assert len(got) == len(given)
    for k, text in enumerate(given):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), k
        assert bool(r.failed_bits & 3) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_policies_and_ablations(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    ledger = rules.rule_ledger(df).cache()
    bits = [r.failed_bits for r in ledger.collect()]
    names = list(rules.RULES)
    for r in rules.ablations(ledger).collect():
        mask, bit = rules.policy_mask(r.policy), 1 << names.index(r.rule)
        assert r.kept == sum(not b & mask for b in bits)
        assert r.failed == sum(bool(b & bit) for b in bits)
        assert r.rejected_by_it_alone == sum(b & mask == bit for b in bits)
    assert ledger.filter(rules.passes("base")).count() >= ledger.filter(rules.passes("v2")).count() > 0


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, failed_bits string")
    out = rules.rule_ledger(df)
    assert out.count() == 0 and dict(out.dtypes)["failed_bits"] == "bigint"
    assert rules.rule_ledger(df.select("doc_id", F.col("text"))).columns[:2] == ["doc_id", "text"]
