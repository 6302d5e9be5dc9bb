"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; its measurements and one bit per failed rule are kept.
A policy is a versioned set of rules that reject, so a policy applies as a bit mask to the stored
bits, and the effect of leaving a rule out is counted from the same bits.

Defined results: a null or blank text has no words, fails ``few_words`` and no ratio rule; repeated
rows are judged alike, one by one; an empty table gives an empty ledger; columns of the input stay
unless they carry the name of a ledger column, which then replaces them; texts of any length are
judged whole. All steps are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import words

WINDOW = 5

#: Fixed values. A rule fails where its condition holds, all in whole numbers; bit n is the nth rule.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "exclamations": "100 * n_exclaims > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "few_lettered_words": "100 * n_lettered_words < 60 * n_words",
}
#: Fixed values. Which rules reject, by version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_lettered_words")


def policy_mask(version: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[version])


def _chars_of(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements the rules read.

    Windows of five words are compared by a hash of their words' hashes, inside the row: no window
    leaves its document, and only texts with an equal pair of windows are sorted.
    """
    given = [c for c in docs.columns if c not in MEASURES and c != "failed_bits"]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    stage = docs.select(*[F.col(f"`{c}`") for c in given], whole.alias("_text"), words(whole).alias("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]", "")) > 0)
    stage = stage.select(
        *[F.col(f"`{c}`") for c in given],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        _chars_of(F.col("_text"), r"[#*$%&|<>]").alias("n_symbols"),
        _chars_of(F.col("_text"), "!").alias("n_exclaims"),
        F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_lettered_words"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    last = F.col("n_words").cast("int") - WINDOW
    windows = F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)]))
    )
    stage = stage.withColumn("_windows", windows)
    placed = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    stage = stage.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines"))).withColumn("_placed", placed).drop("_lines", "_hashes", "_windows")

    def twin(x: Column, j: Column) -> Column:
        before, after = F.get(F.col("_placed"), j - 1), F.get(F.col("_placed"), j + 1)
        return F.coalesce(x["h"] == before["h"], F.lit(False)) | F.coalesce(x["h"] == after["h"], F.lit(False))

    stage = stage.withColumn("_starts", F.sort_array(F.transform(F.filter("_placed", twin), lambda x: x["i"]))).drop("_placed")
    covered = F.transform("_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(p - F.get(F.col("_starts"), j - 1), F.lit(WINDOW))))
    stage = stage.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return stage.select(*[F.col(f"`{c}`") for c in given], *MEASURES)


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds measurements and ``failed_bits``: bit n is set where the nth of ``RULES`` fails."""
    bits = F.lit(0).cast("long")
    for n, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << n)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("failed_bits", bits)


def passes(version: str) -> Column:
    """Does a ledger row pass this policy?"""
    return F.col("failed_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def ablations(ledger: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents kept, documents this rule alone rejects.

    The ledger is counted by its distinct bits first, so what follows is a handful of rows.
    """
    counted = ledger.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    cases = F.array(*[
        F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(policy_mask(v)).cast("long").alias("mask"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
        for v, rules in POLICIES.items() for r in rules
    ])
    hit = F.col("failed_bits").bitwiseAND(F.col("c.mask"))
    return counted.withColumn("c", F.explode(cases)).groupBy("c.policy", "c.rule").agg(
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit == F.col("c.bit"), F.col("n")).otherwise(0)).alias("rejected_by_it_alone"),
    )
