"""Mixing to target weights by soft membership.

A classifier learnt from the labelled rows gives every document a probability for each domain. Rates,
one per document and not negative, are then fitted so that the expected tokens of each domain, rate times
tokens times probability added over all documents, meet the targets. The fit is projected gradient
descent on least squares, weighted by the domains' present totals; a step needs one sum per domain over
all documents, and only those sums leave the executors. Starting from rate 1, it stays as near to it
as the targets allow. The steps are what the fit learns: a rate is a fold over them, worked out from a document's own
tokens and probabilities. The fit ends when the targets are met or
no step changes anything any more; targets that are not met, because rates have a lower bound or the steps ran
out, are reported and warned of.

Defined results: a null or empty text has no tokens and the domains' prior probabilities; a null label
is no label; equal texts of equal ids get equal rates; an empty table, or one without labels, gives rate 1
everywhere; a domain with no expected tokens is left out of the targets; other columns stay, whatever their names,
columns called like added ones are replaced; every label is a domain (the model holds ``BUCKETS`` numbers for each);
texts of any length are read whole. All steps are column expressions and aggregates.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import staged, words

#: Word buckets of the classifier, bound of labelled documents per domain.
BUCKETS, SAMPLE_DOCS = 2048, 2000
#: So many words' worth of evidence at most, which keeps memberships soft.
EVIDENCE = 24.0
STEPS, CLOSE, STAGE_EVERY = 40, 1e-6, 10
#: A miss of a target that is warned of, as a share of the domain's present tokens.
WARN = 1e-3
ADDED = ("n_tokens", "domain", "posterior", "rate", "copies")


def _bucket_list(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit_domains(labelled: DataFrame, text: str, label: str) -> list[tuple[str, float, list[float]]]:
    """Domain, log prior and log word-bucket probabilities, from a bounded sample of each domain's rows."""
    rows = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("domain")).filter(F.col("domain").isNotNull() & (F.length("text") > 0))
    counts = rows.groupBy("domain").count().collect()
    if not counts:
        return []
    shares = F.map_from_arrays(F.array(*[F.lit(r["domain"]) for r in counts]), F.array(*[F.lit(min(1.0, SAMPLE_DOCS / r["count"])) for r in counts]))
    share = F.element_at(shares, F.col("domain"))
    drawn = rows.filter(F.pmod(F.xxhash64("text", F.lit("mix")), F.lit(1_000_000)) < share * 1_000_000)
    hits = drawn.select("domain", F.explode(_bucket_list(F.col("text"))).alias("bucket")).groupBy("domain", "bucket").count()
    dense = hits.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "count"))).alias("hits"), F.sum("count").alias("n"))
    logs = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.log((F.coalesce(F.element_at("hits", b), F.lit(0)) + 0.5) / (F.col("n") + 0.5 * BUCKETS)))
    total = sum(r["count"] for r in counts)
    priors = {r["domain"]: r["count"] / total for r in counts}
    found = {r["domain"]: r["logs"] for r in dense.select("domain", logs.alias("logs")).collect()}
    return [(d, math.log(priors[d]), found.get(d) or [math.log(1 / BUCKETS)] * BUCKETS) for d in sorted(priors)]


def _rows(values: list[list[float]]) -> Column:
    """Constant arrays, each written as text; all of it is folded to one literal, which a lambda would prevent."""
    return F.array(*[F.split(F.lit(",".join(map(repr, v))), ",").cast("array<double>") for v in values])


def memberships(rows: DataFrame, model: list[tuple[str, float, list[float]]]) -> DataFrame:
    """``rows`` (_text, ...) with ``_n``, the tokens, and ``_p``, the probability of each domain in the model's order."""
    read = rows.withColumn("_b", _bucket_list(F.col("_text"))).withColumn("_n", F.size("_b").cast("long"))
    weight = F.least(F.lit(EVIDENCE), F.col("_n")) / F.greatest(F.lit(1), F.col("_n"))
    logs, priors = _rows([values for _, _, values in model]), F.get(_rows([[prior for _, prior, _ in model]]), F.lit(0))
    evidence = F.transform(logs, lambda of: F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(of, b)))
    read = read.withColumn("_w", weight).withColumn("_s", F.zip_with(priors, evidence, lambda prior, e: prior + F.col("_w") * e)).drop("_b", "_w")
    read = read.withColumn("_m", F.array_max("_s")).withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.col("_m")))).drop("_s", "_m")
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return read.withColumn("_t", total).withColumn("_p", F.transform("_e", lambda x: x / F.col("_t"))).drop("_e", "_t")


def _expected(rows: DataFrame, n: int, rate: Column) -> list[float]:
    sums = rows.agg(*[F.coalesce(F.sum(rate * F.col("_n") * F.col("_p")[k]), F.lit(0.0)).alias(str(k)) for k in range(n)]).first()
    return list(sums)


def tempered_targets(present: dict[str, float], power: float = 0.7) -> dict[str, float]:
    """Weights between the domains' present shares and equal ones."""
    total = sum(present.values()) or 1.0
    raised = {d: (v / total) ** power for d, v in present.items() if v > 0}
    return {d: v / sum(raised.values()) for d, v in raised.items()}


def rate_after(steps: list[list[float]], least_rate: float, start: Column) -> Column:
    """The rate that ``steps`` (a miss per domain each) lead to from ``start``, of a row with ``_p``."""
    if not steps:
        return start
    slope = lambda miss: F.aggregate(F.zip_with(miss, F.col("_p"), lambda m, p: m * p), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(_rows(steps), start, lambda rate, miss: F.greatest(F.lit(float(least_rate)), rate - slope(miss)))


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float] | None, total_tokens: float | None, least_rate: float = 0.0) -> tuple[list[list[float]], dict[str, tuple[float, float]]]:
    """Steps that bring the expected domain tokens of ``rows`` (_n, _p) to the targets, and per domain the target and what is reached.

    Without ``total_tokens`` it is the least total at which no domain has to shrink.
    """
    present = dict(zip(domains, _expected(rows, len(domains), F.lit(1.0))))
    live = [d for d in domains if present[d] > 0]
    targets = tempered_targets(present) if targets is None else targets
    weights = {d: targets.get(d, 0.0) for d in live}
    scale = sum(weights.values())
    if not live or not scale:
        return [], {}
    weights = {d: w / scale for d, w in weights.items()}
    whole = total_tokens or max(present[d] / w for d, w in weights.items() if w)
    goal = {d: w * whole for d, w in weights.items()}
    steps: list[list[float]] = []
    start, done, now = F.lit(1.0), 0, present
    for _ in range(STEPS):
        # relative misses: in this weighting the step length 1 never overshoots
        miss = {d: (now[d] - goal[d]) / present[d] for d in live}
        if max(map(abs, miss.values())) < CLOSE:
            break
        steps.append([miss.get(d, 0.0) for d in domains])
        if len(steps) - done > STAGE_EVERY:
            rows = staged(rows.select("_n", "_p", rate_after(steps[done:-1], least_rate, start).alias("_rate")), "rates")
            start, done = F.col("_rate"), len(steps) - 1
        before, now = now, dict(zip(domains, _expected(rows, len(domains), rate_after(steps[done:], least_rate, start))))
        if max(abs(now[d] - before[d]) / present[d] for d in live) < CLOSE:
            break
    return steps, {d: (goal[d], now[d]) for d in live}


def mix_documents(docs: DataFrame, label: str = "lang", text: str = "text", targets: dict[str, float] | None = None, total_tokens: float | None = None, labelled: DataFrame | None = None, least_rate: float = 0.0, report: dict | None = None) -> DataFrame:
    """``docs`` with n_tokens, domain (the likeliest), posterior (its probability), rate and copies.

    ``labelled`` is the table that the classifier learns from, ``docs`` itself if not given; no rate is
    under ``least_rate``, so with 1 no document is given up; ``copies`` is the rate rounded up or down by a hash of the id and text, so that it is right in the mean.
    ``report`` is filled with each domain's target and the expected tokens reached; a miss of over ``WARN`` is also warned of.
    """
    given = [c for c in docs.columns if c not in ADDED]
    model = fit_domains(docs if labelled is None else labelled, text, label)
    domains = [d for d, _, _ in model]
    drawn_from = [F.col(f"`{c}`") for c in given if c in ("doc_id", text)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"), F.xxhash64(*drawn_from, F.lit("copies")).alias("_draw"))
    back = [F.col("_row").getField(c).alias(c) for c in given]
    if not model:
        return rows.select(*back, F.size(words(F.col("_text"))).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    # memberships cost most, so they are worked out once; the fit reads the two small columns of this table
    rows = staged(memberships(rows, model).select("_row", "_draw", "_n", "_p"), "memberships")
    steps, reached = fit_rates(rows.select("_n", "_p"), domains, targets, total_tokens, least_rate)
    if report is not None:
        report.update(reached)
    missed = {d: (goal, now) for d, (goal, now) in reached.items() if abs(now - goal) > WARN * max(goal, 1.0)}
    if missed:
        warnings.warn("targets not met (wanted, reached): " + ", ".join(f"{d} ({goal:.0f}, {now:.0f})" for d, (goal, now) in sorted(missed.items())), stacklevel=2)
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    draw = F.pmod(F.col("_draw"), F.lit(1 << 30)) / float(1 << 30)
    out = rows.withColumn("_rate", rate_after(steps, least_rate, F.lit(1.0)))
    return out.select(*back, F.col("_n").alias("n_tokens"), F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"), F.array_max("_p").alias("posterior"), F.col("_rate").alias("rate"), F.floor(F.col("_rate") + draw).cast("int").alias("copies"))


def repeat_by_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as its ``copies`` say, with the given columns.

    Not by a filter: pushed through the steps that make ``copies``, it would work them out again and again.
    """
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))
    rows = mixed.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.explode(times))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in columns])
