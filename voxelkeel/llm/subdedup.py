"""Substring deduplication by hashing lines and the clauses within them.

A unit is a line, cut further behind words that end in ``.!?,;:``, so that a passage which begins and ends inside
lines still holds whole units. Units are normalised (A-Z in lower case, runs of white space as one space) and
their digests grouped over all documents. The earliest occurrence, by document id, then place, stays; every
later one is marked. Neighbouring marked units make a run, across line ends too, and a run of at least ``min_words``
words is taken out with the white space behind it; shorter runs, such as a repeated heading or a
common clause, stay. A digest has 64 bits; a chance match would mark one unit and not a run. The places of what was taken out refer to the text as it was, and the text left is the
original without them.

Defined results: a null text stays null and an empty one empty, with no units; rows with equal ids and
texts are one document and treated alike, rows with equal ids and other texts are ranked by a hash of
the text; a null id ranks last; an empty table gives an empty result; other columns stay as they are,
whatever their names, and a column called like one that is added is replaced; texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelkeel.llm.common import HOT_SHARE, staged

MIN_WORDS = 30
ADDED = ("n_units", "n_removed", "n_repeated", "removed_start", "removed_end", "kept_doc_id")
UNITS = "doc_id long, text_key long, unit int, digest long"
#: One unit in this many is looked at to find digests that are so frequent that they are joined apart.
LOOK = 64
#: Words up to one that ends in a stop, a line or the text, with the white space behind.
UNIT = re.compile(r"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?,;:][\x20\x09\x0B-\x0D]+(?=[^\x20\x09-\x0D]))*+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def units_of(text: str | None) -> list[re.Match]:
    return list(UNIT.finditer(text)) if text else []


def normal(unit: str) -> bytes:
    return b" ".join(unit.encode("utf-8", "replace").lower().split())


def text_units(docs: DataFrame) -> DataFrame:
    """A row for every unit of ``docs`` (_id, _key, _text): doc_id, text_key, unit (its number), digest."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, unit, digest = [], [], []
            for i, text in enumerate(batch._2):
                found = UNIT.findall(text) if text else []
                at += [i] * len(found)
                unit += range(len(found))
                digest += [hashlib.blake2b(normal(u), digest_size=8).digest() for u in found]
            digest = np.frombuffer(b"".join(digest), "<i8")
            ids = pd.arrays.IntegerArray(batch._0.to_numpy()[at], batch._3.to_numpy(bool)[at])
            yield pd.DataFrame({"doc_id": ids, "text_key": batch._1.to_numpy()[at], "unit": np.array(unit, np.int32), "digest": digest})

    # a null among ids would make them floating-point numbers in pandas
    given = F.coalesce("_id", F.lit(0).cast("long"))
    return docs.select(given.alias("_0"), F.col("_key").alias("_1"), F.col("_text").alias("_2"), F.col("_id").isNull().alias("_3")).mapInPandas(rows, UNITS)


def repeated_units(units: DataFrame) -> tuple[DataFrame, dict[int, tuple]]:
    """Units that occur more than once: doc_id, text_key, unit, later (not the first), kept (doc_id of the first).

    Rows are shuffled once by digest and compared within a sorted window. Digests that a look at part of the rows finds frequent,
    at most twice ``HOT_SHARE``, stay where they are and meet nothing: their first occurrences are aggregated and returned as
    digest -> (doc_id as text, text_key, unit). Their rows have no ``later`` and the digest as ``kept``.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "text_key", "unit")
    looked = units.filter(F.pmod(F.xxhash64("doc_id", "text_key", "unit"), F.lit(LOOK)) == 0)
    bound = max(8.0, units.count() / LOOK / (2 * HOT_SHARE))
    frequent = [r.digest for r in looked.groupBy("digest").count().filter(F.col("count") > bound).select("digest").collect()]
    is_hot = F.col("digest").isin(frequent)
    hot, cold = units.filter(is_hot), units.filter(~is_hot)
    found = hot.groupBy("digest").agg(F.min(rank).alias("first")).collect() if frequent else []
    firsts = {r.digest: (None if r.first.last else str(r.first.doc_id), r.first.text_key, r.first.unit) for r in found}
    apart = hot.select("doc_id", "text_key", "unit", F.lit(None).cast("boolean").alias("later"), F.col("digest").alias("kept"))
    order = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last(), "text_key", "unit")
    # the first one's place is told by its columns, as a struct of them would be shuffled beside them
    first = [F.first(c).over(order).alias(f"first_{c}") for c in ("doc_id", "text_key", "unit")]
    together = cold.select("*", *first, ((F.row_number().over(order) > 1) | F.lead("unit").over(order).isNotNull()).alias("again")).filter("again")
    later = ~(F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("text_key") == F.col("first_text_key")) & (F.col("unit") == F.col("first_unit")))
    return apart.unionByName(together.select("doc_id", "text_key", "unit", later.alias("later"), F.col("first_doc_id").alias("kept"))), firsts


def runs_of(units: list[re.Match], marked: set[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of every run of neighbouring ``marked`` units with at least ``min_words`` words."""
    runs, first, words = [], None, 0
    for k in range(len(units) + 1):
        if k < len(units) and k in marked:
            first = k if first is None else first
            words += len(units[k][0].encode("utf-8", "replace").split())
        elif first is not None:
            if words >= min_words:
                runs.append((first, k - 1))
            first, words = None, 0
    return runs


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with later occurrences of repeated passages taken out of the text.

    Adds n_units, n_removed (units taken out), n_repeated (units in passages that stand elsewhere too, kept ones
    included), and for each run taken out its place in the original text (removed_start, removed_end, in
    characters) and the document that keeps its first unit.
    """
    names = [c for c in docs.columns if c not in ADDED]
    # the text goes along once
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    whole = whole.withColumn("_key", F.xxhash64("_text"))
    found, frequent = repeated_units(staged(text_units(whole), "units"))
    marks = found.groupBy(F.col("doc_id").alias("_of"), F.col("text_key").alias("_of_key")).agg(F.collect_set(F.struct("unit", "later", "kept")).alias("_marks"))
    joined = whole.join(marks, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_of_key")), "left")
    fields = {"text": "string", "n_units": "long", "n_removed": "long", "n_repeated": "long", "removed_start": "array<long>", "removed_end": "array<long>", "kept_doc_id": "array<long>"}
    cut_type = ", ".join(f"{k} {v}" for k, v in fields.items())

    @F.pandas_udf(cut_type)
    def cut(text: pd.Series, marks: pd.Series, doc_id: pd.Series, text_key: pd.Series) -> pd.DataFrame:
        out = []
        for given, marked, own_id, own_key in zip(text, marks, doc_id, text_key):
            units = units_of(given)
            if marked is None or not len(marked):
                out.append((given, len(units), 0, 0, [], [], []))
                continue
            # equal rows mark a unit as first and as later: together they keep it
            firsts = {m["unit"] for m in marked if m["later"] is not None and not m["later"]}
            later = {m["unit"]: m["kept"] for m in marked if m["later"] and m["unit"] not in firsts}
            for m in marked:
                if m["later"] is None:
                    first = frequent[m["kept"]]
                    if first == (own_id if isinstance(own_id, str) else None, own_key, m["unit"]):
                        firsts.add(m["unit"])
                    else:
                        later[m["unit"]] = None if first[0] is None else int(first[0])
            repeated = sum(b - a + 1 for a, b in runs_of(units, firsts | later.keys(), min_words))
            runs = runs_of(units, later.keys(), min_words)
            spans = [(units[a].start(), units[b].end()) for a, b in runs]
            kept, at = [], 0
            for begin, end in spans:
                kept.append(given[at:begin])
                at = end
            ids = [None if later[a] is None or later[a] != later[a] else int(later[a]) for a, _ in runs]
            out.append(("".join(kept) + given[at:] if given else given, len(units), sum(b - a + 1 for a, b in runs), repeated, [a for a, _ in spans], [b for _, b in spans], ids))
        return pd.DataFrame(out, columns=list(fields))

    with_cut = joined.select("_row", cut("_text", "_marks", F.col("_id").cast("string"), "_key").alias("_cut"))
    return with_cut.select(*[(F.col("_cut")["text"] if c == "text" else F.col("_row").getField(c)).alias(c) for c in names], *[F.col("_cut")[c].alias(c) for c in fields if c != "text"])
