"""Dedup of lines and clauses against a plain Python pass."""

import random
import re

from pyspark.sql import functions as F

from voxelkeel.llm import subdedup
from voxelkeel.llm.common import staged

COLUMNS = ["doc_id", "text", "n_units", "n_removed", "n_repeated", "removed_start", "removed_end", "kept_doc_id"]


def cut_up(text):
    """(start, end, words) of every unit, word by word."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    out, begin = [], 0
    for k, (_, end) in enumerate(words):
        behind = text[end : words[k + 1][0]] if k + 1 < len(words) else "\n"
        if text[end - 1] in ".!?,;:" or "\n" in behind:
            stop = words[k + 1][0] if k + 1 < len(words) else len(text)
            out.append((words[begin][0], stop, tuple(text[a:b].encode().lower() for a, b in words[begin : k + 1])))
            begin = k + 1
    return out


def brute(rows, min_words):
    """Rows are (doc_id, text) with distinct ids; a None id ranks last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    units = [cut_up(text) for _, text in rows]
    seen, count, marks = {}, {}, {}
    for k in order:
        for i, (_, _, words) in enumerate(units[k]):
            count[words] = count.get(words, 0) + 1
            if words in seen:
                marks[k, i] = seen[words]
            else:
                seen[words] = rows[k][0]

    def runs(k, is_marked):
        i, out = 0, []
        while i < len(units[k]):
            j = i
            while j < len(units[k]) and is_marked(j):
                j += 1
            if sum(len(u[2]) for u in units[k][i:j]) >= min_words:
                out.append((i, j - 1))
            i = max(j, i + 1)
        return out

    out = []
    for k, (doc_id, text) in enumerate(rows):
        gone = runs(k, lambda i: (k, i) in marks)
        spans = [(units[k][a][0], units[k][b][1]) for a, b in gone]
        left = text
        for a, b in reversed(spans):
            left = left[:a] + left[b:]
        repeated = sum(b - a + 1 for a, b in runs(k, lambda i: count[units[k][i][2]] > 1))
        out.append((doc_id, left, len(units[k]), sum(b - a + 1 for a, b in gone), repeated, [a for a, _ in spans], [b for _, b in spans], [marks[k, a] for a, _ in gone]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    parts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 9, 30]))) + rng.choice(["", ".", ",", "\n", " \n\n ", ";\t"]) for _ in range(60)] + ["", "  ", "Größe é.", "\n"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for k in range(150)] + [(900, None), (901, ""), (902, "\n\n"), (None, parts[3] + "\n" + parts[4].upper()), (903, (parts[2] + "\n") * 3000)]
    df = spark.createDataFrame([(t, d, "extra", 5) for d, t in rows], "text string, doc_id long, `a b` string, n_units int").repartition(4)
    out = subdedup.remove_repeats(df, 8)
    assert out.columns == ["text", "doc_id", "a b", *COLUMNS[2:]]
    got = sorted((tuple(r) for r in out.select(COLUMNS).collect()), key=str)
    assert got == brute(rows, 8)
    assert any(r[3] for r in got) and any(r[4] > r[3] for r in got)


def test_passage_inside_lines(spark):
    """A passage of 55 words spliced into lines goes, but for the clauses it is cut in at its ends."""
    rng = random.Random(9)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) + ("," if k % 8 == 7 else "") for k in range(n))
    passage = fresh(55)
    rows = [(k, f"{fresh(20)} {passage} {fresh(20)}.\n{fresh(30)}") for k in range(6)] + [(k, fresh(90)) for k in range(6, 12)]
    out = {r.doc_id: r for r in subdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k].n_removed > 0 for k in range(12)] == [False] + [True] * 5 + [False] * 6
    assert all(out[k].n_repeated > 0 for k in range(6)) and not any(out[k].n_repeated for k in range(6, 12))
    for k in range(1, 6):
        (a,), (b,) = out[k].removed_start, out[k].removed_end
        whole = dict(rows)[k]
        assert out[k].text == whole[:a] + whole[b:] and 40 <= len(whole[a:b].split()) <= 55 and whole[a:b].strip() in passage


def test_hot_line_repeated_rows_and_empty_table(spark):
    hot = "this line stands in every one of the documents and is long enough"
    rows = [(k, f"own {k}\n{hot}") for k in range(2500)] + [(7, f"own 7\n{hot}"), (7, f"another text\n{hot}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = subdedup.remove_repeats(df, 5).collect()
    assert len(out) == 2502 and sum(r.n_removed for r in out) == 2501
    assert [r.text for r in out if r.doc_id == 0] == [f"own 0\n{hot}"]
    assert all(r.kept_doc_id == [0] for r in out if r.doc_id)
    copies = subdedup.remove_repeats(spark.createDataFrame([(1, hot), (1, hot)], "doc_id long, text string"), 5).collect()
    assert [r.text for r in copies] == [hot, hot]
    assert subdedup.remove_repeats(df.limit(0)).count() == 0


def test_frequent_units_meet_no_join(spark):
    """A frequent unit is told by a bounded set of digests: its rows meet nothing, and nothing grows faster than they do."""
    hot = ["a line that a great many of the documents hold", "and another one, just as common as the first of them"]
    big = 1 << 60
    for n in (1500, 3000):
        rows = [(big + k, f"own {k}\n{hot[0]}\n{hot[1]}\n" + (hot[0] if k % 2 else f"more {k}")) for k in range(n)]
        rows += [(None, f"null id\n{hot[0]}"), (big - 1, hot[1] + "\nearliest"), (-5, None)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        whole = df.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_key"))
        units = staged(subdedup.text_units(whole), "units")
        found, firsts = subdedup.repeated_units(units)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= len(firsts) <= 10
        apart = found.filter("later IS NULL")
        assert apart.count() == units.filter(F.col("digest").isin(list(firsts))).count() <= 4 * len(rows)
        got = sorted((tuple(r) for r in subdedup.remove_repeats(df, 5).select(COLUMNS).collect()), key=str)
        assert got == brute(rows, 5)


def test_only_null_ids(spark):
    hot = "one line that all of the documents without an id have"
    rows = [(None, f"{hot}\nown {k}") for k in range(2000)]
    out = subdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sum(hot in r.text for r in out) == 1 and sum(r.n_removed for r in out) == 1999
    assert all(r.kept_doc_id == [None] for r in out if r.n_removed)


def test_clashing_columns_stay(spark):
    line = "a line that both of the two documents have in full"
    names = ["text_key", "marks", "marked_id", "marked_key", "cut", "_id", "_key", "_text", "_row", "_cut", "_marks", "_of", "unit", "digest", "rank"]
    df = spark.createDataFrame([(1, line), (2, line + "\nmore")], "doc_id long, text string")
    for name in names:
        df = df.withColumn(name, F.lit(f"given {name}"))
    out = subdedup.remove_repeats(df, 5).orderBy("doc_id").collect()
    assert [r.text for r in out] == [line, "more"]
    assert all(r[name] == f"given {name}" for r in out for name in names)


def test_text_and_first_places_are_shuffled_once(spark):
    passage = " ".join(f"passage{j} of four words." for j in range(9))
    docs = spark.createDataFrame([(i, f"{passage}\nown {i}.", i % 3) for i in range(40)], "doc_id long, text string, n int")
    out = subdedup.remove_repeats(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "struct(doc_id, doc_id" in plan and "text, text#" not in plan and "struct(last" not in plan
    assert [(r.doc_id, r.n, r.text) for r in out.orderBy("doc_id").limit(2).collect()] == [(0, 0, f"{passage}\nown 0."), (1, 1, "own 1.")]
