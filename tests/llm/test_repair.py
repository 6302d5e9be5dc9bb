"""Conversation repair against every possible list of edits, and its memory on long conversations."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from voxelkeel.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """The contract's damage, read literally."""
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv_id, turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


def faults(talk):
    seen, found = set(), []
    for role, text in talk:
        last = WORD.findall(text)[-1:]
        found.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return found


def every_repair(talk, found):
    """(cost, letters, repaired) of all edit lists with up to two inserts in a row."""
    options = []
    for (role, text), fault in zip(talk, found):
        extra = 5 if fault == "truncated" else 0
        mine = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            mine += [("K", extra, (role, text)), *(("R", 1 + extra, (r, text)) for r in ("user", "assistant"))]
        options.append(mine)
    inserts = [[]] + [[(r, "")] for r in ("user", "assistant")] + [[(r, ""), (s, "")] for r in ("user", "assistant") for s in ("user", "assistant")]
    best = None
    for edits in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(edits) + 1):
            said, letters, cost = list(gaps[0]), "I" * len(gaps[0]), 5 * len(gaps[0])
            for (letter, paid, row), more in zip(edits, gaps[1:]):
                said += ([row] if row else []) + more
                letters += letter + "I" * len(more)
                cost += paid + 5 * len(more)
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in said)) and (best is None or (cost, letters) < best[:2]):
                best = (cost, letters, said)
    return best


def by_states(talk, found):
    """The same by a plain table of whole letter strings, for longer conversations."""
    following = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def with_inserts(table):
        out = dict(table)
        for _ in range(3):
            for state, (cost, letters, said) in list(out.items()):
                role, to = following[state]
                new = (cost + 5, letters + "I", [*said, (role, "")])
                out[to] = min(out.get(to, new), new)
        return out

    table = {0: (0, "", [])}
    for (role, text), fault in zip(talk, found):
        extra, new = 5 if fault == "truncated" else 0, {}
        for state, (cost, letters, said) in with_inserts(table).items():
            reached = [(state, (cost + 2, letters + "D", said))]
            if fault not in ("blank", "duplicate"):
                given, to = following[state]
                reached.append((to, (cost + 1 + extra, letters + "R", [*said, (given, text)])))
                if role[:1] == given[0] or (role[:1] == "s" and state == 0):
                    reached.append((1 if role[:1] == "s" else to, (cost + extra, letters + "K", [*said, (role, text)])))
            for to, entry in reached:
                new[to] = min(new.get(to, entry), entry)
        table = new
    return min(entry for state, entry in with_inserts(table).items() if state in (0, 3))


def expected(rows, solve):
    after = damaged(rows)
    result = {}
    for conv_id in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv_id), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        talk, turns = [r[1:] for r in mine], [r[0] for r in mine if r[0] is not None]
        found = faults(talk)
        cost, audit, said = solve(talk, found)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        result[conv_id] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return result


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = repair.repair_digests(repair.damage_conversations(df)).collect()
    assert len(out) == len({r.conv_id for r in out})
    return {r.conv_id: tuple(r)[1:] for r in out}


def talks(seed, count, longest, roles):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Well? ", "", " \t", "So!\n", "é…", None]
    return [(c, rng.choice([t, t, t * 2, None]), rng.choice(roles), rng.choice(texts)) for c in range(count) for t in range(rng.randint(1, longest))]


def test_against_every_list_of_edits(spark):
    rows = talks(1, 16, 3, ["user", "assistant", "system", "tool", None, ""])
    assert got(spark, rows) == expected(rows, every_repair)


def test_table_of_strings_agrees_with_every_list():
    rows = talks(2, 10, 3, ["user", "assistant", "system", "tool"])
    assert expected(rows, every_repair) == expected(rows, by_states)


def test_long_conversations(spark):
    rows = talks(3, 150, 40, ["user", "assistant", "user", "assistant", "system", "tool", "umpire"])
    rows += [(None, t, "user", f"Line {t}.") for t in range(30)] + [(-7, None, "tool", f"T{t}!") for t in range(41)]
    assert got(spark, rows) == expected(rows, by_states)


def test_no_rows_left_and_empty_table(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, [(5, turn, "user", "Gone.")]) == {5: (0, 0, 0, 0, 0, 0, "", empty)}
    assert got(spark, []) == {}


def test_clashing_columns_and_very_long_texts(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "word " * 400_000 + "."), ("assistant", "." * 1_000_000), ("user", "Z.")])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fault", F.lit("x")).withColumn("copies", F.lit(9)).withColumn("gone", F.lit(1))
    out = repair.repair_digests(repair.damage_conversations(df)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in out} == expected(rows, by_states)


def test_turns_come_back(spark):
    rows = talks(4, 30, 12, ["user", "assistant", "system"])
    turns = repair.repaired_turns(repair.damage_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    want = expected(rows, by_states)
    for conv_id, values in want.items():
        mine = [r for r in turns if r.conv_id == conv_id]
        said = [f"{r.role}:{r.text}" for r in sorted((r for r in mine if r.position), key=lambda r: r.position)]
        assert hashlib.sha256("\n".join(said).encode()).hexdigest() == values[-1]
        assert sorted(r.edit for r in mine) == sorted(values[-2])


def test_settled_rows_are_let_go():
    """A long conversation keeps few rows waiting; a run of copies keeps one node a survivor; ties over the whole length stay exact."""
    rng = random.Random(5)
    out = []
    search = repair.Survivors(lambda letter, role, row: out.append(letter))
    for k in range(20_000):
        search.step((rng.choice(["user", "assistant"]), "x."), rng.choice("ua"), rng.random() < 0.1)
    search.finish()
    assert len([x for x in out if x != "I"]) == 20_000 and search.most_waiting < 100
    out.clear()
    search = repair.Survivors(lambda letter, role, row: out.append(letter))
    search.step(("user", "x."), "u", False)
    for _ in range(5000):
        search.delete(2)
    assert search.waiting <= 2
    search.finish()
    assert "".join(out) == by_states([("user", "x.")] * 10_001, [""] + ["duplicate"] * 10_000)[1]
    out.clear()
    search = repair.Survivors(lambda letter, role, row: out.append(letter))
    for _ in range(3001):
        search.step(("tool", "x."), "t", False)
    search.finish()
    assert "".join(out) == by_states([("tool", "x.")] * 3001, [""] * 3001)[1]
