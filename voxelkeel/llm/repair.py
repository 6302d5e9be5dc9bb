"""Conversation repair: the cheapest edits that make turns alternate, by survivor-coalescence Viterbi.

A conversation is repaired by keeping, re-roling and deleting its rows and inserting empty ones, so
that the initials of its roles read ``(s?(ua)+)?``. Of the edit lists of least cost the one whose letters
(Keep, Rerole, Delete, Insert) come first in ASCII is taken. The search keeps one survivor for each of
four states (nothing yet, behind a system turn, behind a user, behind an assistant). Survivors are leaves
of a tree of back pointers with reference counts; as soon as all of them share an ancestor the
edits up to it are sent out and their rows dropped, so memory holds only what is still undecided.

Ties: survivors that all consumed the same rows end in a row's letter, so none is the beginning of another,
and their order is fixed by the first letter in which they differ. That order is carried along as a
rank, and ranks of the new survivors follow from (rank of the ancestor, letters added), which is exactly the
comparison of the whole undecided suffixes, at any length. A survivor that another can imitate
more cheaply whatever follows is given up.

Spark deals conversations to tasks by their id, finds repeated turns by a window over the same
partitioning and sorts each partition on disk. A task streams through its rows; no conversation is
gathered, however long. A conversation's digest is one hash over its turns in order, so one task must see them
one after another; that bounds how far a single conversation can be split.

Defined results: a null role or text is one space, so a null text is blank; a null conversation id is an id of its own; rows
without a turn come first; rows that share a turn are ordered by role and text; equal rows are
duplicates of the first; an empty table gives no conversation; other columns are ignored, whatever their names;
texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelkeel.llm.common import shuffle_partitions

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The one role that a row may be given or an insert may have behind each state, and the state it leads to.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: What state x pays at most, over state y, to imitate whatever y goes on with.
IMITATES = {
    (START, SYSTEM): 0, (START, ASSISTANT): 0, (START, USER): INSERT, (ASSISTANT, SYSTEM): 0, (ASSISTANT, START): DELETE,
    (ASSISTANT, USER): INSERT, (USER, ASSISTANT): INSERT, (USER, SYSTEM): INSERT, (USER, START): INSERT + DELETE, (SYSTEM, USER): INSERT,
}
DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, edit string, turn long, role string, text string"


def _behind_inserts(state: int) -> list[tuple[int, str]]:
    """States reached from ``state`` by up to two inserts, with the letters."""
    one = NEXT[state][1]
    return [(state, ""), (one, "I"), (NEXT[one][1], "II")]


def _choices(initial: str, truncated: bool) -> dict[int, list[tuple[int, int, str]]]:
    """For each state behind a row: (state before, cost, letters). An insert before a delete ties with one behind it, whose letters come first."""
    extra = TRUNCATED if truncated else 0
    found: dict[int, list[tuple[int, int, str]]] = {s: [(s, DELETE, "D")] for s in range(4)}
    for before in range(4):
        for state, inserts in _behind_inserts(before):
            paid = INSERT * len(inserts) + extra
            role, behind = NEXT[state]
            if initial == role[0]:
                found[behind].append((before, paid + KEEP, inserts + "K"))
            elif initial == "s" and state == START:
                found[SYSTEM].append((before, paid + KEEP, inserts + "K"))
            found[behind].append((before, paid + REROLE, inserts + "R"))
    return found


CHOICES = {(i, t): _choices(i, t) for i in ("s", "u", "a", "") for t in (False, True)}


class Survivors:
    """The four survivors over one conversation. ``emit(letter, role, row)`` gets the edits once they are settled."""

    PARENT, CHILDREN, LETTERS, ROW, TIMES = range(5)

    def __init__(self, emit: Callable[[str, str | None, tuple | None], None]):
        self.emit, self.state = emit, START
        self.root = [None, 0, "", None, 1]
        #: state -> (cost, rank, leaf)
        self.live = {START: (0, 0, self.root)}
        self.most_waiting = self.waiting = 0

    def delete(self, count: int) -> None:
        """``count`` rows that have to go; a run of them is one node of each survivor."""
        leaves = [leaf for _, _, leaf in self.live.values()]
        if all(leaf is not self.root and leaf[self.LETTERS] == "D" for leaf in leaves):
            self.live = {s: (cost + DELETE * count, rank, leaf) for s, (cost, rank, leaf) in self.live.items()}
        else:
            self._move({s: (cost + DELETE * count, rank, s, "D") for s, (cost, rank, _) in self.live.items()}, None)
            leaves, count = [leaf for _, _, leaf in self.live.values() if leaf is not self.root], count - 1
            if count and not leaves:
                self._write("D" * count, None)
        for leaf in leaves:
            leaf[self.TIMES] += count

    def step(self, row: tuple, initial: str, truncated: bool) -> None:
        found = {}
        for state, choices in CHOICES[initial if initial in ("s", "u", "a") else "", truncated].items():
            best = None
            for before, cost, letters in choices:
                if before in self.live:
                    paid, rank, _ = self.live[before]
                    key = (paid + cost, rank, letters, before)
                    if best is None or key < best:
                        best = key
            if best:
                found[state] = (best[0], best[1], best[3], best[2])
        for (x, y), price in IMITATES.items():
            if x in found and y in found and found[x][0] + price < found[y][0]:
                del found[y]
        self._move(found, row)

    def finish(self) -> int:
        """Settle everything; the cost."""
        ends = [(cost + INSERT * len(more), rank, more, state) for state, (cost, rank, _) in self.live.items() for behind, more in _behind_inserts(state) if behind in (START, ASSISTANT)]
        cost, _, more, state = min(ends)
        leaf = self.live[state][2]
        self._settle(self._path(leaf))
        self._write(more, None)
        return cost

    def _move(self, found: dict[int, tuple[int, int, int, str]], row: tuple | None) -> None:
        old = [leaf for _, _, leaf in self.live.values()]
        order = {key: i for i, key in enumerate(sorted({(rank, letters) for _, rank, _, letters in found.values()}))}
        live = {}
        for state, (cost, rank, before, letters) in found.items():
            parent = self.live[before][2]
            parent[self.CHILDREN] += 1
            live[state] = (cost, order[rank, letters], [parent, 0, letters, None if letters[-1] == "D" else row, 1])
        self.live = live
        for leaf in old:
            while leaf is not None and leaf is not self.root and leaf[self.CHILDREN] == 0:
                leaf = leaf[self.PARENT]
                leaf[self.CHILDREN] -= 1
        self.waiting += 1
        self.most_waiting = max(self.most_waiting, self.waiting)
        if self.root[self.CHILDREN] == 1:
            path = self._path(next(iter(live.values()))[2])
            shared = 1
            while shared < len(path) and path[shared - 1][self.CHILDREN] == 1:
                shared += 1
            self._settle(path[:shared])

    def _path(self, leaf: list) -> list[list]:
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf[self.PARENT]
        return path[::-1]

    def _settle(self, path: list[list]) -> None:
        for node in path:
            self._write(node[self.LETTERS] * node[self.TIMES], node[self.ROW])
            node[self.PARENT] = node[self.ROW] = None
            self.root = node
        self.waiting -= len(path)

    def _write(self, letters: str, row: tuple | None) -> None:
        for letter in letters:
            if letter == "D":
                self.emit("D", None, None)
                continue
            if letter == "K":
                role = row[0]
                self.state = SYSTEM if role[0] == "s" else NEXT[self.state][1]
            else:
                role, self.state = NEXT[self.state]
            self.emit(letter, role, None if letter == "I" else row)


def damage_conversations(rows: DataFrame) -> DataFrame:
    """Turns with the contract's damage; ``copies`` says how often each row is there (0: dropped)."""
    ids = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    draw = F.crc32(F.concat_ws(":", *ids).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw <= 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"))


def _fault(first: Column) -> Column:
    return F.when(~F.col("text").rlike(BLANK), "blank").when(~first, "duplicate").when(~F.col("text").rlike(ENDED), "truncated").otherwise("")


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) dealt by conversation, with the first fault of each, in order within a partition."""
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").withColumn("gone", F.col("copies") == 0)
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = dealt.withColumn("fault", _fault(F.row_number().over(same) == 1))
    return seen.select("conv_id", "turn", "role", "text", "copies", "fault").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


class Conversation:
    """Counts of one conversation and its survivors."""

    def __init__(self, emit: Callable[[str, str | None, tuple | None], None]):
        self.survivors = Survivors(emit)
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str) -> None:
        initial = role[:1]
        for at in range(copies):
            now = fault if at == 0 or fault == "blank" else "duplicate"
            if now:
                self.counts[now] += 1
            if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.last_initial = initial
            if now in ("blank", "duplicate"):
                self.survivors.delete(1)
            else:
                self.survivors.step((role, text, turn), initial, now == "truncated")
        if copies and turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1

    @property
    def gaps(self) -> int:
        return 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def _by_conversation(batches: Iterator[pa.RecordBatch], begin: Callable, end: Callable) -> Iterator[None]:
    """Runs ``begin(id)`` and ``end(id, conversation)`` around each conversation; yields after each."""
    current, talk = None, None
    for batch in batches:
        for conv_id, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if talk is None or conv_id != current:
                if talk is not None:
                    end(current, talk)
                    yield
                current, talk = conv_id, begin(conv_id)
            talk.add(*row)
    if talk is not None:
        end(current, talk)
        yield


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, letters of the edits and a hash of the repaired ``role:text`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        audit: list[str] = []
        digest, written = hashlib.sha256(), 0

        def emit(letter: str, role: str | None, row: tuple | None) -> None:
            nonlocal written
            audit.append(letter)
            if role is not None:
                digest.update(f"{chr(10) if written else ''}{role}:{row[1] if row else ''}".encode())
                written += 1

        def begin(_conv_id: int | None) -> Conversation:
            nonlocal digest, written
            digest, written = hashlib.sha256(), 0
            audit.clear()
            return Conversation(emit)

        def end(conv_id: int | None, talk: Conversation) -> None:
            cost = talk.survivors.finish()
            out.append((conv_id, talk.gaps, *talk.counts.values(), talk.illegal, cost, "".join(audit), digest.hexdigest()))

        for _ in _by_conversation(batches, begin, end):
            if len(out) >= 2000:
                yield _table(out, DIGESTS)
                out.clear()
        yield _table(out, DIGESTS)

    return ordered_turns(rows).mapInArrow(run, DIGESTS)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: one row per kept, re-roled or inserted turn in order, and one per deleted row (no position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, position = None, 0

        def emit(letter: str, role: str | None, row: tuple | None) -> None:
            nonlocal position
            if role is not None:
                position += 1
            out.append((current, position if role is not None else None, letter, row[2] if row else None, role, (row[1] if row else "") if role is not None else None))

        def begin(conv_id: int | None) -> Conversation:
            nonlocal current, position
            current, position = conv_id, 0
            return Conversation(emit)

        for _ in _by_conversation(batches, begin, lambda _, talk: talk.survivors.finish()):
            if len(out) >= 5000:
                yield _table(out, TURNS)
                out.clear()
        yield _table(out, TURNS)

    return ordered_turns(rows).mapInArrow(run, TURNS)
