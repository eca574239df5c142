"""Repairing the structure of conversations by the cheapest edits, found in one pass.

A conversation should read system (or not), then user and assistant in turn. Four states say what
may come next; a Viterbi pass keeps for each the cheapest edits that lead there, as a tree of back
pointers whose nodes count what hangs from them. A node nothing hangs from is freed, and once all
states have an ancestor in common, the edits up to it are final: they are written out and
forgotten, so that a pass holds only what is still undecided, however long a conversation is.
Equal costs are decided by the edits' letters. Those of two states differ from some row on, so the
order of their complete undecided sequences is that of what they come from, and then of the letters
added: it is kept as a rank of the states, and no sequence is read twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1  # of a row that ends in the middle of a sentence and is not deleted
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired conversation ends with so far
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an edit may add
_KEPT = {(START, "s"): SYSTEM} | {(state, _NAMES[to][0]): to for state, to in _TURN.items()}
_LEGAL = {"su", "ua", "au"}
# What it costs at most to end from the second state as any end from the first one does: inserting a
# user or an assistant, or both, or deleting the one row whose role of system was to be kept.
_BEHIND = {
    (START, SYSTEM): 4, (START, USER): 5, (START, ASSISTANT): 3,
    (SYSTEM, START): 0, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 0,
    (USER, START): 2, (USER, SYSTEM): 2, (USER, ASSISTANT): 2,
    (ASSISTANT, START): 0, (ASSISTANT, SYSTEM): 4, (ASSISTANT, USER): 2,
}

_SPACE = " \t\n\x0b\f\r"
RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " cost bigint, audit string, repaired_sha256 string"
)


class _Node:
    """One edit: its letter, the line that it writes (None for a deletion), and the edit before it."""

    __slots__ = ("before", "letter", "line", "hanging")

    def __init__(self, before: _Node | None, letter: str, line: str | None):
        self.before, self.letter, self.line = before, letter, line
        self.hanging: dict[int, _Node] = {}
        if before is not None:
            before.hanging[id(self)] = self


class Repair:
    """The pass over one conversation; edits go to ``emit(letter, line)`` as they become final."""

    def __init__(self, emit: Callable[[str, str | None], None]):
        self.emit = emit
        self.root = _Node(None, "", None)  # what has been emitted so far ends here
        # By state: cost, the rank of the letters among the states, the last edit.
        self.best = {START: (0, 0, self.root)}

    def _inserted(self) -> Iterator[tuple[int, int, int, str, int]]:
        """``state, cost, rank, letters, origin`` of every state as it is and after insertions."""
        for origin, (cost, rank, _) in self.best.items():
            yield origin, cost, rank, "", origin
            state = origin
            for count in (1, 2):
                state = _TURN[state]
                yield state, cost + count * COSTS[INSERT], rank, INSERT * count, origin

    def row(self, role: str, text: str, must_go: bool = False, truncated: bool = False) -> None:
        """Take the next row; ``must_go`` if only a deletion will do."""
        found: dict[int, tuple] = {}

        def offer(to: int, cost: int, rank: int, letters: str, origin: int, line: str | None) -> None:
            if to not in found or (cost, rank, letters) < found[to][:3]:
                found[to] = (cost, rank, letters, origin, line)

        for state, cost, rank, letters, origin in self._inserted():
            offer(state, cost + COSTS[DELETE], rank, letters + DELETE, origin, None)
            if not must_go:
                stays, to = cost + TRUNCATED_COST * truncated, _TURN[state]
                offer(to, stays + COSTS[REROLE], rank, letters + REROLE, origin, f"{_NAMES[to]}:{text}")
                kept = _KEPT.get((state, role[:1]))
                if kept is not None:
                    offer(kept, stays + COSTS[KEEP], rank, letters + KEEP, origin, f"{role}:{text}")
        # A state that is dearer than another by more than what it takes to follow it is out.
        behind = lambda state, way: any(way[0] > found[to][0] + _BEHIND[state, to] for to in found if to != state)
        self._grow({state: way for state, way in found.items() if not behind(state, way)})

    def done(self) -> int:
        """The cost of the whole; what was undecided is decided and emitted."""
        ends = [way for way in self._inserted() if way[0] in (START, ASSISTANT)]
        state, *way = min(ends, key=lambda way: way[1:4])
        self._grow({state: (*way, None)})
        return way[0]

    def _grow(self, ways: dict[int, tuple[int, int, str, int, str | None]]) -> None:
        """Hang the chosen edits into the tree, free what nothing hangs from, emit what is final."""
        order = {way[1:3]: rank for rank, way in enumerate(sorted(ways.values(), key=lambda way: way[1:3]))}
        last, chains, grown = self.best, {}, {}
        for to, (cost, rank, letters, origin, line) in ways.items():
            node, state = last[origin][2], origin
            for count in range(letters.count(INSERT)):  # these come before the row's own letter
                state = _TURN[state]
                if (origin, count) not in chains:
                    chains[origin, count] = _Node(node, INSERT, f"{_NAMES[state]}:")
                node = chains[origin, count]
            if letters and letters[-1] != INSERT:
                node = _Node(node, letters[-1], line)
            grown[to] = (cost, order[rank, letters], node)
        self.best = grown
        alive = {id(node) for _, _, node in grown.values()}
        for _, _, node in last.values():
            while not node.hanging and id(node) not in alive and node is not self.root:
                node.before.hanging.pop(id(node))
                node = node.before
        while len(self.root.hanging) == 1 and id(self.root) not in alive:
            (self.root,) = self.root.hanging.values()
            self.root.before = None
            self.emit(self.root.letter, self.root.line)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, lost``: the rows after damage that depends on their id and turn.

    Of twenty rows, by ``crc32(conv_id:turn)``, one is lost, one loses its text, one its ``.!?``,
    one is repeated and one becomes a user's. Nulls count as one space, in the key too; a lost row
    keeps only its conversation's id. Repeated rows are damaged alike; other columns are ignored.
    """
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("said", ".!?", ""))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("by"))
    lost = F.col("fate") == 0
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        space("role").alias("by"), space("text").alias("said"), fate.alias("fate"),
    )
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy")
    return rows.select(
        "conv_id",
        F.when(~lost, F.col("turn")).alias("turn"),
        F.when(~lost, role).alias("role"),
        F.when(~lost, text.otherwise(F.col("said"))).alias("text"),
        lost.alias("lost"),
        times,
    ).drop("copy")


class _Conversation:
    """What is known of a conversation whose rows come one by one, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.first, self.last = conv_id, 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.role, self.audit, self.hash, self.lines = None, [], hashlib.sha256(), 0
        self.repair = Repair(self.edit)

    def edit(self, letter: str, line: str | None) -> None:
        self.audit.append(letter)
        if line is not None:
            self.hash.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.turns += self.last != turn
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.role is not None and self.role[:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        self.role = role
        end = text.rstrip(_SPACE)[-1:]
        blank, duplicate = not end, bool(end) and seen
        truncated = bool(end) and not seen and end not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.row(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        cost = self.repair.done()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
                "".join(self.audit), self.hash.hexdigest())


def _results(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The results of conversations whose rows follow one another."""
    now = None
    for conv_id, turn, role, text, lost, nth in rows:
        if now is None or now.conv_id != conv_id:
            if now is not None:
                yield now.result()
            now = _Conversation(conv_id)
        if not lost:
            now.row(turn, role, text, nth > 1)
    if now is not None:
        yield now.result()


def repair(rows: DataFrame) -> DataFrame:
    """Faults of each conversation and its cheapest repair, see ``RESULT``, from ``damaged`` rows.

    Rows are taken by turn (nulls first), then role, then text. Faults are counted once a row: blank,
    else a duplicate of an earlier role and text, else truncated. Edits keep a row, give it the
    role of user or assistant, delete it (the only way for blank and duplicate ones) or insert a row
    of empty text; the initials of the roles then read ``(s?(ua)+)?``. Of equally cheap repairs the one
    with the least letters in ``audit`` is meant. A null id is a conversation of its own; a role
    that is empty or has another initial is never kept; a conversation without rows that are not
    lost, or with none left, has an empty audit or only deletions, and the hash of no text. An
    empty table gives no rows; other columns are ignored.

    A conversation's texts go to one task, as their hash needs them in order; there they stream,
    sorted by Spark, and memory holds one batch and the undecided edits of one conversation.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "lost").repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    ordered = rows.withColumn("nth", F.row_number().over(earlier)).sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "nth"
    )

    def run(batches):
        names = RESULT.replace(",", " ").split()[::2]

        def each():
            for batch in batches:
                for at in range(0, len(batch), 256):
                    yield from zip(*(column.to_pylist() for column in batch.slice(at, 256).columns))

        results = _results(each())
        while some := list(islice(results, 1024)):
            columns = [pa.array(column) for column in zip(*some)]
            yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()), *columns[1:]], names)

    return ordered.mapInArrow(run, RESULT)
