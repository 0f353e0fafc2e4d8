"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation,
beginning with the user. Dynamic programming over this automaton chooses for each turn to keep it,
to merge it into the turn before (role kept or changed), to relabel it, or to insert empty turns
before it, at least total cost; of equal costs the fewest turns, then the order of the choices.
The repaired sequence is rendered piece by piece: the pieces of a conversation, in order, are the
formatted text. Markers of the format inside a text are escaped (escaped()), so that no text can
end its turn or forge another.

Conversations aren't gathered. Turns are dealt to tasks in ranges of (conversation, turn). A task
sums up each conversation's stretch as a matrix of least costs from state to state, in constant
memory; matrices of stretches that continue over tasks (at most two a task) are chained on the
driver, which fixes the states at their bounds; a second pass repairs each stretch between them.
So a conversation may be larger than a task, and pieces are never longer than a turn.

Defined cases: unknown and null roles are relabelled or merged; null texts are empty; turns of
equal number are ordered by role and text, repeated rows are turns of their own; a null
conversation id is one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structex.llm.common import durable

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Roles that may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = (10**15, 0)
#: Turns of a task at most, about.
TASK_TURNS = 200_000
SCHEMA = "conv_id long, place long, part int, turn long, role string, action string, source_turn long, piece string"


def steps(role: int | None) -> list[tuple[int, int, int, tuple]]:
    """(from, to, cost, actions) for a turn; actions: inserted roles and what becomes of the turn."""
    out = []
    for state in range(4):
        if state != START:
            out.append((state, state, MERGE + (RELABEL if role != state else 0), ((), "merge")))
        paths = [((), state)]
        for _ in range(3):  # at most two empty turns before
            longer = []
            for inserted, at in paths:
                for to in NEXT[at]:
                    change = role != to
                    cost = INSERT * len(inserted) + (RELABEL if change else 0)
                    out.append((state, to, cost, (inserted, "relabel" if change else "keep")))
                    longer.append(((*inserted, to), to))
            paths = longer
    best: dict = {}
    for a, b, cost, what in out:
        key = (cost, len(what[0]) + (what[1] != "merge"), what[1], what[0])
        if (a, b, what[1] == "merge") not in best or key < best[a, b, what[1] == "merge"][0]:
            best[a, b, what[1] == "merge"] = (key, (a, b, cost, what))
    return [v[1] for _, v in sorted(best.items())]


_STEPS = {role: steps(role) for role in (None, SYSTEM, USER, ASSISTANT)}
_BY_NAME = {name: i for i, name in enumerate(ROLES) if name}


def _code(role: str | None) -> int | None:
    return _BY_NAME.get((role or "").strip().lower())


def advance(row: list[tuple[int, int]], role: int | None) -> tuple[list[tuple[int, int]], list[tuple | None]]:
    """Least (cost, turns) by state after one more turn, and the step that reached each."""
    after, came = [FAR] * 4, [None] * 4
    for a, b, cost, what in _STEPS[role]:
        if row[a] < FAR:
            new = (row[a][0] + cost, row[a][1] + len(what[0]) + (what[1] != "merge"))
            if new < after[b]:
                after[b], came[b] = new, (a, what)
    return after, came


def summary(roles: list[int | None], matrix: list | None = None) -> list[list[tuple[int, int]]]:
    """Least (cost, turns) from each state to each over a stretch."""
    matrix = matrix or [[(0, 0) if a == b else FAR for b in range(4)] for a in range(4)]
    for role in roles:
        matrix = [advance(row, role)[0] for row in matrix]
    return matrix


def repair(roles: list[int | None], start: int = START, end: int | None = None) -> tuple[list[tuple[int, tuple]], tuple[int, int]]:
    """(state, actions) by turn of the cheapest path from start to end (any if None), and its cost."""
    row = [(0, 0) if s == start else FAR for s in range(4)]
    back = []
    for role in roles:
        row, came = advance(row, role)
        back.append(came)
    state = end if end is not None else min(range(4), key=lambda s: (row[s], s))
    total, path = row[state], []
    for came in reversed(back):
        before, what = came[state]
        path.append((state, what))
        state = before
    return path[::-1], total


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, turn, role, text, task) of all rows, in order."""
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's first and last conversation: (task, which, conv_id, n, matrix)."""
    from itertools import groupby

    ends: list[tuple] = []
    for (task, conv), rows in groupby(_runs(batches), key=lambda r: (r[4], r[0])):
        n, matrix = 0, None
        for row in rows:
            matrix = summary([_code(row[2])], matrix)
            n += 1
        entry = (task, conv, n, [v for line in matrix for cell in line for v in cell])
        if not ends or ends[-1][0] != task:
            ends += [entry, entry]
        else:
            ends[-1] = entry
    which = [i % 2 for i in range(len(ends))]
    columns = list(zip(*ends, strict=True)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(which, pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
        names=["which", "task", "conv_id", "n", "matrix"],
    )


def chain(stretches: list[tuple]) -> dict[tuple, tuple[int, int | None, int, int, bool]]:
    """By (task, conversation): states at the bounds, rows and turns before, and whether it ends there.

    stretches: (task, conversation, n, matrix) of one conversation's stretches in their order.
    """
    row = [(0, 0) if s == START else FAR for s in range(4)]
    came = []
    for _, _, _, flat in stretches:
        cells = [[tuple(flat[8 * a + 2 * b : 8 * a + 2 * b + 2]) for b in range(4)] for a in range(4)]
        step = []
        after = [FAR] * 4
        for b in range(4):
            options = [((row[a][0] + cells[a][b][0], row[a][1] + cells[a][b][1]), a) for a in range(4) if row[a] < FAR and cells[a][b] < FAR]
            best = min(options, default=(FAR, START))
            after[b] = best[0]
            step.append(best[1])
        came.append((step, [r[1] for r in row]))
        row = after
    state = min(range(4), key=lambda s: (row[s], s))
    found, end = {}, state
    for i in range(len(stretches) - 1, -1, -1):
        task, conv, _, _ = stretches[i]
        start = came[i][0][end]
        last = i == len(stretches) - 1
        found[task, conv] = (start, end, sum(s[2] for s in stretches[:i]), came[i][1][start], last)
        end = start
    return found


#: Fixed values of the format: what opens and closes a turn. In a text "<|" becomes "<\\|", and a
#: backslash between the two is doubled, so no text can open or close one and all can be read back.
_MARK = re.compile(r"<(\\*)\|")


def escaped(text: str | None) -> str:
    return _MARK.sub(lambda m: "<" + m[1] * 2 + "\\|", text or "")


def unescaped(piece: str) -> str:
    return re.sub(r"<((?:\\\\)*)\\\|", lambda m: "<" + m[1][: len(m[1]) // 2] + "|", piece)


#: Turns of a stretch whose paths are held at once.
PATH_TURNS = 4_096


def paths(roles: list[int | None], start: int, end: int | None) -> Iterator[tuple[int, tuple]]:
    """(state, actions) by turn of the cheapest path: repair() with the memory of a part at a time.

    Parts' matrices fix the states at the bounds; then each part is repaired between its bounds.
    """
    parts = [roles[a : a + PATH_TURNS] for a in range(0, len(roles), PATH_TURNS)]
    if len(parts) == 1:
        yield from repair(roles, start, end)[0]
        return
    row = [(0, 0) if s == start else FAR for s in range(4)]
    came = []
    for part in parts:
        cells = summary(part)
        reached = [min(((row[a][0] + cells[a][b][0], row[a][1] + cells[a][b][1], a) for a in range(4) if row[a] < FAR and cells[a][b] < FAR), default=(*FAR, START)) for b in range(4)]
        came.append([r[2] for r in reached])
        row = [r[:2] for r in reached]
    state = end if end is not None else min(range(4), key=lambda s: (row[s], s))
    bounds = [state]
    for before in reversed(came):
        bounds.append(before[bounds[-1]])
    bounds.reverse()
    for part, a, b in zip(parts, bounds[:-1], bounds[1:], strict=True):
        yield from repair(part, a, b)[0]


def _render(known: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

        def flush(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        out: list[tuple] = []
        for (task, conv), rows in groupby(_runs(batches), key=lambda r: (r[4], r[0])):
            turns = list(rows)  # a stretch is at most a task's share
            start, end, place, turn, last = known.get((task, conv), (START, None, 0, 0, True))
            for i, ((state, (inserted, action)), row) in enumerate(zip(paths([_code(r[2]) for r in turns], start, end), turns, strict=True)):
                part = 0
                for role in inserted:
                    opening = ("<|end|>\n" if turn else "") + f"<|{ROLES[role]}|>\n"
                    out.append((conv, place + i, part, turn, ROLES[role], "insert", None, opening))
                    turn, part = turn + 1, part + 1
                if action == "merge":
                    opening = "\n"
                else:
                    opening = ("<|end|>\n" if turn else "") + f"<|{ROLES[state]}|>\n"
                    turn += 1
                closing = "<|end|>\n" if last and i == len(turns) - 1 else ""
                out.append((conv, place + i, part, turn - 1, ROLES[state], action, row[1], opening + escaped(row[3]) + closing))
                if len(out) > 20_000:
                    yield flush(out)
                    out = []
        yield flush(out)

    return run


def format_chats(turns: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per piece of a repaired conversation; ordered by (place, part) they are its text."""
    spark = turns.sparkSession
    # a task's share doesn't grow with the table
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // TASK_TURNS))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    dealt = durable(dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().cast("long").alias("task")))
    ends = dealt.mapInArrow(_summarise, "which int, task long, conv_id long, n long, matrix array<long>").collect()  # two a task
    by_conv: dict = {}
    for r in sorted(ends, key=lambda r: (r["task"], r["which"])):
        stretches = by_conv.setdefault(r["conv_id"], [])
        if not stretches or stretches[-1][0] != r["task"]:
            stretches.append((r["task"], r["conv_id"], r["n"], list(r["matrix"])))
    known: dict = {}
    for stretches in by_conv.values():
        if len(stretches) > 1:
            known |= chain(stretches)
    return dealt.mapInArrow(_render(known), SCHEMA)
