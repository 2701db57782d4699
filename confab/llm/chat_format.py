"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation is an optional system turn, then user and assistant in turn, starting
with user. A dynamic programme over this automaton's states gives every turn a role; it may
merge a turn into the one before it, relabel it, or insert an empty turn before it, each at
a cost, and the sequence of least total cost is rendered. Among repairs of equal cost a
hash of each turn and role decides, so the choice depends on the rows alone.

Conversations of any length are repaired in parallel: rows are range-partitioned by
conversation and turn and kept by a reliable checkpoint. A conversation that runs over
partitions has a min-plus matrix (cost from each state to each state) for each of its
pieces; chaining these matrices, at most two a partition, gives every piece its entry and
exit state, and each piece is then repaired alone. So no task or driver holds a
conversation, and a piece's repair is the whole conversation's.

Output is one row for every turn read and every empty turn inserted; joining ``fragment``
by ``pos`` gives the rendered conversation, as ``render_chats`` does.

Edge cases: turns order by turn (nulls last), then role and text. A null or unknown role
takes the role that fits. Null text is empty. Rows with a null conv_id are one
conversation. Repeated rows are turns of their own. Text that holds a control mark has it
broken by a space. A lone system turn gets an empty user turn. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_schema, shared_dir, slices, table

ROLES = ("system", "user", "assistant")
#: Names that public chat datasets use for the roles.
ALIASES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "gpt": 2, "bot": 2, "model": 2, "ai": 2}
#: States: before the first turn, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, INSERT, RELABEL, UNKNOWN = 1, 3, 4, 1
#: Which role may directly follow which state.
NEXT = {START: {0, 1}, SYSTEM: {1}, USER: {2}, ASSISTANT: {1}}
OPEN, CLOSE, MARK = "<|im_start|>", "<|im_end|>\n", "<|im_"
_SCALE = 1 << 80


def steps() -> dict[tuple[int, int], tuple[int, int | None]]:
    """(state, role) -> (cost, inserted role or None): how a turn of a role can come after a state."""
    out: dict[tuple[int, int], tuple[int, int | None]] = {}
    for state in range(4):
        for role in range(3):
            if role in NEXT[state]:
                out[state, role] = (0, None)
            elif state == role + 1:
                out[state, role] = (MERGE, None)
            else:
                between = [x for x in NEXT[state] if role in NEXT[x + 1]]
                if between and role:
                    out[state, role] = (INSERT, min(between))
    return out


STEPS = steps()


def known_role(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), -1)


def relabel_cost(role: int, to: int) -> int:
    return UNKNOWN if role < 0 else 0 if role == to else RELABEL


def turn_costs(conv, turn, role: str | None, text: str | None) -> list[int]:
    """Cost of giving the turn each role; the low digits break ties by a hash."""
    own = known_role(role)
    h = xxhash.xxh3_64_intdigest(repr((conv, turn, role, text)))
    return [relabel_cost(own, to) * _SCALE + ((h >> (20 * to)) & 0xFFFFF) for to in range(3)]


def final_cost(state: int) -> int:
    """A conversation ends after a user or assistant turn; a lone system turn gets an empty user turn."""
    return INSERT * _SCALE if state == SYSTEM else 0


def advance(costs: list, turn: list[int]) -> tuple[list, list]:
    """One turn: (cost of being in each state, the state before it)."""
    new, back = [None] * 4, [None] * 4
    for (state, role), (cost, _) in STEPS.items():
        if costs[state] is not None:
            c = costs[state] + cost * _SCALE + turn[role]
            if new[role + 1] is None or c < new[role + 1]:
                new[role + 1], back[role + 1] = c, state
    return new, back


def matrix(turns: list[list[int]]) -> list[list]:
    """Min-plus matrix of a piece: least cost from each state before it to each state after it."""
    out = []
    for entry in range(4):
        costs: list = [None] * 4
        costs[entry] = 0
        for t in turns:
            costs, _ = advance(costs, t)
        out.append(costs)
    return out


def solve(turns: list[list[int]], entry: int, leave: int | None = None) -> list[int]:
    """States after each turn on the cheapest way from ``entry`` to ``leave`` (or a legal end)."""
    costs: list = [None] * 4
    costs[entry] = 0
    backs = []
    for t in turns:
        costs, back = advance(costs, t)
        backs.append(back)
    if leave is None:
        leave = min((s for s in range(4) if costs[s] is not None), key=lambda s: costs[s] + final_cost(s))
    states = [leave]
    for back in reversed(backs[1:]):
        states.append(back[states[-1]])
    return states[::-1] if turns else []


def chain(pieces: list[list[list]]) -> list[tuple[int, int]]:
    """(entry, exit) state of each piece of a conversation from the pieces' matrices."""
    costs: list = [0, None, None, None]
    backs = []
    for m in pieces:
        new, back = [None] * 4, [None] * 4
        for a in range(4):
            for b in range(4):
                if costs[a] is not None and m[a][b] is not None and (new[b] is None or costs[a] + m[a][b] < new[b]):
                    new[b], back[b] = costs[a] + m[a][b], a
        costs = new
        backs.append(back)
    at = min((s for s in range(4) if costs[s] is not None), key=lambda s: costs[s] + final_cost(s))
    out = []
    for back in reversed(backs):
        out.append((back[at], at))
        at = back[at]
    return out[::-1]


def head(role: int) -> str:
    return f"{OPEN}{ROLES[role]}\n"


def render(rows: list[tuple], entry: int, states: list[int], last: bool, pos: int) -> list[tuple]:
    """Output rows of a piece: (conv_id, pos, turn, role_in, role, action, fragment)."""
    out = []
    before = entry
    for (conv, turn, role_in, text), after in zip(rows, states, strict=True):
        role = after - 1
        _, insert = STEPS[before, role]
        close = CLOSE if before != START else ""
        body = (text or "").replace(MARK, "<| im_")
        merge = before == after
        if insert is not None:
            out.append((conv, pos, None, None, ROLES[insert], "insert", close + head(insert)))
            pos, close = pos + 1, CLOSE
        relabelled = known_role(role_in) != role
        action = "+".join([x for x, on in (("relabel", relabelled), ("merge", merge)) if on]) or "keep"
        out.append((conv, pos, turn, role_in, ROLES[role], action, "\n\n" + body if merge else close + head(role) + body))
        pos, before = pos + 1, after
    if last and out:
        if before == SYSTEM:
            out.append((conv, pos, None, None, "user", "insert", CLOSE + head(1)))
        out[-1] = (*out[-1][:-1], out[-1][-1] + CLOSE)
    return out


def insertions(entry: int, states: list[int]) -> int:
    before, n = entry, 0
    for after in states:
        n += STEPS[before, after - 1][1] is not None
        before = after
    return n


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, pos, turn, role_in, role, action (keep, merge, relabel, relabel+merge, insert), fragment."""
    shared_dir(turns.sparkSession)
    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("h")]
    placed = picked.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("h").checkpoint()
    # a task's first and last conversation are all that can run over partitions
    ends = placed.groupBy(F.spark_partition_id().alias("part"), F.col("conv_id")).agg(F.count("*").alias("n"))
    spread = [r["conv_id"] for r in ends.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conv_id").collect()]
    plan = _plan(placed, spread)
    ddl = "conv_id long,pos long,turn long,role_in string,role string,action string,fragment string"
    schema = ddl_schema(ddl)

    def repair(batches):
        part = TaskContext.get().partitionId()

        def out(rows):
            got = plan.get((part, rows[0][0]))
            entry, leave, last, pos = got or (START, None, True, 0)
            return render(rows, entry, solve([turn_costs(*r) for r in rows], entry, leave), last, pos)

        ready = []
        for rows in runs(batches):
            ready += out(rows)
            if len(ready) > 2000:
                yield table(schema, zip(*ready, strict=True))
                ready = []
        if ready:
            yield table(schema, zip(*ready, strict=True))

    return placed.mapInArrow(repair, ddl)


def render_chats(turns: DataFrame, part_chars: int = 1_000_000) -> DataFrame:
    """conv_id, pos, text: the repaired conversations as text. A conversation is one row, or, over
    ``part_chars`` or over partitions, several: its text is theirs joined by ``pos``."""
    ddl = "conv_id long,pos long,text string"
    schema = ddl_schema(ddl)

    def join(batches):
        at, start, held, size, ready = None, 0, [], 0, []
        for batch in batches:
            for conv, pos, fragment in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (at != conv or size >= part_chars):
                    ready.append((at, start, "".join(held)))
                    held, size = [], 0
                if not held:
                    at, start = conv, pos
                held.append(fragment)
                size += len(fragment)
            if ready:
                yield table(schema, zip(*ready, strict=True))
                ready = []
        if held:
            yield table(schema, [[at], [start], ["".join(held)]])

    return format_chats(turns).select("conv_id", "pos", "fragment").mapInArrow(join, ddl)


def runs(batches):
    """The rows of each conversation in a sorted partition."""
    held: list[tuple] = []
    for part in slices(batches):
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _plan(placed: DataFrame, spread: list) -> dict:
    """(partition, conv_id) -> entry, exit, whether it ends there, and first position, for
    the conversations that run over partitions. There are fewer of these than partitions."""
    if not spread:
        return {}
    known = [c for c in spread if c is not None]
    mine = F.col("conv_id").isin(known) if known else F.lit(False)
    if None in spread:
        mine = mine | F.col("conv_id").isNull()
    schema = pa.schema([("part", pa.int64()), ("conv_id", pa.int64()), ("cells", pa.list_(pa.string()))])

    def measure(batches):
        part = TaskContext.get().partitionId()
        for rows in runs(batches):
            cells = [None if c is None else str(c) for line in matrix([turn_costs(*r) for r in rows]) for c in line]
            yield table(schema, [[part], [rows[0][0]], [cells]])

    def count(batches):
        part = TaskContext.get().partitionId()
        for rows in runs(batches):
            entry, leave = ways[part, rows[0][0]]
            n = len(rows) + insertions(entry, solve([turn_costs(*r) for r in rows], entry, leave))
            yield table(ddl_schema("part long,conv_id long,n long"), [[part], [rows[0][0]], [n]])

    pieces: dict = {}
    for r in placed.where(mine).mapInArrow(measure, "part long, conv_id long, cells array<string>").collect():
        pieces.setdefault(r["conv_id"], []).append((r["part"], np.array([None if c is None else int(c) for c in r["cells"]], object).reshape(4, 4).tolist()))
    ways = {}
    for conv, own in pieces.items():
        own.sort(key=lambda x: x[0])
        for (part, _), way in zip(own, chain([m for _, m in own]), strict=True):
            ways[part, conv] = way
    sizes = {(r["part"], r["conv_id"]): r["n"] for r in placed.where(mine).mapInArrow(count, "part long, conv_id long, n long").collect()}
    plan, pos = {}, {}
    for conv, own in pieces.items():
        for part, _ in own:
            at = pos.get(conv, 0)
            plan[part, conv] = (*ways[part, conv], part == own[-1][0], at)
            pos[conv] = at + sizes[part, conv]
    return plan
