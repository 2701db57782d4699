"""Order-dependent folds: what one row decides depends on all decisions before it.

Spark deals rows out by meeting and sorts them; each meeting is folded by a small function. A group is one
recording, so it is bounded by the length of a meeting, not by the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from confab.functions.arrow import base_form, matching_ratio


def fold(df: DataFrame, key: str, order: list[str], step: Callable[[dict[str, list]], Iterable[tuple]], schema: str, key_type: str = "long") -> DataFrame:
    """``step`` over the columns of each key's sorted rows; its tuples become rows, after the key.

    Rows are dealt by key and sorted by Spark, then read as a stream: a task holds one key's rows
    at a time, and a small group costs no more than its rows."""
    names = df.columns
    ddl = f"{key} {key_type}, {schema}"
    out = to_arrow_schema(_parse_datatype_string(ddl))

    def groups(batches):
        held: list[list] = []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for same, part in groupby(rows, key=itemgetter(names.index(key))):
                if held and held[0][names.index(key)] != same:
                    yield held
                    held = []
                held += part
        if held:
            yield held

    def run(batches):
        ready: list[tuple] = []
        for rows in groups(batches):
            columns = dict(zip(names, map(list, zip(*rows))))
            ready += [(columns[key][0], *r) for r in step(columns)]
            if len(ready) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), out)], schema=out)
                ready = []
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), out)], schema=out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, ddl)


def running(df: DataFrame, key: str, order: list[str], begin: Callable[[], object], step: Callable[[object, dict], Iterable[tuple]], schema: str, key_type: str = "long", end: Callable[[object], Iterable[tuple]] | None = None) -> DataFrame:
    """As ``fold``, for steps that need only a state of what came before: rows pass one at a time,
    so a key with very many rows costs a task its state, not its rows."""
    names = df.columns
    ddl = f"{key} {key_type}, {schema}"
    out = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        ready: list[tuple] = []
        at, state, some = None, None, False
        last = lambda: ((at, *r) for r in end(state)) if end and some else ()
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                if not some or row[key] != at:
                    ready += last()
                    at, state, some = row[key], begin(), True
                ready += ((at, *r) for r in step(state, row))
            if len(ready) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), out)], schema=out)
                ready = []
        ready += last()
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), out)], schema=out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, ddl)


# --- windows --------------------------------------------------------------------------


def cut_equally(start: float, end: float, most: float) -> list[tuple[float, float]]:
    n = math.ceil((end - start) / most)
    if n <= 1:
        return [(start, end)]
    edges = [round(start + k * (end - start) / n, 3) for k in range(n + 1)]
    return list(zip(edges, edges[1:]))


def pack(regions: Iterable[tuple[float, float]], shortest: float = 1.5, target: float = 12.0, stretch: float = 20.0, cap: float = 28.0, gap: float = 3.0) -> list[list[tuple[float, float]]]:
    """Regions gathered into windows: up to the target's length, or up to the stretch while a
    window is still too short; never over a gap or the cap. A window that stays too short
    joins the one before it if both fit under the cap. Regions over the cap are cut, and the
    pieces taken in order of their times, also where a region starts inside one that is cut."""
    if not 0 < shortest <= target <= stretch <= cap:
        raise ValueError("lengths must not decrease: shortest, target, stretch, cap")

    def takes(window, piece):
        length, grown = window[-1][1] - window[0][0], piece[1] - window[0][0]
        return piece[0] - window[-1][1] <= gap and grown <= (stretch if length < shortest else target) and grown <= cap

    packed: list[list[tuple[float, float]]] = []
    for piece in sorted(p for start, end in regions if end > start for p in cut_equally(start, end, cap)):
        if packed and takes(packed[-1], piece):
            packed[-1].append(piece)
        else:
            packed.append([piece])
    out: list[list[tuple[float, float]]] = []
    for w in packed:
        if out and w[-1][1] - w[0][0] < shortest and w[-1][1] - out[-1][0][0] <= cap:
            out[-1] += w
        else:
            out.append(w)
    return out


def packed_windows(regions: DataFrame, key: str = "meeting_id", **limits) -> DataFrame:
    """(key, window, start_s, end_s, regions, speech_s) of regions (start_s, end_s)."""

    def step(rows):
        for k, w in enumerate(pack(zip(rows["start_s"], rows["end_s"]), **limits)):
            yield k, w[0][0], w[-1][1], len(w), sum(b - a for a, b in w)

    return fold(regions, key, ["start_s", "end_s"], step, "window int, start_s double, end_s double, regions int, speech_s double")


def merge_by_energy(regions: Iterable[tuple[float, float]], gap: float = 0.45, most: float = 12.0) -> list[tuple[float, float]]:
    """Neighbours less than ``gap`` apart become one while both fit in ``most`` seconds; longer ones are cut equally."""
    out: list[tuple[float, float]] = []
    for a, b in regions:
        if out and a - out[-1][1] < gap and b - out[-1][0] <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [p for a, b in out for p in cut_equally(a, b, most)]


def merged_regions(regions: DataFrame, key: str = "meeting_id", gap: float = 0.45, most: float = 12.0) -> DataFrame:
    step = lambda rows: ((k, a, b) for k, (a, b) in enumerate(merge_by_energy(zip(rows["start_s"], rows["end_s"]), gap, most)))
    return fold(regions, key, ["start_s", "end_s"], step, "region int, start_s double, end_s double")


def speech_regions(probabilities: Iterable[float], frame_s: float = 0.032, on: float = 0.5, off: float = 0.35, min_silence: float = 0.4, min_speech: float = 0.25, pad: float = 0.2, most: float = 20.0) -> list[tuple[float, float]]:
    """Speech from frame probabilities with hysteresis: it starts at ``on``, and ends once
    ``min_silence`` has passed below ``off``; short speech is left out, long speech is cut."""
    found: list[tuple[float, float]] = []
    start = quiet = None
    n = 0
    for n, p in enumerate(probabilities, 1):
        at = (n - 1) * frame_s
        if start is None:
            start = at if p >= on else None
        elif p >= off:
            quiet = None if p >= on else quiet
            if at + frame_s - start >= most:
                found.append((start, at + frame_s))
                start, quiet = at + frame_s, None
        else:
            quiet = at if quiet is None else quiet
            if at + frame_s - quiet >= min_silence:
                found.append((start, quiet))
                start = quiet = None
    end = n * frame_s
    if start is not None and start < end:
        found.append((start, end))
    found = [(a, b) for a, b in found if b - a >= min_speech]
    out = []
    for k, (a, b) in enumerate(found):
        # neighbours share the silence between them if it cannot hold both pads
        left = min(pad, (a - found[k - 1][1]) / 2) if k else min(pad, a)
        right = min(pad, (found[k + 1][0] - b) / 2) if k + 1 < len(found) else min(pad, end - b)
        out.append((round(a - left, 3), round(b + right, 3)))
    return out


def inherited_languages(windows: DataFrame, key: str = "meeting_id", shortest: float = 4.0) -> DataFrame:
    """Windows under ``shortest`` seconds speak the language decided for the window before; a first one keeps its own."""

    def step(state, row):
        taken = row["end_s"] - row["start_s"] < shortest and state["language"] is not None
        state["language"] = state["language"] if taken else row["language"]
        yield row["window"], state["language"], taken

    return running(windows, key, ["window"], lambda: {"language": None}, step, "window int, language string, inherited boolean")


def repaired_overlaps(segments: DataFrame, key: str = "meeting_id", guard: float = 0.1) -> DataFrame:
    """Where neighbours of different speakers overlap, both end and start in the middle of the
    overlap, unless that leaves either no more than ``guard`` seconds. Each repair is seen by the next pair."""

    def step(rows):
        out = [list(r) for r in zip(rows["segment_id"], rows["start_s"], rows["end_s"], rows["speaker"])]
        for a, b in zip(out, out[1:]):
            middle = round((a[2] + b[1]) / 2, 3)
            if a[3] != b[3] and a[2] > b[1] and a[1] + guard < middle < b[2] - guard:
                a[2] = b[1] = middle
        yield from ((i, s, e) for i, s, e, _ in out)

    return fold(segments, key, ["start_s", "end_s", "segment_id"], step, "segment_id string, start_s double, end_s double")


# --- chunks ---------------------------------------------------------------------------


def chunk_lines(costs: list[int], turns: set[int], budget: int = 2300, overlap: int = 200, back: int = 2) -> list[tuple[int, int, int]]:
    """(first line, first fresh line, last line) of each chunk.

    A chunk repeats the tail of the one before it as far as ``overlap`` allows, and takes fresh
    lines up to ``budget``. It ends before a turn where one starts within the last ``back`` lines.
    A tail that leaves no room is dropped; a line over the budget is a chunk of its own."""
    out: list[tuple[int, int, int]] = []
    n, fresh = len(costs), 0
    while fresh < n:
        first, used = fresh, 0
        while out and first > 0 and used + costs[first - 1] <= overlap:
            first -= 1
            used += costs[first]

        def reach(at, spent):
            while at < n and spent + costs[at] <= budget:
                spent += costs[at]
                at += 1
            return at

        stop = reach(fresh, used)
        if stop == fresh:
            first, stop = fresh, max(reach(fresh, 0), fresh + 1)
        if stop < n:
            stop = next((s for s in range(stop, max(stop - back - 1, fresh), -1) if s in turns), stop)
        out.append((first, fresh, stop - 1))
        fresh = stop
    return out


def chunks(lines: DataFrame, key: str = "meeting_id", budget: int = 2300, overlap: int = 200, chars_per_token: float = 2.0) -> DataFrame:
    """lines: key, idx, line, turn_start. A line costs its tokens and one for its break."""

    def step(rows):
        texts = rows["line"]
        costs = [math.ceil(len(t) / chars_per_token) + 1 for t in texts]
        at = rows["idx"]
        turns = {k for k, t in enumerate(rows["turn_start"]) if t}
        for k, (first, fresh, last) in enumerate(chunk_lines(costs, turns, budget, overlap)):
            yield k, at[first], at[fresh], at[last], "\n".join(texts[first : last + 1])

    return fold(lines, key, ["idx"], step, "chunk int, first_idx int, fresh_idx int, last_idx int, text string")


# --- items ----------------------------------------------------------------------------

LEVELS = {"low": 0, "medium": 1, "high": 2}


def same_item(a: dict, b: dict, ratio: float = 0.82, distance: int = 12) -> bool:
    """Items of one chunk are the same by text; of different chunks by a shared line, or by
    text if their first lines are close."""
    if a["chunk"] is not None and a["chunk"] == b["chunk"]:
        near = True
    elif set(a["evidence"]) & set(b["evidence"]):
        return True
    else:
        near = abs(min(a["evidence"]) - min(b["evidence"])) <= distance
    return near and matching_ratio(base_form(a["text"]), base_form(b["text"])) >= ratio


def united(a: dict, b: dict) -> dict:
    """``a``, reported first, with what ``b`` adds: the longer text, all lines, the higher
    priority, up to three speakers, and an owner and a deadline where ``a`` has none."""
    speakers = list(dict.fromkeys([*(a["speakers"] or []), *(b["speakers"] or [])]))[:3]
    return {
        "text": b["text"] if len(b["text"]) > len(a["text"]) else a["text"],
        "evidence": sorted({*a["evidence"], *b["evidence"]}),
        "chunk": a["chunk"],
        "priority": max(a["priority"] or "low", b["priority"] or "low", key=lambda x: LEVELS.get(x, 0)),
        "owner": b["owner"] if a["owner"] is None else a["owner"],
        "deadline": b["deadline"] if a["deadline"] is None else a["deadline"],
        "speakers": speakers,
    }


def merge_in_order(items: Iterable[dict]) -> list[dict]:
    """Each item joins the first one before it that is the same; the result is by first line."""
    out: list[dict] = []
    for item in items:
        if len(item["evidence"]):
            k = next((k for k, x in enumerate(out) if same_item(x, item)), None)
            if k is None:
                out.append(item)
            else:
                out[k] = united(out[k], item)
    return sorted(out, key=lambda x: min(x["evidence"]))


ITEM = "text string, evidence array<int>, chunk int, priority string, owner string, deadline string, speakers array<string>"


def merged_items(items: DataFrame, key: str = "meeting_id", order: str = "pos") -> DataFrame:
    """items: key, pos and ``ITEM``. Not transitive, and the order matters."""
    fields = [c.split(" ")[0] for c in ITEM.split(", ")]

    def step(rows):
        given = [{f: v or [] if f in ("evidence", "speakers") else v for f, v in zip(fields, r)} for r in zip(*(rows[f] for f in fields))]
        for k, item in enumerate(merge_in_order(given)):
            yield (k, *(item[f] for f in fields))

    return fold(items, key, [order], step, "item int, " + ITEM)


def greedy_pairs(candidates: DataFrame, key: str = "meeting_id") -> DataFrame:
    """One-to-one pairs of candidates (key, gold, pred, ratio), best ratio first; of equal
    ratios the higher numbers come first."""

    def step(rows):
        gold, pred = set(), set()
        for r, g, p in sorted(zip(rows["ratio"], rows["gold"], rows["pred"]), reverse=True):
            if g not in gold and p not in pred:
                gold.add(g)
                pred.add(p)
                yield g, p, r

    return fold(candidates, key, ["gold", "pred"], step, "gold int, pred int, ratio double")
