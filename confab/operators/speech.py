"""Speech regions from frame probabilities with hysteresis, one recording over many tasks.

Whether a frame is speech depends on all frames before it, but only through a state: no region, or one
that began so many frames ago, with a silence that began so many frames ago. Both counts are bounded by the limits, so
states are finite, and a piece of frames is a map from entry states to exit states. Pieces make
their maps at the same time; a stream over the maps, which are short, hands each piece its
entry; then pieces find their regions at the same time too. Within a few frames nearly all states
fall together, so a map costs little more than reading its piece.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.operators.folds import running
from confab.sources.stores import scratch


@dataclass(frozen=True)
class Limits:
    """Speech starts at ``on`` and ends once ``min_silence`` has passed below ``off``; shorter speech than
    ``min_speech`` is left out, longer than ``most`` is cut; times in seconds."""

    frame_s: float = 0.032
    on: float = 0.5
    off: float = 0.35
    min_silence: float = 0.4
    min_speech: float = 0.25
    pad: float = 0.2
    most: float = 20.0

    def frames(self, seconds: float) -> int:
        return max(1, math.ceil(seconds / self.frame_s - 1e-9))

    def kinds(self, probabilities: np.ndarray) -> np.ndarray:
        """0 below ``off``, 2 from ``on``, 1 between."""
        return (probabilities >= self.off).astype(np.int8) + (probabilities >= self.on)


#: A state is (frames since the region began, frames since its silence began); without a region -1, 0.
CLOSED = (-1, 0)


def step(length, quiet, kind: int, silence: int, most: int):
    """The states after one more frame, of arrays of states."""
    inside = length >= 0
    if kind == 0:
        quiet = np.where(quiet > 0, quiet + 1, 1)
        stays = inside & (quiet < silence)
        return np.where(stays, length + 1, -1), np.where(stays, quiet, 0)
    quiet = np.where((quiet > 0) & (kind == 1), quiet + 1, 0)
    longer = np.where(inside, length + 1, 1 if kind == 2 else -1)
    cut = inside & (longer >= most)
    return np.where(cut, 0, longer), np.where(cut, 0, quiet)


def entries(silence: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All states that a recording can be in."""
    length, quiet = np.tril_indices(most + silence)
    return np.concatenate(([-1], length)), np.concatenate(([0], quiet))


def state_map(kinds: np.ndarray, silence: int, most: int) -> tuple[list[int], list[int], list[int]]:
    """Runs of entry states, in the order of ``entries``, that leave in one state: first entries, and the exits' two parts."""
    length, quiet = entries(silence, most)
    which = np.arange(len(length))
    for k, kind in enumerate(kinds.tolist()):
        length, quiet = step(length, quiet, kind, silence, most)
        # entries fall together at the first speech, at a long silence, or by and by
        if len(length) > 1 and (kind == 2 and k < 2 or k % 16 == 15):
            both, back = np.unique(length * (most + silence + 1) + quiet, return_inverse=True, return_index=True)[1:]
            length, quiet, which = length[both], quiet[both], back[which]
        if len(length) == 1 and k + 1 < len(kinds):
            end = follow(kinds[k + 1 :], (int(length[0]), int(quiet[0])), silence, most)[1]
            length, quiet = np.array([end[0]]), np.array([end[1]])
            break
    a, b = length[which], quiet[which]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return first.tolist(), a[first].tolist(), b[first].tolist()


def follow(kinds: np.ndarray, state: tuple[int, int], silence: int, most: int) -> tuple[list[tuple[int, int]], tuple[int, int]]:
    """Regions that end in a piece, in frames from its start, and the state it is left in."""
    found, (length, quiet) = [], state
    for at, kind in enumerate(kinds.tolist(), 1):
        if length < 0:
            length = 1 if kind == 2 else -1
        elif kind == 0:
            quiet += 1
            length += 1
            if quiet >= silence:
                found.append((at - length, at - quiet))
                length, quiet = -1, 0
        else:
            quiet = quiet + 1 if quiet and kind == 1 else 0
            length += 1
            if length >= most:
                found.append((at - length, at))
                length = quiet = 0
    return found, (length, quiet)


def entry_index(length: int, quiet: int) -> int:
    """Where a state stands among ``entries``."""
    return 0 if length < 0 else 1 + length * (length + 1) // 2 + quiet


def pieces_of(frames: DataFrame, key: str, piece_frames: int) -> DataFrame:
    """key, piece, pieces, frames: the probabilities of a piece in order. A recording's frame numbers are
    cut into equal spans, as many as its count asks for."""
    sizes = frames.groupBy(key).agg(F.min("frame").alias("__lo"), F.max("frame").alias("__hi"), F.ceil(F.count("*") / piece_frames).cast("long").alias("pieces"))
    at = F.floor((F.col("frame") - F.col("__lo")) * F.col("pieces") / (F.col("__hi") - F.col("__lo") + 1)).cast("long")
    dealt = frames.join(sizes, key).select(key, at.alias("piece"), "pieces", "frame", F.col("probability").cast("double").alias("p"))
    each = dealt.groupBy(key, "piece", "pieces").agg(F.array_sort(F.collect_list(F.struct("frame", "p"))).alias("frames"))
    return each.select(key, "piece", "pieces", F.transform("frames", lambda x: F.coalesce(x["p"], F.lit(0.0))).alias("frames"))


def detected_speech(frames: DataFrame, key: str = "meeting_id", limits: Limits = Limits(), piece_frames: int = 8_192) -> DataFrame:
    """key, region, start_s, end_s from frames (key, frame, probability; a null probability is silence).

    Pieces are written once; recordings of one piece need no map. Regions are padded by ``pad``, but
    neighbours share the silence between them if it cannot hold both pads."""
    spark, kind = frames.sparkSession, frames.schema[key].dataType.simpleString()
    silence, most = limits.frames(limits.min_silence), limits.frames(limits.most)
    path = scratch(spark, "speech-pieces")
    pieces_of(frames, key, piece_frames).write.parquet(path)
    pieces = spark.read.parquet(path)

    def lists(column: pa.Array) -> list[np.ndarray]:
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(column.offsets.to_numpy()))
        return np.split(flat, ends[:-1]) if len(column) else []

    def maps(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [state_map(limits.kinds(p), silence, most) for p in lists(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(p) for p in lists(part.column(2))], pa.int64()), *(pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in range(3))], names=[key, "piece", "n", "first", "length", "quiet"])

    mapped = pieces.where("pieces > 1").select(key, "piece", "frames").mapInArrow(maps, f"{key} {kind}, piece long, n long, first array<int>, length array<int>, quiet array<int>")

    def enter(state, row):
        yield row["piece"], state["before"], *state["at"]
        k = int(np.searchsorted(row["first"], entry_index(*state["at"]), side="right")) - 1
        state["at"], state["before"] = (row["length"][k], row["quiet"][k]), state["before"] + row["n"]

    entered = running(mapped, key, ["piece"], lambda: {"at": CLOSED, "before": 0}, enter, "piece long, before long, length int, quiet int", kind)
    single = pieces.where("pieces = 1").select("*", F.lit(0).cast("long").alias("before"), F.lit(-1).alias("length"), F.lit(0).alias("quiet"))
    ready = single.unionByName(pieces.where("pieces > 1").join(entered, [key, "piece"]))

    def regions(batches):
        for batch in batches:
            rows = []
            for name, piece, of, before, length, quiet, p in zip(*(batch.column(k).to_pylist() for k in range(6)), lists(batch.column(6)), strict=True):
                found, (left, _) = follow(limits.kinds(p), (length, quiet), silence, most)
                if piece == of - 1:
                    # what is open at the end lasts to the end, and the end is told in any case
                    found += [(len(p) - left, len(p))] if left > 0 else []
                    rows.append((name, None, before + len(p)))
                rows += [(name, before + a, before + b) for a, b in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.types[0], pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (batch.schema.types[0], pa.int64(), pa.int64())], names=[key, "a", "b"])

    found = ready.select(key, "piece", "pieces", "before", "length", "quiet", "frames").mapInArrow(regions, f"{key} {kind}, a long, b long")
    by = Window.partitionBy(key)
    long = found.withColumn("n", F.max(F.when(F.col("a").isNull(), F.col("b"))).over(by)).where(F.col("b") - F.col("a") >= limits.frames(limits.min_speech))
    order = by.orderBy("a")
    s = lambda c: F.col(c) * limits.frame_s
    before, after = F.lag("b").over(order) * limits.frame_s, F.lead("a").over(order) * limits.frame_s
    start = s("a") - F.least(F.lit(limits.pad), F.coalesce((s("a") - before) / 2, s("a")))
    end = s("b") + F.least(F.lit(limits.pad), F.coalesce((after - s("b")) / 2, s("n") - s("b")))
    return long.select(key, (F.row_number().over(order) - 1).alias("region"), F.round(start, 3).alias("start_s"), F.round(end, 3).alias("end_s"))
