"""Linkage and two-means by blocks and rounds give what one matrix a meeting gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.operators import linkage, voices

WINDOW = "meeting_id long, window long, start_s double, end_s double, vector array<double>"


def meetings(seed, sizes, spread=0.5, dims=6):
    """Windows of a few voices each, every fifth one short and some repeated word for word."""
    rng, out = np.random.default_rng(seed), []
    for m, n in enumerate(sizes):
        centers = rng.normal(size=(4, dims))
        x = centers[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dims))
        x[: n // 6] = x[0]
        out += [(m, 10 * w + m, 0.0, 0.5 if w % 5 == 4 else 2.0, v) for w, v in enumerate(x.tolist())]
    return out


def plainly(rows, stop, max_clusters=None):
    out = {}
    for m in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == m), key=lambda r: r[1])
        x, long = np.array([r[4] for r in mine]), np.array([r[3] - r[2] >= 1.2 for r in mine])
        if long.sum() >= 3 and not long.all():
            label = np.empty(len(x), np.int64)
            label[long] = voices.average_linkage(x[long], stop, max_clusters)
            centers = np.array([x[long][label[long] == k].mean(axis=0) for k in range(label[long].max() + 1)])
            label[~long] = np.argmax(np.round(voices._unit(x[~long]) @ voices._unit(centers).T, 12), axis=1)
        else:
            label = voices.average_linkage(x, stop, max_clusters)
        out |= {(m, r[1]): int(k) for r, k in zip(mine, label)}
    return out


@pytest.mark.parametrize("stop, in_task, block", [(0.45, 2000, 1024), (0.45, 5, 9), (0.2, 1, 7), (0.9, 12, 16), (-1.0, 3, 8)])
def test_clusters_of_random_meetings(spark, stop, in_task, block):
    """All in a task, and by rounds over blocks to the end or to a few."""
    rows = meetings(1, (3, 40, 17, 1))
    got = linkage.clustered(spark.createDataFrame(rows, WINDOW), stop, in_task=in_task, block=block)
    assert {(r.meeting_id, r.window): r.label for r in got.collect()} == plainly(rows, stop)


def test_clusters_up_to_a_number(spark):
    rows = meetings(2, (30, 12))
    got = linkage.clustered(spark.createDataFrame(rows, WINDOW), 0.1, max_clusters=3, in_task=6, block=8)
    assert {(r.meeting_id, r.window): r.label for r in got.collect()} == plainly(rows, 0.1, 3)


def test_clusters_of_zero_vectors_and_of_copies(spark):
    rows = [(1, w, 0.0, 2.0, [0.0, 0.0] if w % 3 == 0 else [1.0, 2.0]) for w in range(30)] + [(None, 1, 0.0, 2.0, [1.0, 0.0])]
    got = linkage.clustered(spark.createDataFrame(rows[:30], WINDOW), in_task=3, block=4)
    assert {(r.meeting_id, r.window): r.label for r in got.collect()} == plainly(rows[:30], 0.45)
    assert linkage.clustered(spark.createDataFrame([], WINDOW)).collect() == []


def test_no_task_holds_a_meeting(spark):
    """A meeting with nearly all rows: groups hold two blocks, however many rows there are."""
    rows = meetings(3, (600, 5), dims=3)
    nodes = spark.createDataFrame(rows, WINDOW).select("meeting_id", F.col("window").alias("node"), F.lit(1).alias("size"), F.col("vector").alias("total"))
    seen = spark.sparkContext.accumulator(0)

    def look(low, high):
        import pandas as pd

        if len(low) > 120 or len(high) > 120:
            seen.add(1)
        return pd.DataFrame({"n": [len(low) * (len(high) if low is not high else 0) + (len(low) * (len(low) - 1) // 2 if low is high else 0)]})

    pairs = linkage.by_block_pairs(nodes, ["meeting_id"], 60, look, "n long").groupBy("meeting_id").agg(F.sum("n").alias("n"))
    assert {r.meeting_id: r.n for r in pairs.collect()} == {0: 600 * 599 // 2, 1: 10} and seen.value == 0


LABELLED = "meeting_id long, label long, window long, region long, start_s double, end_s double, vector array<double>"


@pytest.mark.parametrize("block", [7, 64])
def test_halves_of_random_clusters(spark, block):
    """One label holds most rows; halves, shares and cosines agree with those of one task."""
    rng = np.random.default_rng(5)
    rows = [(k % 3 // 2, int(rng.random() < 0.15), k, k % 4, 0.0, float(rng.integers(1, 9)), (rng.normal(size=5) + [3 * (k % 2), 0, 0, 0, 0]).tolist()) for k in range(150)]
    w = spark.createDataFrame(rows, LABELLED)
    one, many = (sorted(map(tuple, linkage.diagnosed(w, in_task=n, block=block).collect())) for n in (2000, 4))
    assert [r[:-1] for r in one] == [r[:-1] for r in many]
    assert [r[-1] for r in one] == pytest.approx([r[-1] for r in many], abs=1e-4)


def test_halves_of_copies(spark):
    rows = [(1, 0, k, k, 0.0, 1.0, [1.0, 1.0]) for k in range(9)] + [(1, 1, k, k, 0.0, 0.0, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(9)]
    w = spark.createDataFrame(rows, LABELLED)
    for n in (2000, 2):
        got = {r.label: (r.mixed, r.split_cosine) for r in linkage.diagnosed(w, in_task=n, block=4).collect()}
        assert got == {0: (False, 1.0), 1: (False, 0.0)}
