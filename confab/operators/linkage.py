"""Clusters of voices in meetings of any length: average linkage and two-means without a matrix a meeting.

All comparisons of a meeting's vectors with each other are made by blocks: vectors are dealt to blocks
of about ``block`` rows, and each pair of blocks is a group of its own, so a task holds two blocks
however long the meeting. That all are compared is what the methods mean; thresholds, sums
and rounds keep the rest in proportion to the vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.functions import vectors as V
from confab.operators import voices
from confab.sources.stores import scratch

#: Rows up to which a group is finished inside one task.
IN_TASK = 2_000


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Written once and read again, so that rounds do not run what came before them."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_block_pairs(nodes: DataFrame, by: list[str], block: int, look, ddl: str) -> DataFrame:
    """``look(low, high)`` of every pair of blocks of a group's ``nodes`` (node, size, total), as two
    frames in order of node; of a block with itself both are the same. ``ddl`` names what it returns after ``by``."""
    blocks = nodes.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    dealt = nodes.join(blocks, by).withColumn("__own", F.pmod(F.xxhash64("node"), "__n").cast("int"))
    each = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    pair = (F.least("__own", "__other").alias("__p"), F.greatest("__own", "__other").alias("__q"))
    rows = each.select(*by, *pair, (F.col("__own") <= F.col("__other")).alias("__low"), "node", "size", "total")

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        low, high = group[group["__low"]], group[~group["__low"]]
        found = look(low, low if key[-1] == key[-2] else high)
        for name, value in zip(reversed(by), reversed(key[: len(by)])):
            found.insert(0, name, value)
        return found

    names = {f.name: f.dataType.simpleString() for f in nodes.schema}
    return rows.groupBy(*by, "__p", "__q").applyInPandas(run, ", ".join([*(f"{c} {names[c]}" for c in by), ddl]))


def _distances(low: pd.DataFrame, high: pd.DataFrame) -> np.ndarray:
    """Mean cosine distances of clusters from their sums of unit vectors."""
    a, b = (np.array(x["total"].tolist(), np.float64) for x in (low, high))
    return np.round(1.0 - a @ b.T / np.outer(low["size"], high["size"]), 12)


def _nearest(low: pd.DataFrame, high: pd.DataFrame) -> pd.DataFrame:
    """Each node's nearest one on the other side, of equals the first."""
    empty = pd.DataFrame({"node": [], "gap": [], "other": []})
    if not len(low) or not len(high):
        return empty
    gap, a, b = _distances(low, high), low["node"].to_numpy(), high["node"].to_numpy()
    gap[a[:, None] == b[None, :]] = np.inf
    k = gap.argmin(axis=1)
    out = [pd.DataFrame({"node": a, "gap": gap[np.arange(len(a)), k], "other": b[k]})]
    if low is not high:
        k = gap.argmin(axis=0)
        out.append(pd.DataFrame({"node": b, "gap": gap[k, np.arange(len(b))], "other": a[k]}))
    found = pd.concat(out)
    return found[np.isfinite(found["gap"])]


def joined_neighbours(nodes: DataFrame, stop: float, block: int) -> DataFrame:
    """(meeting_id, node, into): pairs of clusters that are nearest to each other and at most ``stop`` apart.

    Average linkage is reducible: a merge never brings the result nearer to a third cluster than the
    nearer of both was. So such a pair merges sooner or later whatever else does, and all of them may at once."""
    best = by_block_pairs(nodes, ["meeting_id"], block, _nearest, "node long, gap double, other long")
    # of equally near ones the pair with the lowest members, so that the choice is mutual
    first = F.struct("gap", F.least("node", "other"), F.greatest("node", "other"))
    best = best.where(F.col("gap") <= stop).groupBy("meeting_id", "node").agg(F.min_by("other", first).alias("other"))
    back = best.select("meeting_id", F.col("node").alias("other"), F.col("other").alias("node"))
    return best.join(back, ["meeting_id", "node", "other"]).where("other < node").select("meeting_id", "node", F.col("other").alias("into"))


def average_linked(members: DataFrame, stop: float = 0.45, max_clusters: int | None = None, in_task: int = IN_TASK, block: int = 1_024) -> DataFrame:
    """(meeting_id, window, root) of ``members`` (meeting_id, window, vector): ``root`` is the first
    window of a window's cluster.

    Equal vectors are one node from the start. Meetings of more than ``in_task`` nodes merge mutual
    nearest clusters by rounds over blocks, all of a round at once, until they are that few or none is
    near enough; the others, and what rounds leave, are finished in a task each. With ``max_clusters``
    the rounds keep to ``stop`` and a task goes on beyond it, holding a meeting's cluster sums."""
    unit = members.select("meeting_id", "window", V.unit("vector").alias("unit"))
    # a zero vector is near nothing, not even its like
    alike = F.when(F.exists("unit", lambda x: x != 0) & F.lit(stop >= 0), F.lit(None)).otherwise(F.col("window"))
    keyed = unit.withColumn("__alone", alike)
    nodes = keyed.groupBy("meeting_id", "unit", "__alone").agg(F.min("window").alias("node"), F.count("*").alias("size"))
    nodes = nodes.select("meeting_id", "node", "size", F.transform("unit", lambda x: x * F.col("size")).alias("total"))
    nodes = _kept(nodes, "linkage-nodes")
    own = keyed.withColumn("node", F.min("window").over(Window.partitionBy("meeting_id", "unit", "__alone"))).select("meeting_id", "window", "node")
    roots = _kept(own, "linkage-roots")
    done = None
    while True:
        count = F.count("*").over(Window.partitionBy("meeting_id"))
        sizes = nodes.groupBy("meeting_id").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > in_task).select("meeting_id")
        if done is not None:
            large = large.join(done, "meeting_id", "left_anti")
        busy = nodes.join(large, "meeting_id", "left_semi")
        merges = _kept(joined_neighbours(busy, stop, block), "linkage-merges")
        moved = merges.select("meeting_id").distinct()
        still = _kept(large.join(moved, "meeting_id", "left_anti"), "linkage-done")
        if not merges.limit(1).count():
            done = still if done is None else done.unionByName(still)
            break
        done = still if done is None else done.unionByName(still)
        to = F.coalesce("into", "node")
        gone = nodes.join(merges, ["meeting_id", "node"], "left").select("meeting_id", to.alias("node"), "size", "total")
        both = F.collect_list("total")  # one or two
        sums = gone.groupBy("meeting_id", "node").agg(F.sum("size").alias("size"), both.alias("t"))
        total = F.when(F.size("t") > 1, F.zip_with(F.col("t")[0], F.col("t")[1], lambda x, y: x + y)).otherwise(F.col("t")[0])
        nodes = _kept(sums.select("meeting_id", "node", "size", total.alias("total")), "linkage-nodes")
        roots = _kept(roots.join(merges, ["meeting_id", "node"], "left").select("meeting_id", "window", to.alias("node")), "linkage-roots")

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("node")
        label = voices.linked(np.array(rows["total"].tolist(), np.float64), rows["size"].to_numpy(np.float64), stop, max_clusters)
        first = rows["node"].to_numpy()[np.unique(label, return_index=True)[1]]
        return pd.DataFrame({"meeting_id": rows["meeting_id"], "node": rows["node"], "root": first[label]})

    small = nodes if max_clusters is not None else nodes.join(done, "meeting_id", "left_anti")
    named = small.groupBy("meeting_id").applyInPandas(finish, "meeting_id long, node long, root long")
    return roots.join(named, ["meeting_id", "node"], "left").select("meeting_id", "window", F.coalesce("root", "node").alias("root"))


def clustered(windows: DataFrame, stop: float = 0.45, anchor_s: float = 1.2, max_clusters: int | None = None, in_task: int = IN_TASK, block: int = 1_024) -> DataFrame:
    """meeting_id, window, label: windows (meeting_id, window, start_s, end_s, vector) of a
    meeting clustered by voice. Turns of ``anchor_s`` and more form the clusters if there are
    three of them; shorter ones join the nearest. Labels are numbered by first window."""
    rows = windows.select("meeting_id", "window", (F.col("end_s") - F.col("start_s") >= anchor_s).alias("long"), V.as_double("vector").alias("vector"))
    share = rows.groupBy("meeting_id").agg((F.count_if("long") >= 3).alias("anchored"))
    rows = _kept(rows.join(share, "meeting_id").withColumn("member", F.col("long") | ~F.col("anchored")), "linkage-windows")
    found = _kept(average_linked(rows.where("member"), stop, max_clusters, in_task, block), "linkage")
    numbers = found.select("meeting_id", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("meeting_id").orderBy("root")).cast("long") - 1)
    labelled = found.join(numbers, ["meeting_id", "root"]).select("meeting_id", "window", "label")
    centers = voices.centroids(rows.where("member").join(labelled, ["meeting_id", "window"]), ["meeting_id", "label"])
    near = rows.where("not member").join(centers, "meeting_id").withColumn("score", F.round(V.cosine("vector", "centroid"), 12))
    short = near.groupBy("meeting_id", "window").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("label"))
    return labelled.unionByName(short)


# --- two voices in a cluster ----------------------------------------------------------


def _furthest(low: pd.DataFrame, high: pd.DataFrame) -> pd.DataFrame:
    """The pair with the least cosine, of equals the first."""
    if not len(low) or not len(high):
        return pd.DataFrame({"near": [], "a": [], "b": []})
    near = 1.0 - _distances(low, high)
    a, b = low["node"].to_numpy(), high["node"].to_numpy()
    first, second = np.minimum(a[:, None], b[None, :]), np.maximum(a[:, None], b[None, :])
    near = np.where(first < second, np.round(near, 12), np.inf)
    if not np.isfinite(near.min()):
        return pd.DataFrame({"near": [], "a": [], "b": []})
    at = np.flatnonzero(near.ravel() == near.min())
    k = at[np.lexsort((second.ravel()[at], first.ravel()[at]))[0]]
    return pd.DataFrame({"near": [near.ravel()[k]], "a": [first.ravel()[k]], "b": [second.ravel()[k]]})


_BY = ["meeting_id", "label"]


def halves(rows: DataFrame, rounds: int = 25, block: int = 1_024) -> tuple[DataFrame, DataFrame]:
    """Two-means of each group of ``rows`` (meeting_id, label, node, total: unit vectors): (meeting_id,
    label, node, half), and the groups' centres (meeting_id, label, half, centre).

    Begins from the two members furthest apart. A round gives each vector to the nearer centre and sums
    the halves up a dimension, so it shuffles as many rows as there are groups and dimensions."""
    nodes = rows.select(*_BY, "node", F.lit(1).alias("size"), "total")
    pairs = by_block_pairs(nodes, _BY, block, _furthest, "near double, a long, b long")
    pair = pairs.groupBy(*_BY).agg(F.min(F.struct("near", "a", "b")).alias("p"))
    ends = pair.select(*_BY, F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("p.a").alias("node")), F.struct(F.lit(1).alias("half"), F.col("p.b").alias("node")))).alias("e")).select(*_BY, "e.half", "e.node")
    centers = _kept(rows.join(ends, [*_BY, "node"]).select(*_BY, "half", F.col("total").alias("center")), "halves-centers")
    before = None
    for _ in range(rounds):
        two = [centers.where(f"half = {k}").select(*_BY, F.col("center").alias(f"c{k}")) for k in (0, 1)]
        near = F.coalesce(V.dot("total", "c1") > V.dot("total", "c0"), F.lit(False)).cast("int")
        new = _kept(rows.join(two[0], _BY, "left").join(two[1], _BY, "left").select(*_BY, "node", near.alias("half"), "total"), "halves")
        if before is not None:
            changed = new.join(before.select(*_BY, "node", F.col("half").alias("was")), [*_BY, "node"]).where("half <> was").limit(1).count()
            if not changed:
                break
        before = new
        mean = voices.centroids(new, [*_BY, "half"], vector="total").withColumnRenamed("centroid", "center")
        kept = centers.join(mean.select(*_BY, "half"), [*_BY, "half"], "left_anti")
        centers = _kept(mean.unionByName(kept), "halves-centers")
    return before.select(*_BY, "node", "half"), centers


def evidence(windows: DataFrame, min_regions: int = 3) -> DataFrame:
    """Per meeting and label, of windows with label, region, start_s and end_s: seconds, regions, and whether they are too few."""
    out = windows.groupBy(*_BY).agg(F.round(F.sum(F.col("end_s") - F.col("start_s")), 3).alias("seconds"), F.countDistinct("region").alias("regions"))
    return out.withColumn("short", F.col("regions") < min_regions)


def diagnosed(windows: DataFrame, min_regions: int = 3, min_half: float = 0.30, max_cosine: float = 0.55, in_task: int = IN_TASK, block: int = 1_024) -> DataFrame:
    """Per meeting and label, of windows with label, region, start_s, end_s and vector: speech,
    regions, and whether the cluster is short of evidence or may hold two voices.

    Clusters of up to ``in_task`` windows are halved in a task, larger ones by rounds over all tasks."""
    rows = windows.select(*_BY, F.col("window").alias("node"), (F.col("end_s") - F.col("start_s")).alias("s"), V.unit("vector").alias("total"))
    sizes = rows.groupBy(*_BY).agg(F.count("*").alias("n"))

    def look(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        half, cosine = voices.two_means(np.array(group["total"].tolist(), np.float64))
        s = group["s"].to_numpy()
        return pd.DataFrame([(*(group[c].iloc[0] for c in _BY), *(float(s[half == k].sum()) for k in (0, 1)), cosine, len(group))], columns=[*_BY, "s0", "s1", "cosine", "n"])

    small = rows.join(sizes.where(F.col("n") <= in_task), _BY, "left_semi")
    found = small.groupBy(*_BY).applyInPandas(look, "meeting_id long, label long, s0 double, s1 double, cosine double, n long")
    large = sizes.where(F.col("n") > in_task)
    if large.limit(1).count():
        big = _kept(rows.join(large, _BY, "left_semi"), "halves-rows")
        half, centers = halves(big, block=block)
        sums = big.join(half, [*_BY, "node"]).groupBy(*_BY).agg(*[F.sum(F.when(F.col("half") == k, F.col("s")).otherwise(0.0)).alias(f"s{k}") for k in (0, 1)], F.countDistinct("half").alias("used"), F.count("*").alias("n"))
        both = [centers.where(f"half = {k}").select(*_BY, F.col("center").alias(f"c{k}")) for k in (0, 1)]
        cosine = F.when(F.col("used") < 2, 1.0).otherwise(V.dot("c0", "c1"))
        found = found.unionByName(sums.join(both[0], _BY).join(both[1], _BY).select(*_BY, "s0", "s1", cosine.alias("cosine"), "n"))
    all_s = F.col("s0") + F.col("s1")
    share = F.when(all_s > 0, F.least("s0", "s1") / all_s).otherwise(0.0)
    mixed = (F.col("n") >= 2) & (share >= min_half) & (F.col("cosine") < max_cosine)
    return evidence(windows, min_regions).join(found, _BY).select(*_BY, "seconds", "regions", "short", mixed.alias("mixed"), F.round("cosine", 4).alias("split_cosine"))
