"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints link at ``distance``
or fewer differing bits; groups are the connected components of the links.

Search: correlated bits are grouped into partitions of equal width, so that skew gathers
in few of them. Partition i gets a threshold t_i with sum(t_i) = distance - m + 1, -1
skipping a partition; then any two linked fingerprints differ by at most t_i bits in some
partition i. A dynamic programme picks the thresholds with the least estimated cost, from
the exact histogram of each partition's values. A fingerprint is filed under its partition
value with every choice of t_i bits masked; fingerprints of one bucket are compared.

Only distinct fingerprints are searched, so copies cost nothing. In a bucket, links are
reduced to a star a component before they leave the task: at most one row a member, never
all pairs. Buckets that the histograms show to hold over ``bucket_cap`` fingerprints are
split exactly: what agrees in the partition must agree in one of ``distance + 1`` parts of
the other bits, so its rows are filed under each of these parts.

Components: alternating large-star and small-star rounds over the links, each written to
the shared folder, until the links no longer change. Nothing but bounded statistics
(a 64 x 64 matrix, histograms of at most 2**16 values a partition) reaches the driver.

Edge cases: a text with fewer words than a shingle is one shingle; without words, or null,
its fingerprint is zero, linked like any other. Null ids share groups, and a group whose
ids are all null has a null component. Repeated rows stay. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, slices, spread_join, table

BITS = 64


# --- fingerprints ---------------------------------------------------------------------


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned SimHash: a bit is set if it is set in over half of the shingle hashes."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    starts, ends, p = [], [], 0
    for w in words:
        starts.append(p)
        p += len(w)
        ends.append(p)
        p += 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[width - 1 :]) if len(words) > width else [(0, len(joined))]
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
    n, counts = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, key, fp (the fingerprint's bits as a signed long) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("fp", pa.int64())])

    def scan(batches):
        for part in slices(batches):
            fps = np.array([fingerprint(t, width) for t in part.column(2).to_pylist()], np.uint64).view(np.int64)
            yield table(schema, [part.column(0), part.column(1), pa.array(fps)])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), "text")
    return picked.mapInArrow(scan, "doc_id long, key binary, fp long")


# --- statistics and plan --------------------------------------------------------------


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, how often bits a and b are both set)"""

    def count(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 1 << 16):
                bits = np.unpackbits(fps[at : at + (1 << 16)].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                total += len(bits)
        values = np.append(both.ravel(), total).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "n"])

    got = distinct.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    values = np.zeros(BITS * BITS + 1, np.int64)
    for r in got:
        values[r["at"]] = r["n"]
    return int(values[-1]), values[:-1].reshape(BITS, BITS)


def group_bits(total: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the bits, grown one at a time by the bit most correlated with them."""
    ones = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    corr = np.abs((both / max(total, 1) - np.outer(ones, ones)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, parts = list(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        part = [max(left, key=lambda b: (round(float(corr[b, left].sum()), 9), -b))]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (round(float(corr[b, part].sum()), 9), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def values_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed low to high."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def histograms(distinct: DataFrame, parts: list[list[int]]) -> list[np.ndarray]:
    def count(batches):
        sums = [np.zeros(1 << len(p), np.int64) for p in parts]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, p in enumerate(parts):
                sums[i] += np.bincount(values_of(fps, p), minlength=1 << len(p))
        for i, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(s[at])], ["part", "value", "n"])

    out = [np.zeros(1 << len(p), np.int64) for p in parts]
    got = distinct.select("fp").mapInArrow(count, "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    for i in range(len(parts)):
        own = got[got["part"] == i]
        out[i][own["value"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
    return out


def neighbours(counts: np.ndarray, t: int) -> np.ndarray:
    """How many fingerprints lie at exactly ``t`` (0 to 2) bits from each value."""
    if t == 0:
        return counts
    at, width = np.arange(len(counts)), len(counts).bit_length() - 1
    one = sum(counts[at ^ (1 << k)] for k in range(width))
    if t == 1:
        return one
    return (sum(one[at ^ (1 << k)] for k in range(width)) - width * counts) // 2


#: Cost of filing a fingerprint under one more key, in comparisons.
KEY_COST = 500.0


def allocate(counts: list[np.ndarray], distance: int) -> list[int]:
    """Thresholds of -1 to 2 that sum to distance - m + 1 at the least estimated cost."""
    m = len(counts)
    cost = []
    for c in counts:
        width, own = len(c).bit_length() - 1, {-1: 0.0}
        for t in range(3):
            keys = [1, width, width * (width - 1) // 2][t]
            pairs = sum(float((c * neighbours(c, j).astype(float)).sum()) * [1, width, width * (width - 1) // 2][t - j if t >= j else 0] for j in range(t + 1))
            own[t] = KEY_COST * keys * float(c.sum()) + pairs / 2
        cost.append(own)
    goal = distance - m + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t, extra in own.items():
                if total + t not in new or c + extra < new[total + t][0]:
                    new[total + t] = (c + extra, [*ts, t])
        best = new
    return best[goal][1]


def partitions_for(total: int, distance: int) -> int:
    """4 or 5 partitions: fewer, wider ones once buckets of random fingerprints cost more than keys."""
    def cost(m):
        width, spare = BITS // m, distance - m + 1
        keys = m + spare * (width - 1)
        return keys * total * (KEY_COST + total / 2 ** (width + 1))
    return min((5, 4), key=cost) if distance == 4 else max(4, distance + 1)


class Plan:
    """Which keys a fingerprint is filed under."""

    def __init__(self, parts, thresholds, hot, distance: int):
        self.parts, self.distance = parts, distance
        self.masks = [[sum(1 << k for k in c) for c in combinations(range(len(p)), t)] if t >= 0 else [] for p, t in zip(parts, thresholds, strict=True)]
        self.thresholds = thresholds
        self.hot = np.asarray(sorted(hot), np.int64)
        self.rest = []
        for p in parts:
            other = [b for b in range(BITS) if b not in p]
            self.rest.append([other[k :: distance + 1] for k in range(distance + 1)])

    @staticmethod
    def key(part: int, mask: int, values):
        return (np.int64(part) << 56) | (np.int64(mask) << 44) | (values << 20)

    def keys(self, fps: np.ndarray):
        """(keys, positions in fps)"""
        keys, at = [], []
        every = np.arange(len(fps))
        for i, p in enumerate(self.parts):
            values = values_of(fps, p) if self.masks[i] else None
            for j, mask in enumerate(self.masks[i]):
                k = self.key(i, j, values & ~np.int64(mask))
                hot = np.isin(k, self.hot) if len(self.hot) else np.zeros(len(k), bool)
                keys.append(k[~hot])
                at.append(every[~hot])
                for s, bits in enumerate(self.rest[i] if hot.any() else []):
                    # split bucket: a sub-key of 3 + 17 bits in the low 20
                    sub = values_of(fps[hot], bits) + (np.int64(s + 1) << 17)
                    keys.append(k[hot] | sub)
                    at.append(every[hot])
        return np.concatenate(keys) if keys else np.zeros(0, np.int64), np.concatenate(at) if at else np.zeros(0, np.int64)


def make_plan(distinct: DataFrame, distance: int = 4, bucket_cap: int = 50_000) -> Plan:
    total, both = bit_counts(distinct)
    parts = group_bits(total, both, partitions_for(total, distance))
    counts = histograms(distinct, parts)
    thresholds = allocate(counts, distance)
    hot = []
    for i, (c, t) in enumerate(zip(counts, thresholds, strict=True)):
        at = np.arange(len(c))
        for j, mask in enumerate(combinations(range(len(parts[i])), t) if t >= 0 else []):
            mask = sum(1 << k for k in mask)
            sums = np.bincount(at & ~mask, weights=c, minlength=len(c))
            hot += Plan.key(i, j, np.flatnonzero(sums > bucket_cap)).tolist()
    return Plan(parts, thresholds, hot, distance)


# --- links ----------------------------------------------------------------------------

#: Buckets up to this size are compared by shifts over whole batches, larger ones from pivots.
SMALL = 96


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def stars(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """A star a component of the links: (least fingerprint, member) rows."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    out = [(root(x), x) for x in parent]
    return [a for a, b in out if a != b], [b for a, b in out if a != b]


def pivot_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect a large bucket's components: each fingerprint in turn takes what
    it reaches of those not yet taken, so a tight group costs one pass or few."""
    left, right = [], []
    free = np.unique(fps)
    while len(free):
        front, free = [free[0]], free[1:]
        while front and len(free):
            p = front.pop()
            hit = near(free, p, distance)
            if hit.any():
                got = free[hit]
                left.append(np.full(len(got), p))
                right.append(got)
                front += list(got)
                free = free[~hit]
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of sorted keys."""
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edges)
    left, right = [], []
    for i in np.flatnonzero(sizes > SMALL):
        a, b = pivot_links(fps[edges[i] : edges[i + 1]], distance)
        left.append(a)
        right.append(b)
    small = np.repeat(sizes <= SMALL, sizes)
    keys, fps = keys[small], fps[small]
    for d in range(1, min(SMALL, len(keys))):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            break
        a, b = fps[same], fps[same + d]
        hit = near(a, b, distance) & (a != b)
        left.append(a[hit])
        right.append(b[hit])
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) rows whose components are those of all links between distinct fingerprints."""
    distance = plan.distance

    def file_under(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                keys, where = plan.keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[where])], ["bucket", "fp"])

    def compare(batches):
        kept_k, kept_f = [], []

        def out(keys, fps):
            a, b = bucket_links(keys, fps.view(np.uint64), distance)
            a, b = stars(a.view(np.int64), b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        # pieces of the last bucket, which may go on in the next batch; joined once it ends
        for batch in batches:
            k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            if cut or kept_k and kept_k[-1][-1] != k[-1]:
                yield out(np.concatenate([*kept_k, k[:cut]]), np.concatenate([*kept_f, f[:cut]]))
                kept_k, kept_f = [], []
            kept_k.append(k[cut:])
            kept_f.append(f[cut:])
        if kept_k:
            yield out(np.concatenate(kept_k), np.concatenate(kept_f))

    filed = distinct.select("fp").mapInArrow(file_under, "bucket long, fp long")
    return filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's least node.

    Large-star links a node's larger neighbours to its least one, small-star its smaller
    ones; the fixed point is a star a component. Neighbour minima are pre-aggregated, and
    nodes with very many neighbours are dealt to several parts of the join.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, ["u"], "n", "v", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["u"], "n", "v", "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "cc")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def groups(docs: DataFrame, width: int = 4, distance: int = 4, bucket_cap: int = 50_000) -> DataFrame:
    """Per document: doc_id, key, fp, component_id (least doc_id of its group), leader.

    ``leader`` is the key of the one row that stands for the group: of the rows with the
    least doc_id, nulls last, that with the least key.
    """
    fps = materialize(fingerprints(docs, width), "simhash-fps")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    distinct = materialize(fps.groupBy("fp").agg(F.min(rank).alias("first"), F.count("*").alias("n")), "simhash-distinct")
    found = components(links(distinct, make_plan(distinct, distance, bucket_cap)))
    found = materialize(found, "simhash-roots")
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("m"))
    named = spread_join(rooted, best, ["root"], "m", "fp", "inner").select("fp", F.col("best.id").alias("component_id"), F.col("best.key").alias("leader"), "n")
    return spread_join(fps, named, ["fp"], "n", "key", "inner").select("doc_id", "key", "fp", "component_id", "leader")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, max_broadcast: int = 1_000_000, **settings) -> DataFrame:
    """``docs`` with one row of each group, its columns unchanged.

    What goes is told by row keys. Up to ``max_broadcast`` of them are broadcast, so texts are
    not shuffled; more are joined by shuffle. Rows that are equal in id and text share a key, so
    one of them is picked."""
    found = materialize(groups(docs, **settings).groupBy("key").agg(F.count("*").alias("n"), F.first("leader").alias("leader")).where("n > 1 or not (key <=> leader)"), "simhash-gone")
    few = found.count() <= max_broadcast
    gone = found.select(F.col("key").alias("__key"))
    equal = found.where("key <=> leader").select(F.col("key").alias("__key"))
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    rest = keyed.join(F.broadcast(gone) if few else gone, "__key", "left_anti")
    picked = keyed.join(F.broadcast(equal) if few else equal, "__key", "left_semi").dropDuplicates(["__key"])
    return rest.select(*docs.columns).unionByName(picked.select(*docs.columns))
