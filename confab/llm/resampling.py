"""Importance resampling towards a target distribution.

Features are runs of 1 to ``max_n`` consecutive words, hashed into ``buckets`` counters. What a
bucket's share of the target gains over its share of the corpus, in thousandths of a natural logarithm, is
an array; a document's weight is the mean gain of its features, floored, and its score adds seeded
Gumbel noise, so the documents of highest score are a draw without replacement by weight.

Each partition writes its eligible rows, sorted by score, as runs of fixed-size records in the shared
folder. Tournament trees of losers merge runs, ``fan_in`` at a time and reading a block of each, into
longer ones until at most ``fan_in`` are left; those are merged by ranges of scores, a task a range, which
finds its start in each run by bisection. A histogram of scores, whose number of values the
arithmetic bounds, gives the ranges, the rank that each begins with, and the lowest score drawn: every
merge stops there, or after the exact draw count. Files count only once the manifest that Spark commits lists
them. Nothing is joined back: a row is drawn or not by its place in the order.

Scores are whole numbers of at most about 1e5 either way, ties go to the smaller doc_id, so what reaches
the driver is the counters (``buckets``), the histogram and one row, the last drawn.

Edge cases: a null text has no words: weight 0, not eligible. A null doc_id hashes as an empty number
and comes after others in ties. Repeated rows are documents of their own; in a run they are one
record with a count, and rows that nothing tells apart share the last ranks in any order. An
empty target or corpus leaves counts of 0. Fewer documents than a draw of one: no ranks. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl_schema, materialize, new_path, slices, table
from .decontaminate import normal_words

# --- features and weights -------------------------------------------------------------


class _Known(dict):
    """What a word is worth, computed at its first use; a worker's memory for words is bounded."""

    MOST = 1_000_000

    def __init__(self, of):
        self.of = of

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = self.of(word)
        return value


def runs_of(words: list[bytes], max_n: int) -> Iterator[bytes]:
    """All runs of 1 to ``max_n`` consecutive words, joined by a space."""
    for n in range(1, max_n + 1):
        yield from words if n == 1 else (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))


def feature_counts(texts: DataFrame, max_n: int = 1, buckets: int = 10_000) -> list[int]:
    """Features of all texts in each bucket, added up by task and then by Spark."""
    schema = ddl_schema("bucket long,n long")

    def count(batches):
        held, known = np.zeros(buckets, np.int64), _Known(lambda f: zlib.crc32(f) % buckets)
        for part in slices(batches):
            found = [known[f] for t in part.column(0).to_pylist() for f in runs_of(normal_words(t), max_n)]
            held += np.bincount(np.array(found, np.int64), minlength=buckets)
        at = np.flatnonzero(held)
        yield table(schema, [at, held[at]])

    out = [0] * buckets
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = int(r.n)
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of a natural logarithm that a bucket's share of the target gains, each count smoothed by one."""
    s_all, t_all, size = float(sum(corpus)), float(sum(target)), len(corpus)
    return [math.floor(1000 * math.log(((t + 1.0) * (s_all + size)) / ((s + 1.0) * (t_all + size)))) for s, t in zip(corpus, target, strict=True)]


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], max_n: int = 1, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, eligible."""
    ddl = "doc_id long,n_features long,weight long,score long,eligible boolean"
    schema, size = ddl_schema(ddl), len(gain)

    def score(batches):
        known = _Known(lambda f: gain[zlib.crc32(f) % size])
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = normal_words(text)
                worth = np.fromiter((known[f] for f in runs_of(words, max_n)), np.int64)
                weight = int(worth.sum()) // len(worth) if len(worth) else 0
                rows.append((doc, len(worth), weight, weight + noise(doc, seed), len(words) >= least_words))
            yield table(schema, zip(*rows, strict=True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, ddl)


# --- runs and their merges ------------------------------------------------------------

#: A record of a run. Runs are sorted by score, falling, then by the rest, rising.
RECORD = np.dtype([("score", "<i8"), ("no_id", "<i8"), ("doc_id", "<i8"), ("n_features", "<i8"), ("weight", "<i8"), ("copies", "<i8")])
_BLOCK = 1024


def sorted_run(doc_id, no_id, n_features, weight, score) -> np.ndarray:
    """Records of the rows in order, equal rows as one."""
    rows = np.empty(len(score), RECORD)
    for name, values in (("score", score), ("no_id", no_id), ("doc_id", doc_id), ("n_features", n_features), ("weight", weight)):
        rows[name] = values
    rows["copies"] = 1
    rows = rows[np.lexsort((rows["weight"], rows["n_features"], rows["doc_id"], rows["no_id"], -rows["score"]))]
    keys = rows[list(RECORD.names[:-1])]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(rows)])
    out = rows[first]
    out["copies"] = np.diff(first, append=len(rows))
    return out


class Cursor:
    """A place in a run, from the first record of a score of ``highest`` or less."""

    END = (math.inf,)

    def __init__(self, store, path: str, highest: int | None = None):
        self.file = store.open_input_file(path)
        self.left = self.file.size() // RECORD.itemsize
        if highest is not None:
            lo, hi = 0, self.left
            while lo < hi:
                mid = (lo + hi) // 2
                if self._records(mid, 1)[0]["score"] > highest:
                    lo = mid + 1
                else:
                    hi = mid
            self.left -= lo
            self.file.seek(lo * RECORD.itemsize)
        self.block: Iterator = iter(())
        self.advance()

    def _records(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at * RECORD.itemsize)
        return np.frombuffer(self.file.read(n * RECORD.itemsize), RECORD)

    def advance(self) -> None:
        """To the next record: ``key`` orders it, ``copies`` is its count."""
        row = next(self.block, None)
        if row is None and self.left:
            n = min(_BLOCK, self.left)
            self.left -= n
            self.block = iter(np.frombuffer(self.file.read(n * RECORD.itemsize), RECORD).tolist())
            row = next(self.block)
        if row is None:
            self.file.close()
            self.key, self.copies = self.END, 0
        else:
            self.key, self.copies = (-row[0], *row[1:5]), row[5]


def tournament(cursors: list[Cursor]) -> Iterator[tuple[tuple, int]]:
    """(key, copies) of all records in order. Inner nodes keep the loser of their match, so that
    what follows the winner replays only the matches on its way to the top."""
    n = len(cursors)
    losers: list[int | None] = [None] * n
    winner = 0
    for leaf in range(n):
        player, node = leaf, (leaf + n) // 2
        while node:
            other = losers[node]
            if other is None:
                losers[node] = player
                break
            if cursors[other].key < cursors[player].key:
                losers[node], player = player, other
            node //= 2
        else:
            winner = player
    while n and (top := cursors[winner]).key is not Cursor.END:
        yield top.key, top.copies
        top.advance()
        node = (winner + n) // 2
        while node:
            other = losers[node]
            if cursors[other].key < cursors[winner].key:
                losers[node], winner = winner, other
            node //= 2


def _folder(path: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    return store, root


def write_runs(rows: DataFrame, path: str, run_rows: int) -> DataFrame:
    """The manifest (file) of the sorted runs of ``rows``: one or more of each partition."""
    schema = ddl_schema("file string")

    def write(batches):
        store, root = _folder(path)
        held, size = [], 0

        def flush():
            doc, null, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
            name = f"0-{uuid.uuid4().hex}.run"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(sorted_run(doc, null, *rest).tobytes())
            return table(schema, [[name]])

        for batch in batches:
            doc = batch.column(0)
            held.append([doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), *(batch.column(k).to_numpy() for k in (1, 2, 3))])
            size += batch.num_rows
            if size >= run_rows:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return materialize(rows.select("doc_id", "n_features", "weight", "score").mapInArrow(write, "file string"), "resample-runs")


def merge_level(runs: DataFrame, path: str, fan_in: int, count: int, lowest: int) -> DataFrame:
    """The manifest of longer runs, each merged from about ``fan_in``, without what cannot be drawn."""
    schema = ddl_schema("file string")
    groups = -(-runs.count() // fan_in)
    dealt = runs.groupBy(F.pmod(F.xxhash64("file"), F.lit(groups)).alias("g")).agg(F.collect_list("file").alias("files"))

    def merge(batches):
        store, root = _folder(path)
        for batch in batches:
            for files in batch.column(0).to_pylist():
                name, left, block = f"1-{uuid.uuid4().hex}.run", count, []
                with store.open_output_stream(f"{root}/{name}") as out:
                    for key, copies in tournament([Cursor(store, f"{root}/{f}") for f in files]):
                        if left <= 0 or -key[0] < lowest:
                            break
                        left -= copies
                        block.append((-key[0], *key[1:], copies))
                        if len(block) == _BLOCK:
                            out.write(np.array(block, RECORD).tobytes())
                            block = []
                    out.write(np.array(block, RECORD).tobytes())
                yield table(schema, [[name]])

    return materialize(dealt.select("files").repartition(min(groups, 10_000)).mapInArrow(merge, "file string"), "resample-runs")


def ranges(histogram: list[tuple[int, int]], count: int, size: int) -> list[tuple[int, int, int, int]]:
    """(highest, lowest score, ranks before, ranks to give) of consecutive ranges of about ``size`` rows
    or one score, to ``count`` rows in all. ``histogram`` has the rows of each score, highest first."""
    out, at, before, held = [], 0, 0, 0
    for k, (score, n) in enumerate(histogram):
        held += n
        if held >= size or before + held >= count or k == len(histogram) - 1:
            out.append((histogram[at][0], score, before, min(held, count - before)))
            at, before, held = k + 1, before + held, 0
        if before >= count:
            break
    return out


def merge_ranges(spark: SparkSession, path: str, files: list[str], parts: list[tuple[int, int, int, int]]) -> DataFrame:
    """The drawn rows: doc_id, n_features, weight, score, and the first of their ``copies`` ranks."""
    ddl = "doc_id long,n_features long,weight long,score long,rank long,copies long"
    schema = ddl_schema(ddl)

    def merge(batches):
        store, root = _folder(path)
        for batch in batches:
            for highest, lowest, before, give in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows, rank, last = [], before + 1, before + give
                for (low, no_id, doc, n, weight), copies in tournament([Cursor(store, f"{root}/{f}", highest) for f in files]):
                    if rank > last or -low < lowest:
                        break
                    take = min(copies, last + 1 - rank)
                    rows.append((None if no_id else doc, n, weight, -low, rank, take))
                    rank += take
                    if len(rows) == 8 * _BLOCK:
                        yield table(schema, zip(*rows, strict=True))
                        rows = []
                if rows:
                    yield table(schema, zip(*rows, strict=True))

    asked = spark.createDataFrame(parts, "highest long, lowest long, before long, give long")
    return materialize(asked.repartition(min(len(parts), 10_000)).mapInArrow(merge, ddl), "resample-drawn")


# --- operators ------------------------------------------------------------------------


def draw(rows: DataFrame, percent: int = 10, run_rows: int = 1_000_000, fan_in: int = 128, range_rows: int = 1_000_000) -> DataFrame:
    """``rows`` (see ``scored``, read several times) with the rank of those drawn: the ``percent`` of
    eligible rows with the highest scores, ties to the smaller doc_id."""
    spark, names = rows.sparkSession, ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    fit = rows.where("eligible")
    histogram = sorted(((r.score, int(r.n)) for r in fit.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    count = percent * sum(n for _, n in histogram) // 100
    if not count:
        return rows.select(*names, none)
    parts, path = ranges(histogram, count, range_rows), new_path(spark, "resample")
    runs = write_runs(fit, path, run_rows)
    while runs.count() > fan_in:
        runs = merge_level(runs, path, fan_in, count, parts[-1][1])
    drawn = merge_ranges(spark, path, [r.file for r in runs.collect()], parts)
    last = drawn.where(F.col("rank") + F.col("copies") > count).select(*names).first()
    here = F.struct(-F.col("score"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "n_features", "weight")
    at = [F.lit(x).cast("long") for x in (-last.score, last.doc_id or 0, last.n_features, last.weight)]
    cut = F.struct(at[0], F.lit(last.doc_id is None), *at[1:])
    equal = fit.where(here == cut).count() - drawn.where(here == cut).agg(F.sum("copies")).first()[0]
    rest = rows.where(~F.col("eligible") | (here > cut)).select(*names, none)
    tied = spark.range(equal).select(*(F.lit(last[n]).cast("long").alias(n) for n in names), none)
    ranked = drawn.withColumn("rank", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("copies") - 1))).select(*names, "rank")
    return ranked.unionByName(rest).unionByName(tied)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, max_n: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, **merging) -> DataFrame:
    """Per document of ``docs``: doc_id, n_features, weight, score, rank (null if not drawn)."""
    gain = gains(feature_counts(docs, max_n, buckets), feature_counts(target, max_n, buckets))
    return draw(materialize(scored(docs, gain, max_n, least_words, seed), "resample-scores"), percent, **merging)
