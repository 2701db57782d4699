"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are word counts. Each source's target is its share by weight of all words, never
over ``max_epochs`` times its size; what a stopped source leaves is shared again by weight
until none is above. Blocks of ``block_words`` words are dealt to sources by highest quotients
target / (2k + 1), as many as all targets hold, and each source's blocks in the same way to its shards by
their sizes. A shard orders its documents by a seeded hash and cuts that stream of words into blocks; a
quota beyond the shard's own blocks is whole passes over it, and the rest is drawn from
its blocks: evenly spaced along the stream from a seeded start, so any place in the stream tells by
arithmetic whether its block is drawn, and no table of blocks is needed. A document's words are
those of its that lie in drawn blocks, beside the passes.

A source whose target is under ``exact_blocks`` blocks, of which half a block would be a
noticeable share, is settled in words: its quota is its target to the word, dealt to shards alike, and one
more block of a shard, or what its last words leave of one, is taken in part.

Shards are hashed, so a source holding a third of all rows is spread over many. Their
number follows the words, up to ``max_shards`` in all and one a source, and the table of their quotas has a row
each. The table of sources is the mix's recipe; more than ``max_sources`` of them are refused by an error.

Edge cases: a null text has size 0 and is never taken. A null source is a source, last in
order. Repeated rows are documents of their own, held as one row and its count until the end.
No words at all: targets are 0. Reruns agree, as all choices follow from the seed and the
rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, row_key, slices


def targets(sizes: list[int], weights: list[float], max_epochs: float = 3.0) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, none above ``max_epochs`` times its size."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    stopped: set[int] = set()
    while len(stopped) < len(sizes):
        rest = total - sum(out[i] for i in stopped)
        weight = sum(weights[i] for i in range(len(sizes)) if i not in stopped)
        for i in range(len(sizes)):
            if i not in stopped:
                out[i] = rest * weights[i] / weight
        above = [i for i in range(len(sizes)) if i not in stopped and out[i] > max_epochs * sizes[i]]
        if not above:
            break
        for i in above:
            out[i] = float(max_epochs * sizes[i])
        stopped.update(above)
    return out


def sainte_lague(votes, seats: int, caps=None) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1); ties go to the earlier party, no party passes its cap.

    Starts from a share that every party surely gets, so the heap deals only about one seat a party.
    """
    votes = np.asarray(votes, float)
    caps = np.full(len(votes), np.iinfo(np.int64).max) if caps is None else np.asarray(caps, np.int64)
    out = np.zeros(len(votes), np.int64)
    if seats <= 0 or not len(votes) or votes.sum() <= 0:
        return out
    # with divisor d party i holds round(votes / d) seats; a larger d than the final one deals too few
    d = votes.sum() / seats
    while (start := np.minimum(np.floor(votes / d + 0.5).astype(np.int64), caps)).sum() > seats:
        d *= 1 + max(1e-12, (start.sum() - seats) / seats)
    out, left = start, seats - int(start.sum())
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, out.tolist(), strict=True)) if v > 0 and k < caps[i]]
    heapq.heapify(heap)
    while left and heap:
        _, i = heapq.heappop(heap)
        out[i] += 1
        left -= 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * int(out[i]) + 1), i))
    return out


def quotas(goal: list[float], held: list[list[int]], block: int, max_epochs: int, exact_blocks: int = 64) -> list[list[tuple[int, int, int]]]:
    """(passes, blocks, words) to take from each shard of each source, whose words are ``held``: passes over all of it, blocks drawn
    beside them, and words of one more block, which only sources settled in words have."""
    seats = sainte_lague(goal, int(sum(goal)) // block)
    out = []
    for target, blocks, own in zip(goal, seats.tolist(), held, strict=True):
        exact = target < exact_blocks * block
        unit = 1 if exact else block
        caps = [max_epochs * s // unit for s in own]
        dealt = sainte_lague(own, min(round(target) if exact else blocks, sum(caps)), caps)
        mine = []
        for n, size in zip(dealt.tolist(), own, strict=True):
            passes, rest = divmod(n * unit, size) if size else (0, 0)
            mine.append((passes, rest // block, rest % block if exact else 0))
        out.append(mine)
    return out


# --- drawn blocks of a shard ----------------------------------------------------------


def first_left(blocks: int, drawn: int, start: int) -> int:
    """The first of ``blocks`` whole blocks that is not drawn; the one after them if all are."""
    if drawn == 0 or drawn == blocks:
        return 0 if drawn < blocks else blocks
    return next(k for k in range(blocks) if not is_drawn(k, blocks, drawn, start))


def is_drawn(k: int, blocks: int, drawn: int, start: int) -> bool:
    return k < blocks and (k + 1 + start) * drawn // blocks > (k + start) * drawn // blocks


def drawn_before(at: Column, block: int) -> Column:
    """Words of the stream before place ``at`` that are in drawn blocks, of a row that knows its shard's
    ``blocks``, ``drawn``, ``start``, ``left`` (the block taken in part) and ``words`` (of it)."""
    k = F.least(F.floor(at / block), F.col("blocks"))
    div = lambda a: F.when(F.col("blocks") > 0, F.call_function("div", a * F.col("drawn"), F.col("blocks"))).otherwise(F.lit(0).cast("long"))
    upto = div(k + F.col("start"))
    within = F.when((k < F.col("blocks")) & (div(k + 1 + F.col("start")) > upto), at - k * block).otherwise(F.lit(0))
    part = F.least(F.col("words"), F.greatest(at - F.col("left") * block, F.lit(0)))
    return ((upto - div(F.col("start"))) * block + within + part).cast("long")


def drawn_runs(begin: int, size: int, block: int, blocks: int, drawn: int, start: int, left: int, words: int) -> list[tuple[int, int]]:
    """The runs of words, counted in a document that begins at a place of the stream, that lie in drawn blocks."""
    out: list[tuple[int, int]] = []
    for k in range(begin // block, -(-(begin + size) // block)):
        a, b = k * block, (k + 1) * block if is_drawn(k, blocks, drawn, start) else k * block + (words if k == left else 0)
        a, b = max(a - begin, 0), min(b - begin, size)
        if a < b:
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


# --- the mix --------------------------------------------------------------------------


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key, source, size and number of equal rows of each document, in the shared folder."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "source", "text").alias("key"), F.col("source").cast("string").alias("source"), size.alias("size"))
    return materialize(picked.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("copies")), "mix-sizes")


def _host():
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))


def placed(rows: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: int = 42, block_words: int = 4_096, exact_blocks: int = 64, shard_words: int = 1_000_000, max_shards: int = 65_536, max_sources: int = 100_000) -> DataFrame:
    """``rows`` (see ``sized``) with source_size, target, the place ``begin`` in the shard's stream, and the shard's
    passes, blocks, drawn, start, left and words."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources: raise max_sources or mix coarser sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in found]
    total = sum(sizes)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], max_epochs)
    per_shard = max(shard_words, -(-total // max_shards))
    shards = [max(1, -(-s // per_shard)) for s in sizes]
    facts = [("~" if r.source is None else "=" + r.source, s, float(g), n) for r, s, g, n in zip(found, sizes, goal, shards, strict=True)]
    # at most max_sources rows
    sources = F.broadcast(spark.createDataFrame(facts, "host string, source_size long, target double, shards long"))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key")), F.col("shards"))
    dealt = rows.withColumn("host", _host()).join(sources, "host").withColumns({"shard": shard, "order": F.xxhash64(F.lit(seed), F.col("key")), "__words": F.col("size") * F.col("copies")}).drop("shards")
    held: dict[str, list] = {f[0]: [] for f in facts}
    for r in dealt.groupBy("host", "shard").agg(F.sum("__words").alias("size")).collect():  # at most max_shards rows and one a source
        held[r.host].append((r.shard, int(r["size"])))
    own = [sorted(held[f[0]]) for f in facts]
    plan = []
    for (host, *_), mine, took in zip(facts, own, quotas(goal, [[s for _, s in x] for x in own], block_words, max_epochs, exact_blocks), strict=True):
        for (k, size), (passes, drawn, words) in zip(mine, took, strict=True):
            blocks = size // block_words
            start = xxhash.xxh64_intdigest(f"{seed}:{host}:{k}") % blocks if blocks else 0
            plan.append((host, k, passes, blocks, drawn, start, first_left(blocks, drawn, start) if words else 0, words))
    quota = F.broadcast(spark.createDataFrame(plan, "host string, shard long, passes long, blocks long, drawn long, start long, left long, words long"))
    stream = Window.partitionBy("host", "shard").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("begin", F.coalesce(F.sum("__words").over(stream), F.lit(0)).cast("long")).join(quota, ["host", "shard"]).drop("host", "shard", "order", "__words")


def _block(settings: dict) -> int:
    return settings.get("block_words", 4_096)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, key, size, source_size, target (its source's), taken (words, repeats counted)."""
    each = placed(sized(docs), **settings).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    begin, block = F.col("begin") + F.col("copy") * F.col("size"), _block(settings)
    taken = F.col("passes") * F.col("size") + drawn_before(begin + F.col("size"), block) - drawn_before(begin, block)
    return each.select("doc_id", "key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def words_of(text: str, runs: list[tuple[int, int]]) -> list[str]:
    """The parts of ``text`` that hold the words of each run, with what stands before its first and after its last word."""
    if not runs:
        return []
    ends = [0, *(m.end() for m in re.finditer(WORD_PATTERN, text))]
    return [text[ends[a] if a else 0 : ends[b] if b + 1 < len(ends) else len(text)].strip(" \t\n\x0b\f\r") if a else text[: ends[b] if b + 1 < len(ends) else len(text)] for a, b in runs]


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: a row for each whole pass over a document, and one for each run of its
    words in drawn blocks. Columns are those of ``docs``; ``n_chars``, if there is one, follows a cut.

    Texts meet their places in the streams by key. Of repeated rows one is kept, which stands for the words that all
    of them take: whole texts, and one cut short; many such are dealt to tasks in portions."""
    block = _block(settings)
    facts = placed(sized(docs), **settings)
    both = drawn_before(F.col("begin") + F.col("copies") * F.col("size"), block) - drawn_before(F.col("begin"), block)
    facts = facts.withColumn("extra", both).withColumn("every", F.col("passes") * F.col("size") * F.col("copies") + F.col("extra"))
    facts = materialize(facts.where(F.col("every") > 0).select("key", "copies", *_PLACE), "mix-places")
    cells = docs.select(F.struct("*").alias("__doc"), row_key("doc_id", "source", "text").alias("key"))
    names = [f"__{c}" for c in _PLACE]
    plain = [F.col(c).alias(n) for c, n in zip(_PLACE, names, strict=True)]
    # keys of very many rows, at most rows / _HOT of them, are brought to one row before any shuffle
    hot = F.broadcast(facts.where(F.col("copies") > _HOT).select("key"))
    met = cells.join(hot, "key", "left_anti").join(facts, "key")
    single = met.where("copies = 1").select("__doc.*", *plain)
    # a group of equal rows: whole texts in portions, then the rest
    several = facts.where("copies > 1")
    one = met.where("copies > 1").select("__doc", "key").unionByName(cells.join(hot, "key", "left_semi").select("__doc", "key")).dropDuplicates(["key"])
    portion = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("every") / F.col("size") / _PORTION)))
    shares = several.withColumn("__n", portion).withColumn("every", F.least(F.col("every") - F.col("__n") * _PORTION * F.col("size"), _PORTION * F.col("size"))).where(F.col("every") > 0)
    spread = one.join(shares, "key").repartition("key", "__n").select("__doc.*", *[F.lit(-1).cast("long").alias(n) if c == "begin" else F.col(c).alias(n) for c, n in zip(_PLACE, names, strict=True)])
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def passes(batches):
        for part in slices(batches):
            index, texts = [], []
            columns = [part.column(part.num_columns - len(_PLACE) + k).to_pylist() for k in range(len(_PLACE))]
            for i, (text, begin, size, whole, every, blocks, drawn, start, left, words) in enumerate(zip(part.column(at).to_pylist(), *columns, strict=True)):
                if begin < 0:
                    got = [text] * (every // size) + words_of(text, [(0, every % size)] if every % size else [])
                else:
                    got = [text] * whole + words_of(text, drawn_runs(begin, size, block, blocks, drawn, start, left, words))
                index += [i] * len(got)
                texts += got
            out = part.take(pa.array(index, pa.int64())).select(range(part.num_columns - len(_PLACE)))
            out = out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))
            if chars is not None:
                out = out.set_column(chars, out.schema.field(chars), pa.array([len(t) for t in texts]).cast(out.schema.field(chars).type))
            yield out

    return single.unionByName(spread).mapInArrow(passes, docs.schema)


#: What a row must know to be cut, in the order that tasks read it.
_PLACE = ("begin", "size", "passes", "every", "blocks", "drawn", "start", "left", "words")
#: Rows beyond which equal rows are told from others before the join.
_HOT = 100_000
#: Whole texts of one group of equal rows that one row stands for.
_PORTION = 256
