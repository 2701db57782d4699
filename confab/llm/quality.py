"""Quality rules: text statistics and cross-document line frequency.

Base rules read one document at a time. The method then looks across documents: every
line with a word is normalised (lower case, digits as 0, words one space apart) and
hashed; per host (the ``source`` column) the documents holding a line are counted, and
lines above the limits are host boilerplate and removed. A document of which less than
``min_kept_share`` of the words is left without such lines is depleted and rejected.

Copies must not make a text look like boilerplate, so documents are counted by identity,
the hash of all of a document's lines: copies share it, and no shared passage decides it.
A line is above the limits if its identities number at least ``min_docs`` and at least
``min_share`` of the host's documents, however many copies hold it as well. Lines above
the limits are counted a second time, as near copies differ in a line: documents with no
more than ``copy_share`` of their words outside such lines are one if they hold the same
of them. Near copies that differ in more than that count as documents of their own.

Counts are grouped twice, both times pre-aggregated before the shuffle, so a line that a
third of all documents hold costs each task one row an identity. Lines above the limits are
broadcast only if they number at most ``max_broadcast``; otherwise they are joined by
shuffle. With the broadcast, ``keep_good`` judges and cuts each document where it is read:
only hashes of lines are shuffled, no texts.

Edge cases: null texts have no words and fail the base rules. A null source is a host of
its own. Repeated rows and null or repeated ids each get their own row. Empty tables give
empty results. Other columns are not read, and ``keep_good`` passes them on.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, slices, table

_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
WINDOW = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs twice or more."""
    n = len(words)
    if n <= window:
        return 0
    joined = b" ".join(words)
    starts, ends, p = [], [], 0
    for w in words:
        starts.append(p)
        p += len(w)
        ends.append(p)
        p += 1
    windows = [joined[a:b] for a, b in zip(starts, ends[window - 1 :])]
    if len(set(windows)) == len(windows):
        return 0
    first: dict[bytes, int] = {}
    hit = bytearray(n)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i : i + window] = b"\x01" * window
            if not all(hit[j : j + window]):
                hit[j : j + window] = b"\x01" * window
    return sum(hit)


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    words = text.encode("utf-8").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _SPACE.sub("", line):
            seen.add(line)
    spaces = sum(map(len, _SPACE.findall(text)))
    return len(words), len(text) - spaces, sum(map(len, _SYMBOLS.findall(text))), dup, repeated_words(words)


def line_hashes(text: str) -> list[tuple[int, int]]:
    """(hash, words) of each distinct normalised line with a word."""
    words: dict[int, int] = {}
    for line in text.encode("utf-8").lower().translate(_DIGITS).split(b"\n"):
        parts = line.split()
        if parts:
            h = xxhash.xxh64_intdigest(b" ".join(parts)) - (1 << 63)
            words[h] = words.get(h, 0) + len(parts)
    return list(words.items())


def identity(lines: list[tuple[int, int]]) -> int:
    """A hash of the set of all lines."""
    return xxhash.xxh64_intdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in sorted(h for h, _ in lines))) - (1 << 63)


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, the base statistics, the identity and the lines of each document, and a uid of its row."""
    line = pa.struct([("h", pa.int64()), ("words", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("key", pa.binary())] + [(c.split()[0], pa.int64()) for c in STATS.split(", ")] + [("ident", pa.int64()), ("lines", pa.list_(line))])

    def scan(batches):
        for part in slices(batches):
            rows = []
            for doc, source, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                lines = line_hashes(text or "")
                rows.append((doc, source, key, *text_stats(text or ""), identity(lines), [{"h": h, "words": n} for h, n in lines]))
            yield table(schema, zip(*rows, strict=True))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_key("doc_id", "source", "text").alias("key"), "text")
    stats = picked.mapInArrow(scan, f"doc_id long, source string, key binary, {STATS}, ident long, lines array<struct<h:bigint,words:bigint>>")
    return materialize(stats.withColumn("uid", F.monotonically_increasing_id()), "quality-stats")


def _held(lines: DataFrame, limits: DataFrame, max_broadcast: int) -> DataFrame:
    few = limits.count() <= max_broadcast
    return lines.join(F.broadcast(limits) if few else limits, ["host", "h"])


def line_limits(stats: DataFrame, min_docs: int = 10, min_share: float = 0.001, copy_share: float = 0.05, max_broadcast: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(host, h) of the lines above the limits, and the documents' lines (uid, key, host, h, words) that may be."""
    hosts = stats.groupBy(_host()).agg(F.count("*").alias("host_docs"))

    def above(lines: DataFrame) -> DataFrame:
        counted = lines.groupBy("host", "h", "ident").count().groupBy("host", "h").agg(F.count("*").alias("docs"))
        # only lines that pass the fixed limit meet the small table of hosts
        return materialize(counted.where(F.col("docs") >= min_docs).join(hosts, "host").where(F.col("docs") >= min_share * F.col("host_docs")).select("host", "h"), "quality-lines")

    lines = stats.select("uid", "key", _host(), "n_words", "ident", F.explode("lines").alias("line")).select("uid", "key", "host", "n_words", "ident", "line.*")
    some = materialize(_held(lines, above(lines), max_broadcast), "quality-held")
    # near copies: little but such lines, so what they hold of these is their identity
    own = some.groupBy("uid").agg(F.sum("words").alias("held"), F.bit_xor(F.xxhash64("h")).alias("same"))
    near = F.col("n_words") - F.col("held") <= copy_share * F.col("n_words")
    again = some.join(own, "uid").withColumn("ident", F.when(near, F.col("same")).otherwise(F.col("ident")))
    return above(again), some


def frequent_lines(stats: DataFrame, max_broadcast: int = 200_000, **limits) -> DataFrame:
    """(uid, key, h, words) of each document's lines above the limits."""
    above, some = line_limits(stats, max_broadcast=max_broadcast, **limits)
    return _held(some, above, max_broadcast).select("uid", "key", "h", "words")


def _host():
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("host")


def _judged(stats: DataFrame, frequent: DataFrame, min_words: int, max_repeat_percent: int, min_kept_share: float) -> DataFrame:
    removed = frequent.groupBy("uid").agg(F.sum("words").alias("n_frequent_words"))
    names = [c.split()[0] for c in STATS.split(", ")]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = stats.drop("lines", "source", "ident").join(removed, "uid", "left").withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0).cast("long")))
    depleted = F.col("n_words") - F.col("n_frequent_words") < min_kept_share * F.col("n_words")
    return out.select("doc_id", "key", *names, failed.alias("base_failed"), "n_frequent_words", (~failed & ~depleted).alias("kept"))


def judged(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, min_kept_share: float = 0.3, max_broadcast: int = 200_000, **limits) -> DataFrame:
    """Per document: doc_id, key, the statistics, base_failed, n_frequent_words, kept."""
    stats = document_stats(docs)
    return _judged(stats, frequent_lines(stats, max_broadcast=max_broadcast, **limits), min_words, max_repeat_percent, min_kept_share)


def without_lines(text: str, cuts) -> str:
    return "\n".join(line for line in text.split("\n") if not any(h in cuts for h, _ in line_hashes(line)))


def _with_text(part: pa.RecordBatch, names: list[str], texts: list) -> pa.RecordBatch:
    """The batch with other texts; ``n_chars``, if there is one, follows where a text changed."""
    at = names.index("text")
    if "n_chars" in names:
        k = names.index("n_chars")
        old = zip(part.column(at).to_pylist(), part.column(k).to_pylist(), texts, strict=True)
        counts = pa.array([n if t == new else len(new) for t, n, new in old]).cast(part.schema.field(k).type)
        part = part.set_column(k, part.schema.field(k), counts)
    return part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))


def keep_good(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, min_kept_share: float = 0.3, max_broadcast: int = 200_000, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without the lines above the limits; columns as in ``docs``."""
    stats = document_stats(docs)
    above, some = line_limits(stats, max_broadcast=max_broadcast, **limits)
    names = docs.columns
    if above.count() > max_broadcast:
        verdicts = _judged(stats, _held(some, above, max_broadcast), min_words, max_repeat_percent, min_kept_share).where("kept").select(F.col("key").alias("__key"), "n_frequent_words").distinct()
        cuts = _held(some, above, max_broadcast).groupBy(F.col("key").alias("__key")).agg(F.collect_set("h").alias("__cut"))
        keyed = docs.withColumn("__key", row_key("doc_id", "source", "text"))
        both = keyed.join(verdicts, "__key", "left_semi").join(cuts, "__key", "left").select(*names, "__cut")

        def cut(batches):
            for part in slices(batches):
                given = zip(part.column(names.index("text")).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)
                texts = [without_lines(t, set(c)) if t and c else t for t, c in given]
                yield _with_text(part.select(range(len(names))), names, texts)

        return both.mapInArrow(cut, docs.schema)
    # at most max_broadcast lines
    held: dict[str, set[int]] = {}
    for r in above.collect():
        held.setdefault(r.host, set()).add(r.h)
    known = docs.sparkSession.sparkContext.broadcast(held)

    def judge(batches):
        for part in slices(batches):
            keep, texts = [], []
            for text, source in zip(*(part.column(names.index(c)).to_pylist() for c in ("text", "source")), strict=True):
                words = (text or "").encode("utf-8").split()
                good = len(words) >= min_words and 100 * repeated_words(words) <= max_repeat_percent * len(words)
                cuts = known.value.get("-" if source is None else f"={source}") if good else None
                lost = sum(n for h, n in line_hashes(text) if h in cuts) if cuts else 0
                keep.append(good and len(words) - lost >= min_kept_share * len(words))
                texts.append(without_lines(text, cuts) if lost else text)
            yield _with_text(part, names, texts).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def without_frequent_lines(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with the lines above the limits cut from ``text``, all rows kept."""
    return keep_good(docs, min_words=0, max_repeat_percent=100, min_kept_share=0.0, **limits)
