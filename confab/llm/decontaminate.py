"""Benchmark decontamination by a hash set of normalised test n-grams.

Normalisation lower-cases A-Z and keeps words of ASCII letters and digits and of
characters beyond ASCII. A benchmark item gives every window of ``n`` consecutive
words; an item with fewer words, but not none, gives one window of all of them.
Tasks scan the words of each document against the set: runs of words that all
occur in the benchmark are found first, only windows inside them are looked up,
and a lookup compares the whole window, so a hash collision never counts as a hit.

The set is broadcast in slices of at most about ``max_windows`` windows. A benchmark that
fits is scanned in one pass; a larger one takes one scan of the documents a slice, one after
another: a slice's hits are written and its set is dropped everywhere before the next is
read, so driver and workers hold one slice at a time, and no hit is lost. A worker builds
its set once, not once a task.

Edge cases: null or wordless texts have no words, no hits and are clean. Null items
have no windows. Repeated items count once, by id; a null item id is the text
``null``. Repeated documents each get their own row. Empty tables give empty
results. Other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_schema, materialize, row_key, slices, table

#: Byte table that lower-cases A-Z and turns every ASCII character outside 0-9A-Za-z into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


class WindowSet:
    """Windows of benchmark items: window bytes -> ids of the items that hold it."""

    def __init__(self, rows, n: int):
        self.windows: dict[bytes, set[str]] = {}
        self.lengths: set[int] = set()
        self.vocabulary: set[bytes] = set()
        for item, window in rows:
            words = window.split(b" ")
            self.windows.setdefault(window, set()).add(item)
            self.lengths.add(len(words))
            self.vocabulary.update(words)
        self.lengths_sorted = sorted(self.lengths)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word intervals (end exclusive, merged, in order) and the items found."""
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        known = self.vocabulary
        at, total = 0, len(words)
        if not self.lengths_sorted or total < self.lengths_sorted[0]:
            return hits, items
        flags = [w in known for w in words]
        while at < total:
            try:
                at = flags.index(True, at)
            except ValueError:
                break
            try:
                end = flags.index(False, at)
            except ValueError:
                end = total
            if end - at >= self.lengths_sorted[0]:
                self._run(words[at:end], at, hits, items)
            at = end
        return merged(hits), items

    def _run(self, run: list[bytes], offset: int, hits: list, items: set) -> None:
        joined = b" ".join(run)
        starts, p = [], 0
        for w in run:
            starts.append(p)
            p += len(w) + 1
        for length in self.lengths_sorted:
            for i in range(len(run) - length + 1):
                j = i + length - 1
                found = self.windows.get(joined[starts[i] : starts[j] + len(run[j])])
                if found:
                    hits.append((offset + i, offset + j + 1))
                    items |= found


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (item, window) rows of the benchmark."""

    def cut(batches):
        schema = pa.schema([("item", pa.string()), ("window", pa.binary())])
        for part in slices(batches):
            items, windows = [], []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = normal_words(text)
                for i in range(max(1, len(words) - n + 1) if words else 0):
                    items.append("null" if item is None else item)
                    windows.append(b" ".join(words[i : i + n]))
            yield table(schema, [items, windows])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(cut, "item string, window binary").distinct()


class Slices:
    """The windows in slices of at most about ``max_windows``, each read and broadcast when asked for."""

    def __init__(self, benchmark: DataFrame, n: int, max_windows: int):
        self.windows = materialize(benchmark_windows(benchmark, n), "bench-windows")
        self.count = max(1, -(-self.windows.count() // max_windows))
        self.context = benchmark.sparkSession.sparkContext

    def broadcast(self, k: int):
        part = F.pmod(F.xxhash64("window"), F.lit(self.count))
        return self.context.broadcast([(r.item, bytes(r.window)) for r in self.windows.where(part == k).toLocalIterator()])


_SETS: dict[str, WindowSet] = {}


def known_set(broadcast, key: str, n: int) -> WindowSet:
    """The set of a broadcast; a worker process keeps the last one it built."""
    if key not in _SETS:
        _SETS.clear()
        _SETS[key] = WindowSet(broadcast.value, n)
    return _SETS[key]


def _scan_slice(docs: DataFrame, broadcast, n: int) -> DataFrame:
    schema, name = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]), uuid.uuid4().hex

    def scan(batches):
        known = known_set(broadcast, name, n)
        for part in slices(batches):
            rows = []
            for doc, key, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                words = normal_words(text)
                hits, items = known.scan(words)
                rows.append((doc, key, len(words), hits, sorted(items)))
            yield table(schema, zip(*rows, strict=True))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), "text")
    return picked.mapInArrow(scan, "doc_id long, key binary, n_words long, hits array<array<bigint>>, items array<string>")


def _hits_by_slices(docs: DataFrame, cut: Slices, n: int) -> DataFrame:
    """(key, hits, items) of the documents with hits, from one scan a slice.

    Repeated documents share a key and their hits, so distinct values serve all of them."""
    paths = []
    for k in range(cut.count):
        known = cut.broadcast(k)
        paths.append(materialize(_scan_slice(docs, known, n).select("key", "hits", "items").where(F.size("items") > 0).dropDuplicates(["key"]), "bench-hits"))
        known.destroy()
    found = paths[0]
    for p in paths[1:]:
        found = found.unionByName(p)
    return found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_windows: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, hits (word intervals) and items (sorted ids)."""
    cut = Slices(benchmark, n, max_windows)
    if cut.count == 1:
        return _scan_slice(docs, cut.broadcast(0), n).drop("key")
    found = _hits_by_slices(docs, cut, n)

    def count(batches):
        schema = ddl_schema("doc_id long,key binary,n_words long")
        for part in slices(batches):
            yield table(schema, [part.column(0), part.column(1), [len(normal_words(t)) for t in part.column(2).to_pylist()]])

    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), "text").mapInArrow(count, "doc_id long, key binary, n_words long")
    empty = F.array().cast
    return every.join(found, "key", "left").select("doc_id", "n_words", F.coalesce("hits", empty("array<array<bigint>>")).alias("hits"), F.coalesce("items", empty("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, max_windows: int = 2_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``contaminated``: some word is hit and ``share * n_hit >= n_words``.
    """
    schema = ddl_schema("doc_id long,n_words long,n_hit long,n_items long,items_sha256 string,contaminated boolean")

    def judge(batches):
        for part in slices(batches, 4096):
            rows = []
            for doc, words, hits, items in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                hit = sum(e - s for s, e in merged((s, e) for s, e in hits))
                rows.append((doc, words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and share * hit >= words))
            yield table(schema, zip(*rows, strict=True))

    return scan_documents(docs, benchmark, n, max_windows).mapInArrow(judge, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, mode: str = "documents", max_windows: int = 2_000_000) -> DataFrame:
    """``docs`` without contaminated documents (``mode="documents"``), or with the hit words
    cut from the texts of all documents (``mode="spans"``; a cut leaves one space).

    All columns of ``docs`` are kept as they are, but for ``text`` in spans mode.
    """
    cut, at, name = Slices(benchmark, n, max_windows), docs.columns.index("text"), uuid.uuid4().hex

    def judged(part, at, all_hits):
        keep, texts = [], []
        for text, hits in zip(part.column(at).to_pylist(), all_hits, strict=True):
            n_hit = sum(e - s for s, e in hits)
            keep.append(mode == "spans" or not (n_hit and share * n_hit >= len(normal_words(text))))
            texts.append(without_spans(text, hits) if mode == "spans" and hits else text)
        if mode == "spans":
            part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
        return part.filter(pa.array(keep, pa.bool_()))

    if cut.count == 1:
        whole = cut.broadcast(0)

        def clean(batches):
            known = known_set(whole, name, n)
            for part in slices(batches):
                yield judged(part, at, [known.scan(normal_words(t))[0] for t in part.column(at).to_pylist()])

        return docs.mapInArrow(clean, docs.schema)
    found = _hits_by_slices(docs, cut, n).select(F.col("key").alias("__key"), F.col("hits").alias("__hits"))
    both = docs.withColumn("__key", row_key("doc_id", "text")).join(found, "__key", "left").select(*docs.columns, "__hits")

    def clean_joined(batches):
        for part in slices(batches):
            hits = part.column(part.num_columns - 1).to_pylist()
            yield judged(part.select(range(part.num_columns - 1)), at, [merged(map(tuple, h or [])) for h in hits])

    return both.mapInArrow(clean_joined, docs.schema)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def without_spans(text: str, hits: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``hits``; each cut leaves one space."""
    where = [m.span() for m in _WORD.finditer(re.sub(r"[A-Z]", lambda m: m[0].lower(), text))]
    out, last = [], 0
    for s, e in hits:
        out.append(text[last : where[s][0]])
        last = where[e - 1][1]
    return " ".join([*out, text[last:]])
