"""Token-ID output: frequency-ranked ids, byte-aligned, with separate control bytes.

A file holds consecutive documents. Its ids are replaced by their frequency rank in the
file, so common ids take one byte; four ranks share a control byte of two bits each, which
give the lengths 1 to 4, and the ranks' bytes follow in a stream of their own. Decoding
looks the control bytes up in a numpy table and gathers the bytes. Layout, little-endian:

    8 bytes magic, 4 x u64: documents, ids, table entries, data bytes
    i64 doc ids, u8 null flags, u64 lengths (a document each), u32 rank -> id table,
    control bytes, data bytes

Documents are range-partitioned and sorted by id, then by a hash of the text. Each task
tokenises its documents, cuts a file after ``file_ids`` ids and keeps no more than one
file in memory. Files get unique names and count only once the manifest, which Spark
commits, lists them: files of lost or repeated task attempts are never read.

Byte-level BPE is applied a pre-token at a time through the tokenizers library's model.
The texts of a slice are split by comparing the kinds of neighbouring characters in numpy;
their distinct pre-tokens are looked up in a cache that each worker keeps, and only new ones
go to the library. Texts that hold a special token's string go through the library whole.
Other tokenizers always do.

Edge cases: null or empty texts are the end id alone. Null doc ids come first. Repeated
rows are documents of their own. Empty tables give no files and no rows. Other columns are
not read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ddl_schema, materialize, new_path, slices, table

MAGIC = b"CFVBYTE1"
_CHUNK = 1 << 18

# --- codec ----------------------------------------------------------------------------

#: Lengths of the four ranks of each control byte.
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_COLUMNS = np.arange(4, dtype=np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    control, data = [], []
    for at in range(0, len(ranks), _CHUNK):
        part = ranks[at : at + _CHUNK].astype("<u4")
        code = (part > 0xFF).astype(np.uint8) + (part > 0xFFFF) + (part > 0xFFFFFF)
        data.append(part.view(np.uint8).reshape(-1, 4)[_COLUMNS <= code[:, None]].tobytes())
        quads = np.concatenate((code, np.zeros(-len(code) % 4, np.uint8))).reshape(-1, 4)
        control.append((quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8).tobytes())
    return b"".join(control), b"".join(data)


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.uint32)
    p = 0
    for at in range(0, n, _CHUNK):
        m = min(_CHUNK, n - at)
        lengths = _LENGTHS[control[at // 4 : (at + m + 3) // 4]].reshape(-1)[:m]
        ends = np.cumsum(lengths, dtype=np.int64)
        starts = ends - lengths + p
        bytes_ = np.concatenate((data[p : p + int(ends[-1])], np.zeros(3, np.uint8)))
        starts -= p
        value = np.zeros(m, np.uint32)
        for k in range(4):
            value |= np.where(lengths > k, bytes_[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
        out[at : at + m] = value
        p += int(ends[-1])
    return out


def file_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray) -> list[bytes]:
    counts = np.bincount(ids)
    by_rank = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = pack(rank[ids])
    head = MAGIC + np.array([len(doc_ids), len(ids), len(by_rank), len(data)], "<u8").tobytes()
    known = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return [head, known, nulls, np.array(lengths, "<u8").tobytes(), by_rank.tobytes(), control, data]


def parse_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, lengths, all ids) of a file's bytes."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, entries, size = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    p = 40
    doc_ids = np.frombuffer(raw, "<i8", docs, p)
    nulls = np.frombuffer(raw, np.uint8, docs, p := p + 8 * docs)
    lengths = np.frombuffer(raw, "<u8", docs, p := p + docs).astype(np.int64)
    by_rank = np.frombuffer(raw, "<u4", entries, p := p + 8 * docs)
    control = np.frombuffer(raw, np.uint8, (n + 3) // 4, p := p + 4 * entries)
    data = np.frombuffer(raw, np.uint8, size, p + len(control))
    ids = by_rank[unpack(control, data, n)] if n else np.zeros(0, np.uint32)
    return [None if x else int(d) for d, x in zip(doc_ids, nulls, strict=True)], lengths, ids


# --- tokens ---------------------------------------------------------------------------


class CachedEncoder:
    """Encodes texts to little-endian u32 ids through a tokenizers file."""

    MAX_PIECES, KEPT_BYTES = 700_000, 64
    #: Characters that are split at once, unless one text without spaces has more.
    GROUP_CHARS = 1 << 20
    #: Kinds of characters: letters, numbers and others, each named by one of them, and white space.
    _KINDS, _WHITE, _UNKNOWN = "a1!", 3, 255
    _loaded: dict[str, CachedEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        self.gap = re.compile(r"\S ")
        self.kinds = np.full(0x110000, self._UNKNOWN, np.uint8)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in plain]
        self.letters = np.zeros(256, "<u4")
        self.letters[plain] = plain
        self.letters[moved] = 256 + np.arange(len(moved))
        self.pieces: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> CachedEncoder:
        """One encoder a worker process: its cache serves all tasks that run there."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def kinds_of(self, codes: np.ndarray) -> np.ndarray:
        """The kind of each character, as the library has it: it joins a character to those of its kind."""
        kind = self.kinds[codes]
        unknown = kind == self._UNKNOWN
        if unknown.any():
            split = self.whole.pre_tokenizer.pre_tokenize_str
            for c in np.unique(codes[unknown]).tolist():
                self.kinds[c] = next((k for k, x in enumerate(self._KINDS) if len(split(x + chr(c) + x)) == 1), self._WHITE)
            kind = self.kinds[codes]
        return kind

    def starts(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The first characters of all pre-tokens of texts that begin at ``begins``, as the library's pattern
        ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` cuts them."""
        n = len(codes)
        kind = self.kinds_of(codes)
        first = np.zeros(n + 2, bool)
        first[begins] = first[n:] = True
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # the last of white space before something else stands alone, but a space goes with what follows
        white = kind == self._WHITE
        last = white[:-1] & ~white[1:] & ~first[1:n]
        start[: n - 1] |= last
        start[1:n] &= ~(last & (codes[:-1] == ord(" ")))
        marks = np.flatnonzero((codes == ord("'")) & start[:n])
        if len(marks):
            after = np.concatenate((codes, np.zeros(2, codes.dtype)))
            one, two = (np.where(first[marks + 1], 0, after[marks + 1]), np.where(first[marks + 1] | first[marks + 2], 0, after[marks + 2]))
            size = np.isin(one, [ord(c) for c in "stmd"]) * 2
            for a, b in ("re", "ve", "ll"):
                size[(one == ord(a)) & (two == ord(b))] = 3
            cut = size > 0
            start[marks[cut] + 1] = False
            start[marks[cut] + size[cut]] = True
        return np.flatnonzero(start[:n])

    def _spelled(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, by the library's model."""
        tokenize = self.whole.model.tokenize
        shown = self.letters[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        flat, ends, at = [], [0], 0
        for piece in pieces:
            flat += [t.id for t in tokenize(shown[at : at + len(piece)])]
            ends.append(len(flat))
            at += len(piece)
        raw = np.array(flat, "<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

    def _group(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are not empty. Their pre-tokens lie in an Arrow array over the texts' bytes, and
        only its distinct values are looked up."""
        joined = "".join(texts)
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        starts = self.starts(np.frombuffer(joined.encode("utf-32-le"), "<u4"), begins)
        raw = joined.encode()
        at = starts if len(raw) == len(joined) else np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[starts]
        offsets = np.append(at, len(raw)).astype(np.int64)
        split = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        spans, values = split.dictionary.buffers()[1:]
        spans, values = np.frombuffer(spans, np.int64, len(split.dictionary) + 1).tolist(), values.to_pybytes()
        distinct = [values[a:b] for a, b in zip(spans, spans[1:])]
        got = list(map(self.pieces.get, distinct))
        new = [k for k, ids in enumerate(got) if ids is None]
        for k, ids in zip(new, self._spelled([distinct[k] for k in new]), strict=True):
            got[k] = ids
        if len(self.pieces) + len(new) > self.MAX_PIECES:
            # those of these texts, which are the most frequent ones, stay
            self.pieces, new = {}, range(len(distinct))
        self.pieces.update((distinct[k], got[k]) for k in new if len(distinct[k]) <= self.KEPT_BYTES)
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
        first = np.cumsum(lengths) - lengths
        which = split.indices.to_numpy()
        n = lengths[which]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(got), "<u4")[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        edges = np.append((ends - n)[np.searchsorted(starts, begins)], ends[-1]).tolist()
        return [ids[4 * a : 4 * b] for a, b in zip(edges, edges[1:])]

    def _cut(self, text: str) -> list[str]:
        """A long text in parts: a space after anything but white space always starts a pre-token."""
        parts, at = [], 0
        while len(text) - at > self.GROUP_CHARS and (gap := self.gap.search(text, at + self.GROUP_CHARS - 1)):
            parts.append(text[at : gap.start() + 1])
            at = gap.start() + 1
        return [*parts, text[at:]]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        group, rows, chars = [], [], 0

        def done():
            for row, ids in zip(rows, self._group(group) if group else [], strict=True):
                out[row].append(ids)

        for row, text in enumerate(texts):
            if not text:
                continue
            if not self.by_piece or self.special.search(text):
                out[row].append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            for part in self._cut(text):
                if chars + len(part) > self.GROUP_CHARS:
                    done()
                    group, rows, chars = [], [], 0
                group.append(part)
                rows.append(row)
                chars += len(part)
        done()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


# --- files ----------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, file_ids: int = 4_000_000) -> DataFrame:
    """Write ``docs`` (doc_id, text) under ``path`` and return the committed manifest:
    part, seq, file, n_docs, n_ids; files in (part, seq) order hold the documents in order."""
    ddl = "part long,seq long,file string,n_docs long,n_ids long"
    schema = ddl_schema(ddl)

    def write(batches):
        from pyarrow import fs

        encoder = CachedEncoder.load(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, chunks, held = [], [], [], 0

        def flush():
            file = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{root}/{file}") as out:
                for x in file_bytes(ids, lengths, np.frombuffer(b"".join(chunks), "<u4")):
                    out.write(x)
            return table(schema, [[part], [seq], [file], [len(ids)], [held]])

        for some in slices(batches):
            for doc, chunk in zip(some.column(0).to_pylist(), encoder.encode_all(some.column(1).to_pylist()), strict=True):
                chunk += end
                ids.append(doc)
                lengths.append(len(chunk) // 4)
                chunks.append(chunk)
                held += lengths[-1]
                if held >= file_ids:
                    yield flush()
                    seq += 1
                    ids, lengths, chunks, held = [], [], [], 0
        if ids:
            yield flush()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = picked.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialize(ordered.mapInArrow(write, ddl), "token-manifest")


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (u32 bytes)."""
    ddl = "doc_id long,start long,n_tokens long,ids_crc32 long" + ",ids binary" * with_ids
    schema = ddl_schema(ddl)

    def read(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{file}") as f:
                    doc_ids, lengths, ids = parse_file(f.read())
                ends = np.cumsum(lengths)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for at in range(0, len(doc_ids), 1024):
                    spans = list(zip((ends - lengths)[at : at + 1024].tolist(), ends[at : at + 1024].tolist(), strict=True))
                    rows = [doc_ids[at : at + 1024], [start + a for a, _ in spans], [b - a for a, b in spans], [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans]]
                    yield table(schema, rows + ([[bytes(raw[4 * a : 4 * b]) for a, b in spans]] if with_ids else []))

    # a row a task that wrote, so the one task that adds up the parts sees few; files are added up by part
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("held"))
    parts = parts.select("part", F.sum("held").over(ahead.orderBy("part")).alias("before"))
    within = F.sum("n_ids").over(ahead.partitionBy("part").orderBy("seq"))
    files = manifest.select("part", "file", within.alias("within")).join(parts, "part")
    files = files.select("file", (F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0))).cast("long").alias("start"))
    return files.repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(read, ddl)


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 0, file_ids: int = 4_000_000) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, path, write_tokens(docs, path, tokenizer, end_id, file_ids))
