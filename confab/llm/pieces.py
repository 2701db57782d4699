"""SentencePiece encoding and decoding by vectorised merge rounds.

A text's spaces become meta spaces and one is put in front. Byte-pair merges cannot cross a
meta space that follows another character, nor two characters that no piece holds side by
side, so texts fall into short runs of symbols that merge apart from each other. All new words
of a slice of texts lie in flat numpy arrays, one symbol a character. A round looks up the rank
of each adjacent pair, takes the least of each run (``minimum.reduceat``), merges that pair
everywhere in the run, leftmost first and without overlap, and compacts the arrays; runs without
a pair that is a piece leave. Only pairs beside a merge are looked up again. Characters
that are no piece become byte pieces at the end.

A queue would merge one pair at a time. The rounds give its result unless a merge makes a pair
that comes before the merges of its own round, which a table of the vocabulary tells
(``hasty``): of such pieces a round merges the first of a run alone, and runs of over
``LONG_RUN`` symbols are finished by a queue, so a text of any length costs n log n.

Workers keep the ids of words seen, up to ``MAX_WORDS`` words. Ids, like the tables, are those
of the given model file: byte-pair models with byte fallback, the identity normaliser and no
user-defined pieces; others are refused by an error.

Edge cases: null or empty texts have the begin and end ids alone and decode to an empty text. Texts
with meta spaces of their own decode to spaces, as in the library. Repeated rows each get their
own row; null doc_ids stay null. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_schema, slices, table

META = "▁"
#: Runs longer than this that hold a hasty piece twice are finished by a queue.
LONG_RUN = 256
MAX_WORDS, MAX_WORD_CHARS = 500_000, 64
#: Characters of new words that are merged at once, unless one word alone has more.
_BATCH_CHARS = 1 << 20
_NO_RANK = np.iinfo(np.int32).max
_WORD = re.compile(f"{META}*[^{META}]+|{META}+")


class Pieces:
    """The tables of a model file."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, rules, spec = proto.ModelProto.SentencePiece, model.normalizer_spec, model.trainer_spec
        types = [p.type for p in model.pieces]
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        if spec.model_type != proto.TrainerSpec.BPE or not spec.byte_fallback or spec.treat_whitespace_as_suffix or not plain or kind.USER_DEFINED in types or kind.UNUSED in types:
            raise ValueError("only byte-pair models with byte fallback, no normalisation and no user-defined pieces")
        self.size = len(types)
        self.bos, self.eos, self.unknown = spec.bos_id, spec.eos_id, types.index(kind.UNKNOWN)
        texts = [p.piece for p in model.pieces]
        normal = {t: i for i, t in enumerate(texts) if types[i] == kind.NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        for i, t in enumerate(texts):
            if types[i] == kind.BYTE:
                self.byte_ids[int(t[3:5], 16)] = i
        # characters of pieces that are no piece alone are symbols too
        symbols = dict(normal)
        for c in sorted({c for t in normal for c in t} - normal.keys()):
            symbols[c] = self.size + len(symbols) - len(normal)
        self.stranger = self.size + len(symbols) - len(normal)
        self.of_char = np.full(0x110000, self.stranger, np.int32)
        for t, i in symbols.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        scores = np.array([p.score for p in model.pieces], np.float32)
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs, beside = {}, set()
        self.hasty = np.zeros(self.stranger + 1, bool)
        for t, i in normal.items():
            for k in range(1, len(t)):
                beside.add(ord(t[k - 1]) << 21 | ord(t[k]))
                left, right = t[:k], t[k:]
                if left in symbols and right in symbols:
                    pairs[symbols[left] * (self.stranger + 1) + symbols[right]] = i
                    for part in (left, right):
                        if len(part) > 1 and rank[i] <= rank[symbols[part]]:
                            self.hasty[symbols[part]] = True
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.pair_ranks = rank[self.pair_ids]
        self.beside = np.array(sorted(beside), np.int64)
        # decoding: the bytes of each piece, with spaces for meta spaces; control pieces have none
        shown = [b"" if types[i] == kind.CONTROL else bytes([int(t[3:5], 16)]) if types[i] == kind.BYTE else spec.unk_surface.encode() if types[i] == kind.UNKNOWN else t.replace(META, " ").encode() for i, t in enumerate(texts)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_len = np.array([len(b) for b in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self.is_control = np.array([t == kind.CONTROL for t in types])
        self.opens_word = np.array([types[i] == kind.NORMAL and t.startswith(META) for i, t in enumerate(texts)])
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        """One a worker process: its words serve all tasks that run there."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    # --- encoding ---------------------------------------------------------------------

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of the piece that each pair makes; ``_NO_RANK`` where it makes none."""
        keys = left.astype(np.int64) * (self.stranger + 1) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_ranks[at], _NO_RANK), self.pair_ids[at]

    def merged(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The symbol that begins at each character, or -1: ``starts`` are the words' first characters."""
        out = self.of_char[chars]
        if len(chars) < 2:
            return out
        cut = np.ones(len(chars), bool)
        both = chars[:-1].astype(np.int64) << 21 | chars[1:]
        cut[1:] = self.beside[np.minimum(np.searchsorted(self.beside, both), len(self.beside) - 1)] != both
        cut[starts] = True
        run, sym, at = np.cumsum(cut), out.copy(), np.arange(len(chars))
        rank, made = np.full(len(chars), _NO_RANK, np.int32), np.zeros(len(chars), np.int32)

        def look(where):
            where = where[(where >= 0) & (where < len(sym))]
            rank[where] = _NO_RANK
            where = where[where < len(sym) - 1]
            where = where[run[where] == run[where + 1]]
            rank[where], made[where] = self.pair(sym[where], sym[where + 1])

        look(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(sym))
            if (best == _NO_RANK).any():
                keep = np.repeat(best != _NO_RANK, size)
                sym, at, run, rank, made = sym[keep], at[keep], run[keep], rank[keep], made[keep]
                continue
            found = np.flatnonzero(rank == np.repeat(best, size))
            # of neighbours in a row, which overlap, every second one merges
            fresh = np.concatenate(([True], found[1:] != found[:-1] + 1))
            order = np.arange(len(found))
            found = found[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            again = np.concatenate(([False], run[found[1:]] == run[found[:-1]]))
            hasty = self.hasty[made[found]]
            if (again & hasty).any():
                wary = np.unique(run[found[hasty]])
                in_wary = np.isin(run[found], wary)
                by_run = np.searchsorted(run[first], run[found])
                queued = in_wary & again & (size[by_run] > LONG_RUN)
                for k in np.unique(by_run[queued]).tolist():
                    a, b = int(first[k]), int(first[k] + size[k])
                    symbols = self.queued(sym[a:b].tolist())
                    out[at[a:b]] = symbols
                    rank[a:b] = _NO_RANK
                found = found[~(in_wary & again) & (rank[found] != _NO_RANK)]
            out[at[found]] = sym[found] = made[found]
            out[at[found + 1]] = -1
            keep = np.ones(len(sym), bool)
            keep[found + 1] = False
            place = (np.cumsum(keep) - 1)[found]
            sym, at, run, rank, made = sym[keep], at[keep], run[keep], rank[keep], made[keep]
            look(np.concatenate((place, place - 1)))
        return out

    def queued(self, symbols: list[int]) -> list[int]:
        """The merges of one long run by a queue; a symbol that was merged into another is -1."""
        rank_of = {k: (r, i) for k, r, i in zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), self.pair_ids.tolist(), strict=True)}
        base, n = self.stranger + 1, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (got := rank_of.get(symbols[a] * base + symbols[b])):
                heapq.heappush(heap, (got[0], a, symbols[a] * base + symbols[b], got[1]))

        for a in range(n - 1):
            push(a, a + 1)
        while heap:
            _, a, key, made = heapq.heappop(heap)
            b = after[a]
            if symbols[a] < 0 or b < 0 or symbols[a] * base + symbols[b] != key:
                continue
            symbols[a], symbols[b] = made, -1
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            push(before[a], a)
            push(a, after[a])
        return symbols

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not empty, as little-endian u32."""
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes) - sizes
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols = self.merged(chars, starts)
        there = np.flatnonzero(symbols >= 0)
        symbols = symbols[there]
        odd = symbols >= self.size
        count = np.ones(len(there), np.int64)
        spelled = [chr(c).encode() for c in chars[there[odd]].tolist()]
        count[odd] = [len(b) for b in spelled]
        ids = np.repeat(np.where(odd, 0, symbols), count).astype("<u4")
        if spelled:
            ids[np.repeat(odd, count)] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        ends = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(there, np.concatenate((starts, [len(chars)])))]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True) -> list[bytes]:
        """Ids of each text, as little-endian u32."""
        split = [_WORD.findall(META + t.replace(" ", META)) if t else [] for t in texts]
        own: dict[str, bytes] = {}  # of this slice, whatever happens to the kept ones
        new: list[str] = []
        for words in split:
            for w in words:
                if w not in own:
                    got = self.words.get(w)
                    own[w] = got if got is not None else b""
                    if got is None:
                        new.append(w)
        at = 0
        while at < len(new):
            end, chars = at, 0
            while end < len(new) and (end == at or chars + len(new[end]) <= _BATCH_CHARS):
                chars += len(new[end])
                end += 1
            own.update(zip(new[at:end], self.word_ids(new[at:end]), strict=True))
            at = end
        if len(self.words) + len(new) > MAX_WORDS:
            self.words.clear()
        self.words.update((w, own[w]) for w in new if len(w) <= MAX_WORD_CHARS)
        head, tail = (np.array([i] * use, "<u4").tobytes() for i, use in ((self.bos, bos), (self.eos, eos)))
        return [b"".join([head, *[own[w] for w in words], tail]) for words in split]

    # --- decoding ---------------------------------------------------------------------

    def decode(self, rows: list[bytes]) -> list[str]:
        """The text of each row of ids (little-endian u32)."""
        sizes = np.array([len(r) // 4 for r in rows], np.int64)
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        if len(ids) and ids.max() >= self.size:
            raise ValueError("an id beyond the vocabulary")
        length, begin = self.shown_len[ids], self.shown_at[ids]
        # the space before a text's first piece is the encoder's own
        said = np.flatnonzero(~self.is_control[ids])
        row = np.repeat(np.arange(len(rows)), sizes)[said]
        opening = said[np.concatenate(([True], row[1:] != row[:-1]))] if len(said) else said
        own = self.opens_word[ids[opening]]
        length[opening[own]] -= 1
        begin[opening[own]] += 1
        ends = np.cumsum(length)
        raw = self.shown[np.repeat(begin - (ends - length), length) + np.arange(int(length.sum()))].tobytes()
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [_text(raw[a:b]) for a, b in zip(edges, edges[1:])]


def _text(raw: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is none."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        out, at = [], 0
        while True:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
            try:
                return "".join([*out, raw[at:].decode()])
            except UnicodeDecodeError as again:
                e = again


# --- operators ------------------------------------------------------------------------


def encode(docs: DataFrame, model: str, bos: bool = True, eos: bool = True) -> DataFrame:
    """Per document: doc_id and ids (little-endian u32 in a binary)."""
    ddl = "doc_id long,ids binary"
    schema = ddl_schema(ddl)

    def run(batches):
        pieces = Pieces.load(model)
        for part in slices(batches):
            yield table(schema, [part.column(0), pieces.encode([t or "" for t in part.column(1).to_pylist()], bos, eos)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """Per row of ``tokens`` (doc_id, ids): doc_id and text; null ids are none."""
    ddl = "doc_id long,text string"
    schema = ddl_schema(ddl)

    def run(batches):
        pieces = Pieces.load(model)
        for part in slices(batches):
            yield table(schema, [part.column(0), pieces.decode([r or b"" for r in part.column(1).to_pylist()])])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, ddl)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, from its ids and their text."""
    ddl = "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string"
    schema = ddl_schema(ddl)

    def run(batches):
        pieces = Pieces.load(model)
        for part in slices(batches):
            ids = pieces.encode([t or "" for t in part.column(1).to_pylist()])
            texts = pieces.decode(ids)
            yield table(schema, [part.column(0), [len(r) // 4 for r in ids], [hashlib.sha256(r).hexdigest() for r in ids], [hashlib.sha256(t.encode()).hexdigest() for t in texts]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)
