"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public byte-level vocabulary made of letters, with or
without a leading space. Each language has a probability for every piece; a word's
probability is the sum over all its segmentations into pieces, found by the forward
algorithm, and a text's is the product over its words (runs of letters, lower-cased).
Piece probabilities are learned by expectation maximisation: expected piece counts over
all segmentations (forward-backward), summed over tasks, one Spark job a round.

Training reads at most about ``train_docs`` labelled documents a language, chosen by a 63-bit
hash of id and text, so a share of any size can be asked for; that bound is a parameter. The
document of a language with the least hash is always read, so none goes unlearned. Language
priors count all labelled documents.
The model is languages x pieces numbers, whatever the input. Scoring maps over the
documents without a shuffle; each worker remembers the scores of words it has met.

Edge cases: a null text or one without a letter is ``und`` with score 0. Words over 40
bytes are scored in pieces of 40. Null ids count as the empty text when ids are hashed. No
labelled text at all: everything is ``und``. Repeated rows each get their row. Other columns
are not read.
"""

from __future__ import annotations

import base64
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_schema, materialize, slices, table

_WORD = re.compile(r"[^\W\d_]+")
LONGEST = 40
FLOOR = 1e-7
#: The highest hash by which documents are drawn for training.
LOTS = (1 << 63) - 1


def letter_words(text: str | None) -> list[str]:
    # \w also has numbers that are no digits, such as a superscript two
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def chunks(word: str) -> list[bytes]:
    """A word as bytes with its leading space, cut to at most LONGEST bytes."""
    raw = b" " + word.encode("utf-8")
    return [raw[i : i + LONGEST] for i in range(0, len(raw), LONGEST)]


class Pieces:
    """The vocabulary as a byte trie in one array."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        letters = [b for b in range(256) if b >= 0x80 or 97 <= b <= 122]
        allowed = set(letters)
        pieces = {bytes([b]) for b in [32, *letters]}
        pieces |= {t for t in tokens if len(t) <= LONGEST and all(b in allowed for b in t.removeprefix(b" ")) and t}
        self.pieces = sorted(pieces)
        self.kind = np.full(256, 0, np.int32)
        self.kind[[32, *letters]] = np.arange(1, len(letters) + 2)
        rows = [np.zeros(len(letters) + 2, np.int32)]
        ends = [-1]
        for n, piece in enumerate(self.pieces):
            at = 0
            for b in piece:
                k = self.kind[b]
                if not rows[at][k]:
                    rows[at][k] = len(rows)
                    rows.append(np.zeros(len(letters) + 2, np.int32))
                    ends.append(-1)
                at = rows[at][k]
            ends[at] = n
        self.child, self.piece_at = np.array(rows), np.array(ends, np.int32)

    def lattice(self, words: list[bytes]):
        """For words of one length: (start, end, rows, piece ids) of every piece found, by start, then end."""
        n = len(words[0])
        codes = self.kind[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n)]
        for i in range(n):
            rows, state = np.arange(len(words)), np.zeros(len(words), np.int32)
            for j in range(i, n):
                state = self.child[state, codes[rows, j]]
                live = state > 0
                if not live.all():
                    rows, state = rows[live], state[live]
                    if not len(rows):
                        break
                ids = self.piece_at[state]
                ok = ids >= 0
                if ok.any():
                    yield i, j + 1, rows[ok], ids[ok]


def by_length(words):
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    return groups.values()


def forward(pieces: Pieces, probs: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log P(word) under each language, words x languages, summed over all segmentations."""
    out = np.empty((len(words), probs.shape[1]))
    for group in by_length(words):
        for at in range(0, len(group), 8192):
            part = group[at : at + 8192]
            own = [words[k] for k in part]
            alpha = np.zeros((len(own[0]) + 1, len(own), probs.shape[1]))
            alpha[0] = 1.0
            for i, j, rows, ids in pieces.lattice(own):
                alpha[j][rows] += alpha[i][rows] * probs[ids]
            out[part] = np.log(np.maximum(alpha[-1], 1e-300))
    return out


def expected(pieces: Pieces, probs: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected piece counts of words with the given frequencies, under one language."""
    out = np.zeros(len(pieces.pieces))
    for group in by_length(words):
        for at in range(0, len(group), 8192):
            part = group[at : at + 8192]
            own, weight = [words[k] for k in part], counts[part]
            arcs = list(pieces.lattice(own))
            n = len(own[0])
            alpha, beta = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
            alpha[0] = beta[n] = 1.0
            for i, j, rows, ids in arcs:
                alpha[j][rows] += alpha[i][rows] * probs[ids]
            # arcs come by start, so walking back finds each end complete
            for i, j, rows, ids in reversed(arcs):
                beta[i][rows] += beta[j][rows] * probs[ids]
            scale = weight / np.maximum(alpha[n], 1e-300)
            for i, j, rows, ids in arcs:
                np.add.at(out, ids, alpha[i][rows] * probs[ids] * beta[j][rows] * scale[rows])
    return out


_PIECES: dict[str, Pieces] = {}


def load_pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


class Model:
    """languages, log priors, and piece probabilities (pieces x languages)."""

    def __init__(self, path: str, langs: list[str], prior: np.ndarray, probs: np.ndarray):
        self.path, self.langs, self.prior, self.probs = path, langs, prior, probs


def text_key():
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def is_held_out():
    """crc32 of the id as text leaves 1 when divided by 3."""
    return F.pmod(F.crc32(text_key().cast("binary")), F.lit(3)) == 1


def most_lot(n: int, train_docs: int) -> int:
    """The highest lot of a sample of about ``train_docs`` of ``n`` documents."""
    return LOTS if n <= train_docs else LOTS * train_docs // n


def fit(docs: DataFrame, vocabulary: str, train_docs: int = 1500, rounds: int = 3, max_langs: int = 1000) -> Model:
    """Learn from text and lang of ``docs``; rows without either teach nothing."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(text_key(), F.col("text"), F.lit(7)).bitwiseAND(F.lit(LOTS)).alias("lot"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min("lot").alias("least")).limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages: raise max_langs")
    langs = sorted(r["lang"] for r in counts)
    sizes = np.array([next(r["count"] for r in counts if r["lang"] == x) for x in langs], float)
    n_pieces = len(load_pieces(vocabulary).pieces)
    if not langs:
        return Model(vocabulary, [], np.zeros(0), np.zeros((n_pieces, 0)))
    # at most max_langs rows
    lots = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"], most_lot(r["count"], train_docs))) for r in counts], "lang string, most long")
    sample = labelled.join(F.broadcast(lots), "lang").where("lot <= most").select("lang", "text")

    def count(batches):
        found: Counter = Counter()
        schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

        def out():
            return table(schema, [[k[0] for k in found], [k[1] for k in found], list(found.values())])

        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for w, n in Counter(letter_words(text)).items():
                    for c in chunks(w):
                        found[lang, c] += n
            if len(found) > 300_000:
                yield out()
                found.clear()
        if found:
            yield out()

    words = materialize(sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lid-words")
    probs = np.full((n_pieces, len(langs)), 1.0 / n_pieces)
    sc = docs.sparkSession.sparkContext
    for _ in range(rounds):
        now = sc.broadcast(probs)

        def expect(batches, now=now):
            pieces, schema = load_pieces(vocabulary), ddl_schema("lang int,piece int,n double")
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                frame = batch.to_pandas()
                for lang, own in frame.groupby("lang"):
                    got = expected(pieces, np.ascontiguousarray(now.value[:, langs.index(lang)]), own["word"].tolist(), own["n"].to_numpy(float))
                    sums[lang] = sums.get(lang, 0) + got
            for lang, s in sums.items():
                at = np.flatnonzero(s)
                yield table(schema, [np.full(len(at), langs.index(lang), np.int32), at.astype(np.int32), s[at]])

        # languages x pieces rows at most
        got = words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros_like(probs)
        sums[got["piece"].to_numpy(np.int64), got["lang"].to_numpy(np.int64)] = got["n"].to_numpy()
        # what all languages share, with a floor, stands in for pieces a language lacks
        shared = sums.sum(axis=1, keepdims=True) + 0.1
        shared /= shared.sum()
        mass = np.maximum(sums.sum(axis=0, keepdims=True), 1.0)
        probs = np.maximum((sums + 0.01 * mass * shared) / (1.01 * mass), FLOOR)
    return Model(vocabulary, langs, np.log(sizes / sizes.sum()), probs)


class Scorer:
    """Scores texts and remembers words; one a worker process and model."""

    MAX_WORDS = 400_000
    _held: dict = {}

    def __init__(self, model: Model):
        self.model, self.pieces = model, load_pieces(model.path)
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))

    @classmethod
    def of(cls, broadcast, key) -> Scorer:
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(broadcast.value)
        return cls._held[key]

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.at]
        if not new:
            return
        if len(self.at) + len(new) > self.MAX_WORDS:
            self.at.clear()
            self.scores = self.scores[:0]
            new = list(words)
        raw, owner = [], []
        for k, w in enumerate(new):
            for c in chunks(w):
                raw.append(c)
                owner.append(k)
        logs = forward(self.pieces, self.model.probs, raw)
        total = np.zeros((len(new), logs.shape[1]))
        np.add.at(total, np.array(owner), logs)
        for w in new:
            self.at[w] = len(self.at)
        self.scores = np.concatenate((self.scores, total))

    def predict(self, texts: list) -> list[tuple[str, float]]:
        words = [letter_words(t) for t in texts]
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        self.learn(set().union(*words))
        out = []
        for own in words:
            if not own:
                out.append(("und", 0.0))
                continue
            logs = self.model.prior + self.scores[[self.at[w] for w in own]].sum(axis=0)
            p = np.exp(logs - logs.max())
            best = int(p.argmax())
            out.append((self.model.langs[best], float(p[best] / p.sum())))
        return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (posterior of lang_pred)."""
    import uuid

    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    ddl = "doc_id long,held_out boolean,lang_pred string,score double"
    schema = ddl_schema(ddl)

    def score(batches):
        scorer = Scorer.of(shared, key)
        for part in slices(batches):
            got = scorer.predict(part.column(2).to_pylist())
            yield table(schema, [part.column(0), part.column(1), [x for x, _ in got], [s for _, s in got]])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text")
    return picked.mapInArrow(score, ddl)
