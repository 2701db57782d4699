"""Secret scan: key patterns, and sliding-window entropy for what patterns miss.

Patterns give the base spans. For the rest, candidate strings (runs of at least
``window`` token characters) are cut into runs of one character class; over each run
a window slides whose Shannon entropy is kept from incremental counts, and the union
of windows above the class's threshold becomes a span of the class's kind: hex, base64,
lower case with digits, upper case with digits, or letters only. Names, paths and long
words are as various as keys by their letters, so windows of the classes with letters beyond hex
must also change between vowels, consonants, cases, digits and separators as chance does rather than
as words do (``NAMES``): sums of the bits by which a change speaks for chance, kept a
position, tell that of any window at once. An allow list suppresses
digests, identifiers and keys of public examples, and the windows that hold part of a
placeholder or of the letters and digits joined to it, as far as one window. A span that
a base span or one of an earlier class covers is not repeated. Base spans are never suppressed.

Of random keys of 24 characters the tests find 0.9 and more of each alphabet, of 32 0.98, but of keys
of letters of one case, which compound words resemble, about a third; of made-up names, paths, constants and
compound words they accept under 0.01.

Spans count code points, end exclusive, and cover the whole match.

Edge cases: null texts are empty: no spans. Repeated rows are each scanned. Very long
texts and runs are scanned whole, in linear time, a megabyte of nothing but keys in a few seconds; of spans of two classes with the same place the first class's stays. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_schema, slices, table

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64", "entropy_lower", "entropy_upper", "entropy_letters")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes: (kind, run pattern, bits a window must exceed, kinds of character a window must
#: hold, and bits by which it must look like chance rather than names; None where hex digits leave no names).
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 2.9, "da", None),
    ("entropy_b64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7, "dlu", 8.0),
    ("entropy_lower", re.compile(r"[a-z0-9]{20,}"), 3.5, "dl", 7.0),
    ("entropy_upper", re.compile(r"[A-Z0-9]{20,}"), 3.5, "du", 7.0),
    ("entropy_letters", re.compile(r"[A-Za-z]{20,}"), 3.6, "", 7.0),
)
#: How often, in names and paths, a kind of character (vowel, consonant, their capitals, digit, separator)
#: follows another: rows are what came before.
NAMES = {
    "v": (0.13, 0.74, 0.01, 0.05, 0.02, 0.05),
    "c": (0.49, 0.37, 0.01, 0.06, 0.02, 0.05),
    "V": (0.08, 0.71, 0.02, 0.13, 0.03, 0.03),
    "C": (0.55, 0.18, 0.06, 0.14, 0.03, 0.04),
    "d": (0.05, 0.10, 0.03, 0.07, 0.55, 0.20),
    "s": (0.22, 0.47, 0.06, 0.12, 0.11, 0.02),
}
_KINDS = "vcVCds"
_KIND_OF = {c: "v" if c in "aeiouy" else "V" if c in "AEIOUY" else "c" if c.islower() else "C" if c.isupper() else "d" if c.isdigit() else "s" for c in map(chr, range(33, 127))}
_TO_KIND = str.maketrans(_KIND_OF)


def _chance(alphabet: str) -> dict[str, float]:
    """For each two kinds in a row, the bits by which they speak for chance over ``alphabet`` rather than for a name."""
    share = {k: sum(_KIND_OF[c] == k for c in alphabet) / len(alphabet) for k in _KINDS}
    return {a + b: math.log2(max(share[b], 1e-3) / NAMES[a][_KINDS.index(b)]) for a in _KINDS for b in _KINDS}


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_BITS = {"entropy_b64": _chance(_LOWER + _LOWER.upper() + _DIGITS + "+/"), "entropy_letters": _chance(_LOWER + _LOWER.upper()), "one_case": _chance(_LOWER + _DIGITS), "one_case_letters": _chance(_LOWER)}
#: What stands just before a candidate, is all of it, or stands in a window, that marks it as no secret.
ALLOW_BEFORE = re.compile(r"(?<![A-Za-z0-9])(?:sha-?\d{1,3}|md5|crc32|checksum|digest|integrity|etag|commit|rev|base64)\W{0,3}$", re.I)
ALLOW_WITHIN = re.compile(r"example|sample|placeholder|changeme|your[_-]|xxxx|0000000|1234567|abcdefg", re.I)
# Keys of public documentation.
ALLOW_KEYS = {"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "je7MtGbClwBF/2Zp9Utk/h3yCo8nvbEXAMPLEKEY"}
ALLOW_WHOLE = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind, without those too short."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def window_entropies(run: str, window: int):
    """Bits a character of each window of ``run``, one step costing two count updates."""
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    gain = [b - a for a, b in zip(term, term[1:])]
    codes, counts, whole = run.encode("ascii"), [0] * 128, math.log2(window)
    for c in codes[:window]:
        counts[c] += 1
    total = sum(term[c] for c in counts)
    yield whole - total / window
    for old, new in zip(codes, codes[window:]):
        if new != old:
            n = counts[new]
            counts[new] = n + 1
            counts[old] = k = counts[old] - 1
            total += gain[n] - gain[k]
        yield whole - total / window


def _sums(values) -> list:
    return [0, *accumulate(values)]


class Candidate:
    """Counts over a candidate string, so that what any window holds is known at once."""

    def __init__(self, word: str):
        self.word = word
        kinds = word.translate(_TO_KIND)
        self.held = {"d": _sums(k == "d" for k in kinds), "l": _sums(k in "vc" for k in kinds), "u": _sums(k in "VC" for k in kinds)}
        self.kinds, self._chance = kinds, {}

    def holds(self, need: str, a: int, b: int) -> bool:
        if need == "a":
            return self.held["l"][b] > self.held["l"][a] or self.held["u"][b] > self.held["u"][a]
        return self.held[need][b] > self.held[need][a]

    def chance(self, name: str, a: int, b: int) -> float:
        """Bits by which the changes from ``a`` to ``b`` speak for chance; a window of one case says nothing by its case."""
        if not self.holds("l", a, b) or not self.holds("u", a, b):
            name = "one_case" if self.holds("d", a, b) else "one_case_letters"
        spare = 6.0 if name == "one_case_letters" else 0.0  # compound words come near to chance
        sums = self._chance.get(name)
        if sums is None:
            kinds = self.kinds.lower() if name.startswith("one_case") else self.kinds
            bits = _BITS[name]
            sums = self._chance[name] = _sums(bits[x] for x in map("".join, zip(kinds, kinds[1:])))
        return sums[b - 1] - sums[a] - spare


class Taken:
    """Spans of several kinds, those of a kind apart from each other and in order."""

    def __init__(self):
        self.kinds: list[tuple[list[int], list[int]]] = []

    def open(self) -> None:
        self.kinds.append(([], []))

    def add(self, start: int, end: int) -> None:
        self.kinds[-1][0].append(start)
        self.kinds[-1][1].append(end)

    def covers(self, start: int, end: int) -> bool:
        """Whether one span holds all of it."""
        return any(ends and (k := bisect_right(starts, start)) and ends[k - 1] >= end for starts, ends in self.kinds)


def entropy_spans(text: str, window: int = 20) -> list[tuple[int, int, str]]:
    found = []
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        if word in ALLOW_KEYS or ALLOW_WHOLE.fullmatch(word) or ALLOW_BEFORE.search(text, max(0, m.start() - 16), m.start()):
            continue
        near = bytearray(len(word))  # starts of windows that a placeholder suppresses
        for p in ALLOW_WITHIN.finditer(word):
            before, after = (re.match(r"[A-Za-z0-9]*", x).end() for x in (word[max(0, p.start() - window) : p.start()][::-1], word[p.end() : p.end() + window]))
            lo, hi = max(0, p.start() - before - window + 1), p.end() + after
            near[lo:hi] = b"\x01" * (hi - lo)
        counts, taken = Candidate(word), Taken()
        for kind, pattern, least, needs, unlike in CLASSES:
            spans: list[list[int]] = []
            for run in pattern.finditer(word):
                if taken.covers(*run.span()):
                    continue
                for a, bits in enumerate(window_entropies(run.group(), window), run.start()):
                    b = a + window
                    if bits > least and not near[a] and all(counts.holds(n, a, b) for n in needs) and (unlike is None or counts.chance(kind, a, b) >= unlike):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = b
                        else:
                            spans.append([a, b])
            spans = [x for x in spans if not taken.covers(*x)]
            taken.open()
            for a, b in spans:
                taken.add(a, b)
                found.append((m.start() + a, m.start() + b, kind))
    return found


def all_spans(text: str, window: int = 20) -> tuple[list, list]:
    """(base spans, base and entropy spans), both by start, then kind."""
    base, taken = base_spans(text), Taken()
    for kind in KINDS[:3]:
        taken.open()
        for start, end, k in base:
            if k == kind:
                taken.add(start, end)
    extra = [x for x in entropy_spans(text, window) if not taken.covers(*x[:2])]
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, window: int = 20) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    ddl = "doc_id long,n_assign long,n_access long,n_hex long,n_entropy long,base_sha256 string,spans string"
    schema = ddl_schema(ddl)

    def scan(batches):
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                base, every = all_spans(text or "", window)
                n = Counter(s[2] for s in every)
                rows.append((doc, n["assign"], n["access"], n["hex"], sum(n[k] for k in KINDS if k.startswith("entropy_")), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield table(schema, zip(*rows, strict=True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, ddl)


def redact(docs: DataFrame, window: int = 20, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans get one mark."""
    import pyarrow as pa

    at = docs.columns.index("text")

    def clean(batches):
        for part in slices(batches):
            texts = []
            for text in part.column(at).to_pylist():
                out, last = [], 0
                for s, e, _ in all_spans(text or "", window)[1]:
                    if s >= last:
                        out += [text[last:s], mark]
                    last = max(last, e)
                texts.append(text if text is None else "".join([*out, text[last:]]))
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
