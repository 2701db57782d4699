"""Arrow functions for what built-ins cannot say: decomposition of characters, edit counts,
matching blocks and rule-driven rewriting. Each takes a batch of rows, and each row alone.
"""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .words import NEGATIONS


def function(ddl: str):
    """An Arrow function of the given type, made at its first use: making one needs a session."""

    def wrap(f):
        made = []

        @functools.wraps(f)
        def call(*columns):
            if not made:
                made.append(F.arrow_udf(f, ddl))
            return made[0](*columns)

        return call

    return wrap


def dealt(df):
    """``df`` over as many partitions as there are cores, if the planner's estimate says that its files would
    make fewer: a single file's rows would all be one Python task's. Nothing is run to find out."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB") or 0)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if estimate < cores * split else df


_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*")
#: Numbers with a unit of dose.
DOSE = re.compile(r"\d+(?:[.,]\d+)?\s*(?:mg|mcg|ml|g|kg|ui|mmol|mmhg|%|мг|мкг|мл|г|кг|ед)(?!\w)|\d", re.I)


def base_form(text: str | None) -> str:
    """Without marks, case folded, one space between words. Null is empty."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return " ".join(plain.casefold().split())


def bare_form(text: str | None) -> str:
    """As ``base_form``, with punctuation as spaces."""
    return " ".join(re.sub(r"[^\w\s]", " ", base_form(text)).split())


@function("string")
def base_text(texts: pa.Array) -> pa.Array:
    return pa.array([base_form(t) for t in texts.to_pylist()], pa.string())


@function("string")
def bare_text(texts: pa.Array) -> pa.Array:
    return pa.array([bare_form(t) for t in texts.to_pylist()], pa.string())


@function("string")
def composed(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFC")


_TOTAL, _DELETED = 42, 21  # bits of a cell: substitutions, then deletions, then the total


def edit_counts(reference: list, hypothesis: list) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a cheapest edit; of equally cheap steps at a
    cell, substitution comes before deletion and deletion before insertion.

    Cells of a diagonal depend on the two diagonals before it only, so each is one pass of numpy,
    and a cell holds its three counts in one integer. An edit of cost t stays within t cells of
    the main diagonal, so a band is searched that doubles until it holds the edit it finds:
    texts that are alike cost their length times their edits. Equal tokens at the end cost nothing
    and are cut first; those at the start are not, as they can change which edit is found."""
    n, m = len(reference), len(hypothesis)
    while n and m and reference[n - 1] == hypothesis[m - 1]:
        n, m = n - 1, m - 1
    if not n or not m:
        return 0, n, m
    codes: dict = {}
    ref = np.array([codes.setdefault(x, len(codes)) for x in reference[:n]], np.int32)
    hyp = np.array([codes.setdefault(x, len(codes)) for x in hypothesis[:m]], np.int32)[::-1].copy()
    band = max(abs(n - m), 16)
    while True:
        total = _banded(ref, hyp, n, m, band)
        if total >> _TOTAL <= band or band >= max(n, m):
            break
        band *= 2
    mask = (1 << _DELETED) - 1
    s, d = total & mask, total >> _DELETED & mask
    return s, d, (total >> _TOTAL) - s - d


def _banded(ref: np.ndarray, hyp: np.ndarray, n: int, m: int, band: int) -> int:
    """The last cell of the edit table, from cells at most ``band`` off the main diagonal; ``hyp`` is reversed."""
    substitute, delete, insert, never = (1 << _TOTAL) + 1, (1 << _TOTAL) + (1 << _DELETED), 1 << _TOTAL, 1 << 62
    older, old, new = (np.full(n + 2, never, np.int64) for _ in range(3))
    old[0] = 0
    for k in range(1, n + m + 1):
        lo, hi = max(1, k - m, (k - band + 1) // 2), min(n, k - 1, (k + band) // 2)
        # cells beside the band, which the next diagonals read
        new[max(0, lo - 1)] = new[max(0, hi + 1)] = never
        if lo <= hi:
            best = older[lo - 1 : hi]
            same = ref[lo - 1 : hi] == hyp[m - k + lo : m - k + hi + 1]
            cell = best + substitute
            for other in (old[lo - 1 : hi] + delete, old[lo : hi + 1] + insert):
                cell = np.where(other >> _TOTAL < cell >> _TOTAL, other, cell)
            new[lo : hi + 1] = np.where(same, best, cell)
        if k <= band:
            new[0] = k * insert if k <= m else never
            if k <= n:
                new[k] = k * delete
        else:
            new[0] = never
        older, old, new = old, new, older
    return int(old[n])


EDITS = "struct<substitutions:bigint,deletions:bigint,insertions:bigint>"


@function(EDITS)
def token_edits(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Edit counts of two arrays of tokens; null arrays are empty."""
    names = ("substitutions", "deletions", "insertions")
    rows = [dict(zip(names, edit_counts(r or [], h or []), strict=True)) for r, h in zip(reference.to_pylist(), hypothesis.to_pylist(), strict=True)]
    return pa.array(rows, pa.struct([(n, pa.int64()) for n in names]))


def matching_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@function("double")
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratio of matching blocks of two texts, 0 to 1; nulls are empty."""
    return pa.array([matching_ratio(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def phrase_change(before: str | None, after: str | None, most: int = 3) -> dict | None:
    """The one phrase of at most ``most`` words that differs between two texts, with what
    speaks against learning from it; null where the texts differ in any other way."""
    a, b = _WORD.findall(before or ""), _WORD.findall(after or "")
    blocks = difflib.SequenceMatcher(None, [w.lower() for w in a], [w.lower() for w in b]).get_opcodes()
    changed = [x for x in blocks if x[0] != "equal"]
    if not a or not b or len(changed) != 1 or changed[0][0] != "replace":
        return None
    _, i, j, k, l = changed[0]
    if j - i > most or l - k > most:
        return None
    variant, canonical = " ".join(a[i:j]), " ".join(b[k:l])
    negations = {w for ws in NEGATIONS.values() for w in ws}
    near = {w.lower() for w in a[max(0, i - 3) : j]}
    flags = []
    if any(c.isdigit() for c in variant + canonical):
        flags.append("contains_digits")
    if DOSE.search(before) or DOSE.search(after):
        flags.append("dosage_or_units_present")
    if near & negations:
        flags.append("adjacent_negation")
    return {"variant": variant, "canonical": canonical, "is_safe": not flags, "flags": flags}


PHRASE = "struct<variant:string,canonical:string,is_safe:boolean,flags:array<string>>"


@function(PHRASE)
def single_phrase(before: pa.Array, after: pa.Array) -> pa.Array:
    kind = pa.struct([("variant", pa.string()), ("canonical", pa.string()), ("is_safe", pa.bool_()), ("flags", pa.list_(pa.string()))])
    return pa.array([phrase_change(x, y) for x, y in zip(before.to_pylist(), after.to_pylist(), strict=True)], kind)
