"""Edits of minutes as their readers saw them, brought back to the form that is stored.

Stored texts name speakers by tokens (S2, Speaker 2); readers see names in their place, or anonymous labels. What comes
back from an editor is compared with what was shown: untouched fields keep their stored text, and in touched ones
the names become tokens again. Which name stands for which number is learnt from the fields themselves: a
stored text and its shown form agree but where the tokens are. A name that stood for two numbers in a
meeting is ambiguous and stays as typed.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions import arrow
from confab.functions.arrow import function

_IN_WORD = r"[\p{L}\p{N}\p{M}_]"
#: Labels, alone in a text or in place of a name, with their number.
_TOKEN = regex.compile(rf"(?<!{_IN_WORD})(?:S|Speaker )(?P<n>\d{{1,2}})(?!{_IN_WORD})")
#: What an unnamed speaker is called in the three languages.
ANONYMOUS = ("Vorbitorul", "Участник", "Speaker")
_ANONYMOUS = rf"(?<!{_IN_WORD})(?:{'|'.join(ANONYMOUS)}) (?P<n>\d{{1,2}})(?!{_IN_WORD})"
_LABEL = regex.compile(rf"{_ANONYMOUS}|{_TOKEN.pattern.replace('?P<n>', '?P<m>')}")
MOST_TOKENS = 12


def learnt(stored: str | None, shown: str | None) -> list[tuple[str, int]]:
    """(name, number) of each token of ``stored`` that ``shown`` has a name in place of; none if the rest differs.

    What stands between two tokens is looked for from left to right, each name being as short as what
    follows allows. How far to the right a name may begin, so that the rest still finds its place, is known
    from one pass from the right, so nothing is tried twice."""
    if not stored or not shown:
        return []
    tokens = list(_TOKEN.finditer(stored))
    if not 0 < len(tokens) <= MOST_TOKENS:
        return []
    edges = [0, *(x for m in tokens for x in m.span()), len(stored)]
    first, *follows = (stored[a:b] for a, b in zip(edges[::2], edges[1::2]))
    if not shown.startswith(first) or not shown.endswith(follows[-1]):
        return []
    # the last name ends before what ends the text; each name before it where what follows fits before the next one's latest begin
    latest = [len(shown) - len(follows[-1]) - 1]
    for text in reversed(follows[:-1]):
        latest.append(shown.rfind(text, 0, max(latest[-1], 0)) - 1)
    latest.reverse()
    at, out = len(first), []
    if min(latest) < 0 or at > latest[0]:
        return []
    for k, m in enumerate(tokens):
        end = len(shown) - len(follows[k]) if k + 1 == len(tokens) else shown.find(follows[k], at + 1)
        name = shown[at:end].strip()
        if name and not _LABEL.fullmatch(name):
            out.append((name, int(m["n"])))
        at = end + len(follows[k])
    return out


@functools.lru_cache(4096)
def _names_pattern(names: tuple[str, ...]):
    some = "|".join(regex.escape(n) for n in sorted(names, key=len, reverse=True))
    return regex.compile(_ANONYMOUS + (rf"|(?<!{_IN_WORD})(?P<name>{some})(?!{_IN_WORD})" if names else "|(?P<name>(?!))"))


def unrendered(text: str, kind: str, names: dict[str, int]) -> str:
    """A touched text with tokens for names: anywhere in prose, as a whole in a field that holds one speaker."""
    if kind == "prose":
        return _names_pattern(tuple(names)).sub(lambda m: f"S{int(m['n']) if m['n'] else names[m['name']]}", text)
    n = names.get(text.strip()) if kind == "speaker" else None
    return text if n is None else f"Speaker {n}"


@function("array<struct<name:string,n:int>>")
def _learnt(stored: pa.Array, shown: pa.Array) -> pa.Array:
    rows = [[{"name": x, "n": n} for v in views or [] for x, n in learnt(s, v)] for s, views in zip(stored.to_pylist(), shown.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([("name", pa.string()), ("n", pa.int32())])))


@function("string")
def _unrendered(texts: pa.Array, kinds: pa.Array, names: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), kinds.to_pylist(), names.to_pylist(), strict=True)
    return pa.array([None if t is None else unrendered(t, k, dict(m or [])) for t, k, m in rows], pa.string())


def learnt_names(fields: DataFrame) -> DataFrame:
    """Per meeting a map from name to number, of names that stood for one number only."""
    each = arrow.dealt(fields).select("meeting_id", F.explode(_learnt("stored", "shown")).alias("x")).select("meeting_id", "x.name", "x.n").distinct()
    one = each.groupBy("meeting_id", "name").agg(F.count("*").alias("numbers"), F.min("n").alias("n")).where("numbers = 1")
    return one.groupBy("meeting_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("names"))


def rebased(fields: DataFrame) -> DataFrame:
    """``fields`` (meeting_id, field, kind, stored, shown, edited) with the ``text`` to store.

    ``shown`` are the views that the editor may have begun from; ``kind`` is prose, speaker (an owner or a label that was
    rendered as one speaker) or other, which has no names. A new field has no stored text. Fields are brought
    together by meeting only as their names, which a meeting's speakers bound."""
    both = fields.join(learnt_names(fields), "meeting_id", "left")
    untouched = F.col("stored").isNotNull() & F.coalesce(F.array_contains("shown", F.col("edited")), F.lit(False))
    text = F.when(untouched, F.col("stored")).otherwise(_unrendered("edited", "kind", "names"))
    return both.withColumn("text", text).drop("names")
