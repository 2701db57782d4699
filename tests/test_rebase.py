"""Edited minutes come back as tokens, against a plain alignment by a pattern."""

import random

import pytest
import regex

from confab.operators import rebase


def by_pattern(stored, shown):
    """Names as the shortest groups between the literal parts."""
    tokens = list(rebase._TOKEN.finditer(stored))
    edges = [0, *(x for m in tokens for x in m.span()), len(stored)]
    m = regex.fullmatch("(.+?)".join(regex.escape(stored[a:b]) for a, b in zip(edges[::2], edges[1::2])), shown, regex.S)
    if not m or not tokens:
        return []
    return [(n.strip(), int(t["n"])) for n, t in zip(m.groups(), tokens) if n.strip() and not rebase._LABEL.fullmatch(n.strip())]


@pytest.mark.parametrize("seed", range(5))
def test_names_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        stored = "".join(rng.choice(["S1", "S2", "Speaker 3", " ", " a ", "b", "ab ", ", ", "\n"]) for _ in range(rng.randint(1, 9)))
        shown = rebase._TOKEN.sub(lambda m: rng.choice(["Ana", "Ana b", "a", "Speaker 1", "Dr. X, MD", " "]), stored)
        if rng.random() < 0.2:
            shown += rng.choice(["a", " b", "Ana"])
        assert rebase.learnt(stored, shown) == by_pattern(stored, shown)


def test_texts_that_nearly_agree_are_quick():
    assert rebase.learnt("S1 a " * 12, "x a " * 5000 + "b") == [] and rebase.learnt("S1 " * 13, "Ana " * 13) == []


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("Ana Pop și Ana merg", "prose", "S2 și S1 merg"), ("Anabela, bAna, Ana.", "prose", "Anabela, bAna, S1."), ("Vorbitorul 3, Участник 12 și Speaker 4", "prose", "S3, S12 și S4"),
        (" Ana Pop ", "speaker", "Speaker 2"), ("Ana și Pop", "speaker", "Ana și Pop"), ("Ana", "other", "Ana"), ("Anaș Aná", "prose", "Anaș Aná"), ("", "prose", ""),
    ],
)
def test_touched_texts(text, kind, want):
    assert rebase.unrendered(text, kind, {"Ana": 1, "Ana Pop": 2}) == want


def test_rebased_fields(spark):
    rows = [
        (1, "a", "prose", "S1 propune", ["Ana propune", None], "Ana propune"), (1, "b", "prose", "S2 refuză", ["Ion refuză"], "Ion și Ana refuză"), (1, "c", "speaker", "Speaker 1", ["Ana"], "Ion"),
        (1, "d", "prose", None, [], "nou: Ana"), (1, "e", "prose", "x", None, None), (2, "a", "prose", "S1 cu S2", ["Ana cu Ana"], "doar Ana"), (2, "b", "prose", "S3 vine", ["Ion vine"], "Ion, Ana vin"), (3, "a", "prose", None, None, "Ana"),
    ]
    fields = spark.createDataFrame(rows, "meeting_id long, field string, kind string, stored string, shown array<string>, edited string")
    got = {(r.meeting_id, r.field): r.text for r in rebase.rebased(fields).collect()}
    assert got == {(1, "a"): "S1 propune", (1, "b"): "S2 și S1 refuză", (1, "c"): "Speaker 2", (1, "d"): "nou: S1", (1, "e"): None, (2, "a"): "doar Ana", (2, "b"): "S3, Ana vin", (3, "a"): "Ana"}
    assert rebase.rebased(fields.limit(0)).collect() == []
