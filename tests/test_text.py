"""Text, vector and Arrow functions against worked examples and properties."""

import difflib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from confab.functions import arrow, signal
from confab.functions import text as T
from confab.functions import vectors as V
from confab.operators import learning


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, language, confidence",
    [
        ("12.5 / 80 - 120", "und", 1.0),
        ("propofol midazolam fentanil", "und", 0.0),
        (None, "und", 1.0),
        ("", "und", 1.0),
        ("это давай решим", "ru", 1.0),
        ("este și sunt", "ro", 1.0),
        ("the and is are", "en", 1.0),
    ],
)
def test_text_language(spark, text, language, confidence):
    got = one(spark, T.text_language(F.lit(text).cast("string")))
    assert (got.language, got.confidence) == (language, confidence)


def test_mixed_text(spark):
    got = one(spark, T.text_language(F.lit("Pacientul din salonul trei, давай решим перевод сегодня, după consult.")))
    assert got.language == "mixed" and got.confidence >= 0.5


def test_word_languages(spark):
    got = {w: one(spark, T.word_language(F.lit(w))) for w in ("давай", "este", "the", "Ședință", "propofol", "aб", "12")}
    assert got == {"давай": "ru", "este": "ro", "the": "en", "Ședință": "ro", "propofol": None, "aб": None, "12": None}


def test_restricted_probabilities(spark):
    probs = F.create_map(F.lit("ru"), F.lit(0.6), F.lit("uk"), F.lit(0.2), F.lit("ro"), F.lit(0.2))
    assert [(x.language, round(x.p, 6)) for x in one(spark, T.restricted_probabilities(probs, ["ro", "ru", "en"]))] == [("ru", 0.75), ("ro", 0.25), ("en", 0.0)]
    none = one(spark, T.restricted_probabilities(F.create_map(F.lit("uk"), F.lit(1.0)), ["ro", "ru"]))
    assert [(x.language, x.p) for x in none] == [("ro", 0.5), ("ru", 0.5)]


def test_scoring_form(spark):
    assert one(spark, T.scoring_form(F.lit("Ședință medicală: pacientul are febră?"))) == "ședință medicală pacientul are febră"
    assert one(spark, T.scoring_form(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    "phrase, day",
    [("până luni", "2026-09-28"), ("by Friday", "2026-09-25"), ("poimâine", "2026-09-25"), ("mâine", "2026-09-24"), ("la sfârșitul lunii", "2026-09-30"), ("luni săptămâna viitoare", "2026-09-28"), ("săptămâna viitoare", "2026-09-30"), ("до среды", "2026-09-30"), ("cândva", None)],
)
def test_relative_deadline(spark, phrase, day):
    got = one(spark, T.relative_deadline(F.lit(phrase), F.lit("2026-09-23").cast("date")))
    assert (str(got) if got else None) == day


def test_transliteration(spark):
    assert one(spark, T.cyrillic_to_latin(F.lit("Щукина Юлия"))) == "Shchukina Yuliya"
    assert one(spark, T.latin_to_cyrillic(F.lit("Popov"))) == "Попов"
    assert one(spark, T.latin_to_cyrillic(F.lit("zhukova"))) == "жукова"


def test_keywords(spark):
    assert one(spark, T.keyword_list(F.lit("Raport despre Stent și stent, ședință 12 Cardio"))) == ["Stent", "Cardio"]


def test_labels_and_clocks(spark):
    assert one(spark, T.clock(F.lit(3725.9))) == "62:05"
    assert one(spark, T.clock_interval(F.lit(5.0), F.lit(65.0))) == "00:05-01:05"
    assert one(spark, T.cluster_label(F.lit("SPEAKER_02"))) == "Speaker 2"
    assert one(spark, T.localized_label(F.lit("Speaker 2"), "ru")) == "Участник 2"
    assert one(spark, T.truncated(F.lit("abcdef"), 4)) == "abc…" and one(spark, T.truncated(F.lit("abcd"), 4)) == "abcd"
    assert one(spark, T.first_filled(F.lit(""), F.lit("b"))) == "b"
    assert one(spark, T.fallback_translation(F.lit("x"), "ru")) == "[RU] x"
    assert T.chunk_budget(4096, 1100, 900, 2300) == 2096 and T.chunk_budget(1000, 900, 90, 2300) == 256
    assert one(spark, T.valid_opaque_id(F.lit("../x"))) is False
    assert one(spark, T.space_id(F.lit("m"), F.lit("0123456789abcdef"))) == "m@0123456789ab"


def test_entities_and_negations(spark):
    assert one(spark, T.entity_hit(F.lit("Stent"), F.lit("un stent, apoi"))) and not one(spark, T.entity_hit(F.lit("Stent"), F.lit("stenturi")))
    assert one(spark, T.negation_dropped(F.lit("nu merge"), F.lit("merge"), F.lit("ro")))
    assert not one(spark, T.negation_dropped(F.lit("nu merge"), F.lit("merge"), F.lit("en")))
    assert one(spark, T.negation_dropped(F.lit("nu merge"), F.lit("merge"), F.lit("mixed")))


# --- edits ----------------------------------------------------------------------------


@pytest.mark.parametrize("a, b, want", [("unu doi", "unu doi", (0, 0, 0)), ("unu doi", "unu trei", (1, 0, 0)), ("unu doi", "unu", (0, 1, 0)), ("unu doi", "unu doi trei", (0, 0, 1)), ("", "a b", (0, 0, 2)), ("a b", "", (0, 2, 0))])
def test_edit_counts(a, b, want):
    assert arrow.edit_counts(a.split(), b.split()) == want


def brute_edits(a, b):
    best = {(0, 0): (0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j and a[i - 1] == b[j - 1]:
                best[i, j] = best[i - 1, j - 1]
                continue
            ways = []
            if i and j:
                s, d, n = best[i - 1, j - 1]
                ways.append((s + 1, d, n))
            if i:
                s, d, n = best[i - 1, j]
                ways.append((s, d + 1, n))
            if j:
                s, d, n = best[i, j - 1]
                ways.append((s, d, n + 1))
            if ways:
                best[i, j] = min(ways, key=sum)
    return best[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_counts_by_brute_force(a, b):
    got = arrow.edit_counts(a, b)
    assert got == brute_edits(a, b)
    assert len(a) - got[1] + got[2] == len(b)


def test_character_error(spark):
    chars = lambda w: F.split(F.lit(w), "")
    assert tuple(one(spark, arrow.token_edits(chars("medwark"), chars("metwark")))) == (1, 0, 0)


def test_base_forms():
    assert arrow.base_form(" Ședință  ÎN ") == "sedinta in" and arrow.bare_form("L-a, făcut!") == "l a facut" and arrow.base_form(None) == ""


def test_phrase_change():
    assert arrow.phrase_change("la bolniță azi", "la spital azi") == {"variant": "bolniță", "canonical": "spital", "is_safe": True, "flags": []}
    assert arrow.phrase_change("la bolniță azi", "un bolniță mare") is None
    assert arrow.phrase_change("a b", "a b c") is None
    assert arrow.phrase_change("dă 50 mg bolniță", "dă 50 mg spital")["flags"] == ["dosage_or_units_present"]
    assert arrow.phrase_change("nu e bolniță", "nu e spital")["flags"] == ["adjacent_negation"]
    assert arrow.phrase_change(None, "x") is None


# --- rules ----------------------------------------------------------------------------


def rule(rule_id, variants, canonical, language="ro", action="safe_replace", approval="approved"):
    return {"rule_id": rule_id, "language": language, "variants": variants, "canonical": canonical, "action": action, "approval": approval}


POLI = [rule("p", ["policlinică", "policlinica"], "ambulatoriu")]


def test_rules_replace_and_keep_case():
    got = learning.rewrite("trimis la Policlinică azi", "ro", POLI)
    assert got["text"] == "trimis la Ambulatoriu azi" and got["corrections"][0]["start"] == 10


@pytest.mark.parametrize("text, reason", [("nu merge la policlinică", "blocked_by_adjacent_negation"), ("10 mg policlinica", "blocked_by_dosage_or_units")])
def test_rules_suggest_near_negations_and_doses(text, reason):
    got = learning.rewrite(text, "ro", POLI)
    assert got["text"] == text and [s["reason"] for s in got["suggestions"]] == [reason]


def test_rules_longest_first_without_cascade():
    rules = [rule("a", ["spital"], "clinică"), rule("b", ["spital vechi municipal"], "spital nou"), rule("c", ["nou"], "x")]
    assert learning.rewrite("un spital vechi municipal", "ro", rules)["text"] == "un spital nou"
    assert learning.rewrite("policlinica23", "ro", POLI) == {"text": "policlinica23", "corrections": [], "suggestions": []}
    mixed = [rule("m", ["obhod"], "vizită", language="mixed")]
    assert learning.rewrite("la obhod", "ro", mixed)["suggestions"][0]["reason"] == "unvalidated_mixed_language_span"
    assert learning.rewrite("la obhod", "mixed", mixed)["text"] == "la vizită"
    assert learning.rewrite(None, "ro", POLI)["text"] is None


def test_lexicon():
    lexicon = [{"canonical": "noradrenalină", "variants": ["noradrenalina", "nor adrenalină"], "languages": ["ro"], "fuzzy": False}, {"canonical": "Ambulatorix", "variants": [], "languages": ["ro"], "fuzzy": True}]
    got = learning.lexicon_fix("Am dat noradrenalina, la Ambulatorik și noradrenalina2", "ro", lexicon)
    assert got["text"] == "Am dat noradrenalină, la Ambulatorix și noradrenalina2"
    assert [c["score"] for c in got["corrections"]] == [1.0, round(difflib.SequenceMatcher(None, "ambulatorik", "ambulatorix").ratio(), 3)]
    assert learning.lexicon_fix("noradrenalina", "mixed", lexicon)["text"] == "noradrenalina"


# --- vectors and signals --------------------------------------------------------------


def test_cosine_and_fusion(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(-1.0))
    assert one(spark, V.cosine(a, b)) == 0.0 and one(spark, V.cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    sims = F.array(*[F.lit(x) for x in (0.9, 0.5, 0.7, 0.1)])
    assert one(spark, V.fused_score(F.lit(0.6), sims)) == pytest.approx(0.5 * 0.9 + 0.3 * 0.6 + 0.2 * 0.7)
    assert one(spark, V.fused_score(F.lit(0.95), sims)) == 0.95
    assert one(spark, V.fused_score(F.lit(0.4), F.array().cast("array<double>"))) == 0.4
    assert [one(spark, V.band(F.lit(x))) for x in (0.8, 0.65, 0.5, 0.49)] == ["strong", "moderate", "weak", "no_match"]


@pytest.mark.parametrize("close", [0.6, 0.8, 0.9])
def test_nearest_entries_by_brute_force(close):
    """The index of pairs of letters misses no entry that is close enough, and the first of the best is taken."""
    import random

    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcș") for _ in range(k))
    entries = [{"canonical": word(rng.randint(1, 12)), "variants": [], "languages": ["ro"], "fuzzy": True} for _ in range(120)]
    lexicon = learning.Lexicon(entries, close)
    for _ in range(300):
        w = word(rng.randint(1, 12)) if rng.random() < 0.5 else "".join(c for c in rng.choice(entries)["canonical"] if rng.random() < 0.9)
        best = max(((arrow.matching_ratio(w, e["canonical"]), -k) for k, e in enumerate(entries)), default=None)
        want = (entries[-best[1]]["canonical"], best[0]) if best[0] >= close else None
        assert lexicon.nearest(w, "ro") == want


def test_log_mel(spark):
    x = np.sin(np.arange(16_000) * 2 * np.pi * 1000 / 16_000)
    out = signal.log_mel(x)
    assert out.shape == (98, 80) and np.allclose(out.mean(axis=0), 0)
    low, high = signal.mel_bank(80, 512, 16_000, 20.0, 8000.0), signal.mel(1000.0)
    assert low.shape == (257, 80) and (low >= 0).all() and high == pytest.approx(1000, rel=0.01)
    assert signal.log_mel(np.zeros(10)).shape == (0, 80)
    assert one(spark, signal.filter_bank(F.array(F.lit(0.0)))) == []
