"""Text functions as Column expressions: all run in the JVM, none in Python.

Null texts give null unless a function says otherwise; empty texts are ordinary input.
Letters are Unicode letters, so patterns spell them ``\\p{L}``: Java's ``\\w`` knows ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import AMBIGUOUS, DAYS, ENGLISH, KEYWORD_STOPWORDS, LATIN_DIGRAPHS, LATIN_LETTERS, NEGATIONS, ROMANIAN, SUMMARY_LANGUAGES, TRANSLITERATION

CYRILLIC, LATIN = "[Ѐ-ӿ]", "[A-Za-zÀ-ɏ]"
DIACRITICS = "[ăâîșțĂÂÎȘȚşţŞŢ]"
WORD = r"\p{L}+(?:[-']\p{L}+)*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text, pattern: str = WORD) -> Column:
    """Lower-cased matches of ``pattern``, in order."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)), lambda w: F.lower(w))


def hits(tokens: Column, known) -> Column:
    """How many of ``tokens`` are in the fixed list ``known``."""
    return F.size(F.filter(tokens, lambda w: w.isin(*sorted(known))))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


# --- languages ------------------------------------------------------------------------


def text_language(text, ru_min: float = 0.60, mixed_min: float = 0.15, diacritic_weight: float = 2.0) -> Column:
    """struct(language, confidence, cyrillic_ratio, ro_score, en_score, letters) of a text, by
    script first, then by function words with Romanian diacritics counted twice. Null is
    empty: ``und`` with confidence 1, as for any text without letters."""
    t = F.coalesce(_col(text), F.lit(""))
    counts = F.struct(F.regexp_count(t, F.lit(CYRILLIC)).alias("cyr"), F.regexp_count(t, F.lit(LATIN)).alias("lat"), F.regexp_count(t, F.lit(DIACRITICS)).alias("marks"), words(t).alias("words"))
    known = [sorted(set(w) - AMBIGUOUS) for w in (ROMANIAN, ENGLISH)]

    def scored(c: Column) -> Column:
        letters = c["cyr"] + c["lat"]
        ratio = F.when(letters > 0, c["cyr"] / letters).otherwise(F.lit(0.0))
        ro, en = (F.when(ratio < mixed_min, hits(c["words"], w).cast("double")).otherwise(F.lit(0.0)) for w in known)
        return F.struct(letters.alias("letters"), ratio.alias("ratio"), (ro + F.when(ratio < mixed_min, diacritic_weight * c["marks"]).otherwise(F.lit(0.0))).alias("ro"), en.alias("en"))

    def judged(c: Column) -> Column:
        letters, ratio, ro, en = c["letters"], c["ratio"], c["ro"], c["en"]
        total = ro + en
        middle, half = (ru_min + mixed_min) / 2, (ru_min - mixed_min) / 2
        balance = 1.0 - F.abs(ratio - middle) / half
        by_words = F.abs(ro - en) / total * (0.5 + 0.5 * F.least(F.lit(1.0), total / 4.0))
        language = F.when(letters == 0, "und").when(ratio > ru_min, "ru").when(ratio >= mixed_min, "mixed").when(total == 0, "und").when(ro >= en, "ro").otherwise("en")
        confidence = F.when(letters == 0, 1.0).when(ratio > ru_min, F.least(F.lit(1.0), 0.5 + ratio / 2)).when(ratio >= mixed_min, F.greatest(F.lit(0.5), F.least(F.lit(1.0), 0.5 + balance / 2))).when(total == 0, 0.0).otherwise(by_words)
        return F.struct(language.alias("language"), F.round(confidence, 3).alias("confidence"), ratio.alias("cyrillic_ratio"), ro.alias("ro_score"), en.alias("en_score"), letters.cast("long").alias("letters"))

    return bound(bound(counts, scored), judged)


def word_language(word) -> Column:
    """ru, ro or en, or null where a single word tells nothing."""
    w = _col(word)
    cyr, lat = w.rlike(CYRILLIC), w.rlike(LATIN)
    low = F.lower(w)
    return F.when(cyr & ~lat, "ru").when(cyr | ~lat, F.lit(None)).when(w.rlike(DIACRITICS) | low.isin(*sorted(set(ROMANIAN) - AMBIGUOUS)), "ro").when(low.isin(*sorted(set(ENGLISH) - AMBIGUOUS)), "en")


def restricted_probabilities(probs, allowed: list[str]) -> Column:
    """Of a map language -> probability, the allowed ones renormalised, best first (as an
    array of structs); all equal where none has any."""
    picked = F.array(*[F.struct(F.coalesce(F.element_at(_col(probs), F.lit(x)), F.lit(0.0)).alias("p"), F.lit(-k).alias("k"), F.lit(x).alias("language")) for k, x in enumerate(allowed)])
    total = F.aggregate(picked, F.lit(0.0), lambda a, x: a + x["p"])
    share = F.transform(picked, lambda x: F.struct(F.when(total > 0, x["p"] / total).otherwise(1.0 / len(allowed)).alias("p"), x["k"].alias("k"), x["language"].alias("language")))
    return F.transform(F.reverse(F.array_sort(share)), lambda x: F.struct(x["language"].alias("language"), x["p"].alias("p")))


# --- scoring --------------------------------------------------------------------------


def scoring_form(text) -> Column:
    """Lower case, listed punctuation as spaces, one space between words; diacritics stay.
    Null is empty. Input is taken to be in composed form (NFC)."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[.,;:!?\"'“”«»()\\[\\]{}]", " "), r"\s+", " "))


def scoring_words(text) -> Column:
    return F.filter(F.split(scoring_form(text), " "), lambda w: w != "")


def negation_dropped(reference, hypothesis, language) -> Column:
    """A negation of the language (of any, where it is not ro, ru or en) is in the reference and none in the hypothesis."""
    every = sorted({w for ws in NEGATIONS.values() for w in ws})

    def holds(text):
        tokens = scoring_words(text)
        out = F.exists(tokens, lambda w: w.isin(*every))
        for lang, own in NEGATIONS.items():
            out = F.when(F.lower(_col(language)) == lang, hits(tokens, own) > 0).otherwise(out)
        return out

    return holds(reference) & ~holds(hypothesis)


def entity_hit(term, hypothesis) -> Column:
    """The normalised term stands in the normalised hypothesis between word boundaries."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), scoring_form(term), F.lit(r"\E(?!\w)"))
    return (scoring_form(term) != "") & F.rlike(scoring_form(hypothesis), quoted)


# --- context terms --------------------------------------------------------------------


def cyrillic_to_latin(text) -> Column:
    """Letters with one Latin letter go through one ``translate``; the others are replaced one by one."""
    out, single_from, single_to = _col(text), "", ""
    for c, l in TRANSLITERATION:
        for a, b in ((c, l), (c.upper(), l[:1].upper() + l[1:])):
            if len(b) == 1:
                single_from, single_to = single_from + a, single_to + b
            else:
                out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, single_from, single_to)


def latin_to_cyrillic(text) -> Column:
    """For surnames: digraphs first; the first letter keeps its case."""
    t = _col(text)
    out = F.lower(t)
    for latin, cyrillic in LATIN_DIGRAPHS:
        out = F.replace(out, F.lit(latin), F.lit(cyrillic))
    out = F.translate(out, "".join(a for a, _ in LATIN_LETTERS), "".join(b for _, b in LATIN_LETTERS))
    first = F.substring(t, 1, 1)
    return F.when((F.lower(first) != first), F.concat(F.upper(F.substring(out, 1, 1)), F.lower(F.substr(out, F.lit(2))))).otherwise(out)


def keyword_list(text) -> Column:
    """Words of three letters and more that are no stopwords, each at its first occurrence, as written."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("(?<![\\p{L}\\d_])[A-Za-zĂăÂâÎîȘșȚțА-Яа-яЁё]{3,}(?![\\p{L}\\d_])"), F.lit(0))
    both = bound(found, lambda ws: F.struct(ws.alias("words"), F.transform(ws, lambda w: F.lower(w)).alias("low")))
    return bound(both, lambda c: F.filter(c["words"], lambda w, i: (F.array_position(c["low"], F.lower(w)) == i + 1) & ~F.lower(w).isin(*KEYWORD_STOPWORDS)))


def token_estimate(text, chars_per_token: float = 2.0) -> Column:
    """Tokens by length: never 0 for a text that is not empty; null is 0."""
    n = F.length(F.coalesce(_col(text), F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.ceil(n / chars_per_token)).cast("long")


def hotword_tokens(text) -> Column:
    """Script-aware estimate: 2 Cyrillic or 3.5 other characters a token, a token a comma and full stop."""
    t = F.coalesce(_col(text), F.lit(""))
    parts = F.filter(F.transform(F.filter(F.split(t, r"\s+"), lambda w: w != ""), lambda w: F.btrim(w, F.lit(".,;:?!\"'()[]{}"))), lambda w: w != "")
    each = F.transform(parts, lambda w: F.greatest(F.lit(1), F.floor(F.length(w) / F.when(w.rlike(CYRILLIC), 2.0).otherwise(3.5) + 0.5).cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x) + F.regexp_count(t, F.lit("[,.]"))
    return F.when(F.trim(t) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), total)).cast("long")


# --- minutes --------------------------------------------------------------------------


def relative_deadline(phrase, day) -> Column:
    """The date that a phrase in Romanian, Russian or English means, seen from ``day``; null if none.

    Longer phrases come first: the day after tomorrow before tomorrow, the month's end before Monday."""
    p, d = F.lower(_col(phrase)), _col(day).cast("date")

    def any_of(*parts):
        out = F.lit(False)
        for x in parts:
            out = out | F.contains(p, F.lit(x))
        return out

    out = F.when(any_of("poimâine", "poimiine", "послезавтра", "day after tomorrow"), F.date_add(d, 2))
    out = out.when(any_of("mâine", "miine", "завтра", "tomorrow"), F.date_add(d, 1))
    out = out.when(any_of("sfârșitul lunii", "sfarsitul lunii", "конец месяца", "end of month"), F.last_day(d))
    for code, names in DAYS:
        out = out.when(p.rlike(r"(?U)\b(?:" + "|".join(names) + r")\b"), F.next_day(d, code))
    return out.when(any_of("săptămâna viitoare", "saptamana viitoare", "следующая неделя", "next week"), F.date_add(d, 7))


def clock(seconds) -> Column:
    """mm:ss; minutes grow beyond 59."""
    s = F.floor(_col(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def clock_interval(start, end) -> Column:
    return F.concat_ws("-", clock(start), clock(end))


def truncated(text, most: int) -> Column:
    """At most ``most`` characters; an ellipsis stands for what is cut, and only then."""
    t = _col(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def first_filled(*texts) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(t), F.lit("")) for t in texts])


def fallback_translation(text, language: str) -> Column:
    return F.concat(F.lit(f"[{language.upper()}] "), _col(text))


def cluster_label(cluster_id) -> Column:
    """SPEAKER_02 -> Speaker 2; null for any other name."""
    n = F.regexp_extract(_col(cluster_id), r"^SPEAKER_(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("Speaker "), n.cast("int").cast("string")))


def localized_label(label, language: str) -> Column:
    n = F.regexp_extract(_col(label), r"^Speaker (\d+)$", 1)
    return F.when(n != "", F.concat(F.lit(SUMMARY_LANGUAGES[language] + " "), n)).otherwise(_col(label))


def logprob_confidence(logprob) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 + _col(logprob) / 5.0)), 2)


def rescored_confidence(margin) -> Column:
    return F.round(F.least(F.lit(1.0), 0.5 + F.greatest(F.lit(0.0), _col(margin))), 3)


def valid_opaque_id(value) -> Column:
    return _col(value).rlike(r"^[A-Za-z0-9_-]{1,64}$")


def space_id(model, digest) -> Column:
    """Name of an embedding space: the model and the first digits of its checksum."""
    return F.concat(_col(model), F.lit("@"), F.substring(_col(digest), 1, 12))


def chunk_budget(context: int, output: int, overhead: int, wanted: int, least: int = 256) -> int:
    return max(least, min(wanted, context - output - overhead))


def chunk_budgets(context, output, overhead, wanted, least: int = 256) -> Column:
    """``chunk_budget`` of columns."""
    return F.greatest(F.lit(least), F.least(_col(wanted), _col(context) - _col(output) - _col(overhead)))
