"""Minutes: claims grounded in what was said, owners, labels and their rendering."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions import arrow
from confab.functions import text as T

# --- evidence -------------------------------------------------------------------------


def evidence_coordinates(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Citations of known segments, with time and speaker taken from the segment again."""
    own = segments.select("meeting_id", "segment_id", "start_s", "end_s", "speaker")
    return evidence.drop("start_s", "end_s", "speaker").join(own, ["meeting_id", "segment_id"])


def evidence_from_lines(items: DataFrame, segments: DataFrame) -> DataFrame:
    """A citation for each line number of ``evidence_idx``; numbers beyond the transcript are dropped."""
    lines = items.select("meeting_id", "item_id", F.explode("evidence_idx").alias("idx"))
    return lines.join(segments.select("meeting_id", "idx", "segment_id", "start_s", "end_s", "speaker", F.col("text").alias("quote")), ["meeting_id", "idx"])


def bare(text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s]", ""), r"\s+", " "))


def verified_citations(evidence: DataFrame, segments: DataFrame, slack: float = 1.0, share: float = 0.9, min_anywhere: int = 9) -> DataFrame:
    """Citations (cite_id, meeting_id, segment_id, start_s, end_s, quote) that were really said: found_in is the segment.

    First the cited segment: times within ``slack``, and the quote, or ``share`` of its words, in
    its text. Else the first segment of the meeting that holds the quote, if it has ``min_anywhere`` characters."""
    asked = evidence.where(F.length(F.trim("quote")) >= 3).withColumn("q", bare("quote"))
    said = segments.select("meeting_id", F.col("segment_id").alias("found_in"), F.col("start_s").alias("s0"), F.col("end_s").alias("s1"), "idx", bare("text").alias("t"))
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    common = F.size(F.array_intersect(tokens("q"), tokens("t"))) / F.size(tokens("q"))
    close = (F.col("start_s") <= F.col("s1") + slack) & (F.col("end_s") >= F.col("s0") - slack)
    direct = asked.join(said, (asked.meeting_id == said.meeting_id) & (asked.segment_id == said.found_in)).drop(said.meeting_id).where(close & (F.contains("t", "q") | (common >= share))).select("cite_id", "found_in").distinct()
    rest = asked.join(direct, "cite_id", "left_anti").where(F.length("q") >= min_anywhere)
    other = rest.select("cite_id", "meeting_id", "q").join(said, "meeting_id").where(F.contains("t", "q")).groupBy("cite_id").agg(F.min_by("found_in", "idx").alias("found_in"))
    return direct.unionByName(other)


def grounded_claims(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """(claim_id, text_id) where the claim (claim_id, claim) stands in the text (text_id, text), both in scoring form.

    A containment join without comparing all pairs: a claim is filed under its longest word, and
    only texts that hold this word are searched for the whole claim. Words, not texts, go
    through the first join, and only texts it finds are normalised again. A match starts and ends at words."""
    padded = lambda c: F.concat(F.lit(" "), T.scoring_form(c), F.lit(" "))
    longest = F.array_max(F.transform(T.scoring_words("claim"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = claims.select("claim_id", padded("claim").alias("asked"), longest.alias("word")).where("word is not null").distinct()
    held = texts.select("text_id", F.explode(F.array_distinct(T.scoring_words("text"))).alias("word"))
    pairs = held.join(asked, "word").select("claim_id", "asked", "text_id")
    return pairs.join(texts.select("text_id", "text"), "text_id").where(F.contains(padded("text"), F.col("asked"))).select("claim_id", "text_id").distinct()


def review_queue(items: DataFrame, verified: DataFrame, key: str = "claim_id") -> DataFrame:
    """Items without any verified citation."""
    return items.join(verified.select(key).distinct(), key, "left_anti")


def supported(items: DataFrame, verified: DataFrame, key: str = "claim_id") -> DataFrame:
    return items.join(verified.select(key).distinct(), key, "left_semi")


def within_chunk(items: DataFrame) -> DataFrame:
    """Items of a chunk with only the lines it holds; those left without lines, or with
    repeated lines alone, are dropped. Reads evidence_idx, chunk, first_idx, last_idx, fresh_idx."""
    own = F.array_sort(F.array_distinct(F.filter("evidence_idx", lambda i: (i >= F.col("first_idx")) & (i <= F.col("last_idx")))))
    kept = items.withColumn("evidence_idx", own).where(F.size("evidence_idx") > 0)
    return kept.where((F.col("chunk") == 0) | (F.array_max("evidence_idx") >= F.col("fresh_idx")))


def strays(results: DataFrame) -> DataFrame:
    """Chunks all of whose items cite lines outside of them, so the answer is asked for again."""
    inside = F.exists("evidence_idx", lambda i: (i >= F.col("first_idx")) & (i <= F.col("last_idx")))
    return results.groupBy("meeting_id", "chunk").agg(F.bool_or(inside).alias("__any")).where("not __any").drop("__any")


def evidence_index(evidence: DataFrame, gold: DataFrame, within: float = 0.05) -> DataFrame:
    """The gold line of each citation: by segment id, else by times within ``within`` seconds."""
    by_id = evidence.join(gold.select("meeting_id", "segment_id", F.col("idx").alias("by_id")), ["meeting_id", "segment_id"], "left")
    at = F.floor(F.col("start_s") / within)
    near = gold.select("meeting_id", F.col("start_s").alias("g0"), F.col("end_s").alias("g1"), "idx", F.explode(F.array(F.floor(F.col("start_s") / within) - 1, F.floor(F.col("start_s") / within), F.floor(F.col("start_s") / within) + 1)).alias("slot"))
    times = evidence.withColumn("slot", at).join(near, ["meeting_id", "slot"]).where((F.abs(F.col("start_s") - F.col("g0")) < within) & (F.abs(F.col("end_s") - F.col("g1")) < within)).groupBy("cite_id").agg(F.min("idx").alias("by_time"))
    return by_id.join(times, "cite_id", "left").select("cite_id", F.coalesce("by_id", "by_time").alias("idx"))


# --- owners ---------------------------------------------------------------------------


def resolved_owners(actions: DataFrame, attendees: DataFrame, min_token: int = 4, close: float = 0.85) -> DataFrame:
    """owner and owner_source of each action (meeting_id, item_id, mention, owner_label, cited_text).

    A mention counts only if it was said in the cited lines. It becomes the first attendee
    (meeting_id, pos, name) with a token like one of its own; else it stays as said. Without a
    mention an anonymous label is the owner, and nothing else is."""
    pronouns = ["i", "me", "eu", "io", "я", "мне", "мы", "noi", "we"]
    m = arrow.base_text("mention")
    a = actions.withColumns({"__m": m, "__said": arrow.base_text("cited_text")})
    a = a.withColumn("__m", F.when((F.length("__m") >= 3) & ~F.col("__m").isin(*pronouns) & F.contains("__said", "__m"), F.col("__m")))
    mine = a.where("__m is not null").select("meeting_id", "item_id", F.explode(F.filter(F.split("__m", " "), lambda w: F.length(w) >= min_token)).alias("mt"))
    theirs = attendees.select("meeting_id", "pos", "name", F.explode(F.filter(F.split(arrow.bare_text("name"), " "), lambda w: F.length(w) >= min_token)).alias("at"))
    pairs = mine.join(theirs, "meeting_id").withColumn("r", arrow.similarity("mt", "at")).where(F.col("r") >= close)
    roster = pairs.groupBy("meeting_id", "item_id").agg(F.min_by("name", "pos").alias("roster"))
    label = F.regexp_extract(F.trim(F.coalesce("owner_label", F.lit(""))), r"^S(\d+)$", 1)
    both = a.join(roster, ["meeting_id", "item_id"], "left")
    owner = F.when(F.col("roster").isNotNull(), F.col("roster")).when(F.col("__m").isNotNull(), F.trim("mention")).when(label != "", F.concat(F.lit("Speaker "), label)).otherwise("Unassigned")
    source = F.when(F.col("roster").isNotNull(), "roster").when(F.col("__m").isNotNull(), "mention").when(label != "", "speaker").otherwise("unassigned")
    return both.select("meeting_id", "item_id", owner.alias("owner"), source.alias("owner_source"))


def rendered_owner(actions: DataFrame, cited: DataFrame) -> DataFrame:
    """A label as owner prints a name only if every cited segment (item_id, speaker, printable_name,
    confirmed_display_name) is a turn of that speaker, printable, and under one name."""
    each = cited.join(actions.select("item_id", "owner"), "item_id")
    ok = (F.col("speaker") == F.col("owner")) & F.col("printable_name") & F.col("confirmed_display_name").isNotNull()
    agreed = each.groupBy("item_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("all_ok"), F.count_distinct("confirmed_display_name").alias("names"), F.min("confirmed_display_name").alias("name"))
    both = actions.join(agreed, "item_id", "left")
    return both.select(*actions.columns, F.when(F.col("owner").rlike(r"^Speaker \d+$") & F.col("all_ok") & (F.col("names") == 1), F.col("name")).otherwise(F.col("owner")).alias("owner_shown"))


# --- labels ---------------------------------------------------------------------------

#: A label stands alone: not in a word, a range or a decimal.
LABEL = re.compile(r"(?<![\w\-/.–])(Speaker |S)(\d{1,2})(?![\w\-/–]|[.,]\d)")
# Words, and beginnings of words, that make a code of S and a number beside them clinical.
CUE_WORDS = set("gallop gallops murmur murmurs sound sounds tone tones root roots disc discul discului disk stage stages level levels".split())
CUE_STEMS = tuple(
    "zgomot galop suflu tonu radicul rădăcin radacin nerv dermatom vertebr sacra sacru lomb lumba herni stadi nivel segment "
    "тон галоп шум кореш нерв дерматом позвон крестц диск грыж стади уровн сегмент радикул".split()
)
# One such word may stand between the cue and the code; these join the codes of a list.
MODIFIER_WORDS, MODIFIER_STEMS = {"heart", "de", "of", "al", "ale"}, tuple("cardia сердечн patologic normal anormal".split())
JOINING = {"și", "si", "sau", "and", "or", "и", "или", "respectiv"}
#: How far back a code's clause is looked at.
REACH = 120
_CLAUSE, _TOKENS, _NEXT = re.compile(r"[^.;:!?()\[\]\n]*\Z"), re.compile(r"[^\W_]+|,"), re.compile(r"\s+([^\W\d_]+)")
#: Kinds of words from a code backwards, as letters: codes and joining words, or a comma before
#: a code, are passed over; then a cue, or one modifier and a cue.
_GOVERNED = re.compile(r"(?:[SJ]|,(?=S))*(?:M(?:[SJ]|,(?=S))*)?C")


def word_kind(token: str) -> str:
    """S a bare code, C a cue or a spinal code, J a joining word, M a modifier, a comma as it is, X anything else."""
    low = token.casefold()
    if re.fullmatch(r"S\d{1,2}", token):
        return "S"
    if low in JOINING:
        return "J"
    if low in CUE_WORDS or low.startswith(CUE_STEMS) or re.fullmatch(r"[CTL]\d{1,2}", token):
        return "C"
    return "M" if low in MODIFIER_WORDS or low.startswith(MODIFIER_STEMS) else "," if token == "," else "X"


def clinical(text: str, start: int, end: int) -> bool:
    """Whether a cue governs the code: as the next word, or before it in its clause."""
    after = _NEXT.match(text, end)
    if after and word_kind(after[1]) == "C":
        return True
    clause = _CLAUSE.search(text[max(0, start - REACH) : start])[0]
    return _GOVERNED.match("".join(map(word_kind, _TOKENS.findall(clause)))[::-1]) is not None


def speaker_labels(text: str | None):
    for m in LABEL.finditer(text or ""):
        if m[1] == "Speaker " or not clinical(text, m.start(), m.end()):
            yield m


def substituted(text: str | None, name) -> str | None:
    """``text`` with each speaker label replaced by ``name(number)``, where that is not None."""
    out, last = [], 0
    for m in speaker_labels(text):
        new = name(int(m[2]))
        if new is not None:
            out += [text[last : m.start()], new]
            last = m.end()
    return text if text is None else "".join([*out, text[last:]])


@arrow.function("array<string>")
def labels_in(texts: pa.Array) -> pa.Array:
    """Speaker labels of a text, as S3, each once, in order of number."""
    return pa.array([[f"S{n}" for n in sorted({int(m[2]) for m in speaker_labels(t)})] for t in texts.to_pylist()], pa.list_(pa.string()))


@arrow.function("string")
def rendered(texts: pa.Array, names: pa.Array) -> pa.Array:
    """Texts with labels as the names of ``names`` (map<int,string>); unknown labels stay."""
    out = []
    for t, m in zip(texts.to_pylist(), names.to_pylist(), strict=True):
        known = dict(m or [])
        out.append(substituted(t, known.get))
    return pa.array(out, pa.string())


@arrow.function("string")
def stored_form(shown: pa.Array, names: pa.Array) -> pa.Array:
    """The reverse of ``rendered``: names, longest first, as labels again. A name that several labels have stays."""
    out = []
    for t, m in zip(shown.to_pylist(), names.to_pylist(), strict=True):
        by_name: dict[str, list[int]] = {}
        for n, name in m or []:
            by_name.setdefault(name, []).append(n)
        for name in sorted((x for x, ns in by_name.items() if len(ns) == 1), key=len, reverse=True):
            t = t if t is None else re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", f"S{by_name[name][0]}", t)
        out.append(t)
    return pa.array(out, pa.string())


def edited_form(submitted, shown, stored, names) -> Column:
    """What to store after an edit: the old text if what was shown came back as it was."""
    return F.when(submitted.eqNullSafe(shown), stored).otherwise(stored_form(submitted, names))


def label_map(segments: DataFrame, language: str) -> DataFrame:
    """Per meeting a map from label number to what it prints as: the first printable name that
    a reviewer gave, without a label in it, else the anonymous form."""
    n = F.regexp_extract("speaker", r"^Speaker (\d+)$", 1)
    named = F.col("attribution_state").isin("confirmed", "corrected") & F.col("printable_name") & (F.length(F.trim("confirmed_display_name")) > 0) & ~F.col("confirmed_display_name").rlike(r"(?U)(?<![\w\-/.–])S\d{1,2}(?![\w\-/–]|[.,]\d)|\bSpeaker \d{1,2}\b")
    each = segments.where(n != "").withColumns({"n": n.cast("int"), "name": F.when(named, F.trim("confirmed_display_name"))})
    first = each.groupBy("meeting_id", "n").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("start_s", "idx"))).alias("name"))
    shown = F.coalesce("name", T.localized_label(F.concat(F.lit("Speaker "), F.col("n").cast("string")), language))
    return first.groupBy("meeting_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("n"), shown.alias("shown"))))).alias("names"))


def attribution_legend(segments: DataFrame) -> DataFrame:
    """Printable confirmed names of a meeting with their label, by first appearance."""
    named = segments.where(F.col("attribution_state").isin("confirmed", "corrected") & F.col("printable_name") & F.col("confirmed_display_name").isNotNull())
    first = named.groupBy("meeting_id", F.col("confirmed_display_name").alias("name")).agg(F.min(F.struct("start_s", "idx", "speaker")).alias("f"))
    return first.select("meeting_id", "name", F.col("f.speaker").alias("speaker"), F.row_number().over(Window.partitionBy("meeting_id").orderBy("f", "name")).alias("pos"))


GROUNDED = "struct<text:string,speakers:array<string>,repaired:boolean>"


@arrow.function(GROUNDED)
def grounded_labels(texts: pa.Array, speakers: pa.Array, allowed: pa.Array, fallback: pa.Array) -> pa.Array:
    """Labels outside ``allowed`` become ``fallback``, in the text and in the list of speakers
    (at most three); without a fallback the text stays."""
    out = []
    for t, given, ok, other in zip(*(x.to_pylist() for x in (texts, speakers, allowed, fallback)), strict=True):
        ok, wrong = set(ok or ()), False

        def name(n, ok=ok, other=other):
            nonlocal wrong
            if f"S{n}" in ok or other is None:
                return None
            wrong = True
            return other

        text, kept = substituted(t, name), []
        for raw in given or ():
            m = re.fullmatch(r"(?:[Ss]|Speaker )(\d{1,2})", (raw or "").strip())
            label = f"S{int(m[1])}" if m else None
            if label not in ok:
                wrong, label = True, other
            if label is not None and label not in kept:
                kept.append(label)
        out.append({"text": text, "speakers": kept[:3], "repaired": wrong})
    return pa.array(out, pa.struct([("text", pa.string()), ("speakers", pa.list_(pa.string())), ("repaired", pa.bool_())]))


# --- names in prose -------------------------------------------------------------------

TITLES = {"dr", "prof", "conf", "dna", "dl", "ing", "mr", "mrs", "ms", "st", "д-р", "проф"}


def capitalised_runs(text: str | None) -> list[str]:
    """Runs of capitalised words that do not merely start a sentence, or that follow a title."""
    out = []
    for m in re.finditer(r"[^\W\d_]+(?:[- ][^\W\d_]+)*", text or ""):
        run, at, titled = [], m.start(), False
        for w in re.finditer(r"[^\W\d_]+(?:-[^\W\d_]+)*", m[0]):
            word, before = w[0], text[: at + w.start()].rstrip()
            titled = titled or re.split(r"\W", before.rstrip("."))[-1].casefold() in TITLES
            starts = not before or before[-1] in ".!?:;\n\"'«»()[]–—" and not titled
            if word[:1].isupper() and (titled or not starts):
                run.append(word)
                continue
            if run:
                out.append(" ".join(run))
            run, titled = [], False
        if run:
            out.append(" ".join(run))
    return out


@arrow.function("array<string>")
def possible_names(texts: pa.Array) -> pa.Array:
    return pa.array([capitalised_runs(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def unknown_names(prose: DataFrame, known: DataFrame, min_length: int = 3, close: float = 0.85) -> DataFrame:
    """(item_id, token) of name-like words of ``text`` that are not in ``known`` (word), nor ``close`` to a word there.

    Words that are so close share two letters in a row, so each meets only those that do, once."""
    tokens = arrow.dealt(prose).select("item_id", F.explode(F.flatten(F.transform(possible_names("text"), lambda r: F.split(r, " ")))).alias("token")).withColumn("word", arrow.base_text("token")).where(F.length("word") >= min_length)
    words = known.select(arrow.base_text("word").alias("word")).distinct()
    left = tokens.select("word").distinct().join(words, "word", "left_anti")
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(F.col(c), i, F.lit(2))))
    a = left.withColumn("__pair", F.explode(pairs("word")))
    b = words.where(F.length("word") >= 2).select(F.col("word").alias("other"), F.explode(pairs("word")).alias("__pair"))
    near = a.join(b, "__pair").where(2 * F.least(F.length("word"), F.length("other")) >= close * (F.length("word") + F.length("other"))).select("word", "other").distinct()
    like = near.where(arrow.similarity("word", "other") >= close).select("word").distinct()
    return tokens.join(left.join(like, "word", "left_anti"), "word", "left_semi").select("item_id", "token").distinct()


@arrow.function("string")
def anonymised(texts: pa.Array, names: pa.Array) -> pa.Array:
    """Texts with each name of the map (name -> stand-in) replaced, longest first."""
    out = []
    for t, m in zip(texts.to_pylist(), names.to_pylist(), strict=True):
        for name, other in sorted(m or [], key=lambda x: (-len(x[0]), x[0])):
            t = t if t is None else re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", lambda _, o=other: o, t, flags=re.I)
        out.append(t)
    return pa.array(out, pa.string())


def leaked_names(bodies: DataFrame, names: DataFrame, min_token: int = 4) -> DataFrame:
    """(body_id, name) where a body (body_id, body) holds a token of a protected name (name).

    An equality join on tokens: no body meets a name it shares nothing with."""
    honorifics = ["dr", "dna", "dl", "prof", "conf", "asist", "med", "doamna", "domnul", "sef", "șef"]
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    mine = names.select("name", F.explode(words("name")).alias("token")).where((F.length("token") >= min_token) & ~F.col("token").isin(*honorifics))
    return bodies.select("body_id", F.explode(words("body")).alias("token")).join(mine, "token").select("body_id", "name").distinct()


# --- extraction without a model, and edits --------------------------------------------


def heuristic_items(segments: DataFrame) -> DataFrame:
    """Decisions, actions and risks told by phrases in three languages: one row for each kind a
    segment is, with owner, deadline phrase, priority or severity."""
    from confab.functions.words import ACTION_PHRASES, DECISION_PHRASES, RISK_PHRASES

    low = F.lower("text")
    either = lambda ps: low.rlike("|".join(re.escape(p) for p in ps))
    null = F.lit(None).cast("string")

    def item(kind, when, **cells):
        own = {"owner": null, "deadline_phrase": null, "level": null, "item_type": null} | cells
        return F.when(when, F.struct(F.lit(kind).alias("kind"), *[v.alias(k) for k, v in own.items()]))

    question = F.contains("text", F.lit("?"))
    due = F.regexp_extract("text", r"(?iu)(?:până|до|by)\s+[^.,;]+", 0)
    has_due = F.contains(low, F.lit("până")) | F.contains(low, F.lit("до ")) | F.contains(low, F.lit("by "))
    urgent = F.contains(low, F.lit("urgent"))
    owner = F.when(F.col("speaker") != "Speaker 1", F.col("speaker")).otherwise("Unassigned")
    found = F.array(
        item("decision", either(DECISION_PHRASES)),
        item("action", either(ACTION_PHRASES), owner=owner, deadline_phrase=F.when(has_due & (due != ""), F.trim(due)), level=F.when(urgent | F.contains(low, F.lit("срочно")), "high").otherwise("medium")),
        item("risk", question | either(RISK_PHRASES), level=F.when(urgent | F.contains(low, F.lit("complicații")), "high").otherwise("medium"), item_type=F.when(question, "unresolved_question").otherwise("risk")),
    )
    return segments.withColumn("__i", F.explode(F.array_compact(found))).select("meeting_id", "segment_id", "idx", "__i.*")


def kept_fields(stored: DataFrame, edited: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """Edited rows, with the columns the server owns taken from the stored ones."""
    old = stored.select(key, *[F.col(c).alias(f"__{c}") for c in owned])
    both = edited.join(old, key, "left")
    return both.select(*[F.col(f"__{c}").alias(c) if c in owned else F.col(c) for c in edited.columns])


def decided_clusters(segments: DataFrame, decisions: DataFrame, printable: float = 2.0) -> DataFrame:
    """Segments after reviewers' decisions (meeting_id, cluster_id, action, person_id, name, decided_at), the latest a cluster.

    confirm names a person, label only a name (which always prints), reject takes all back."""
    last = decisions.groupBy("meeting_id", "cluster_id").agg(F.max_by(F.struct("action", "person_id", "name"), F.struct("decided_at", "action")).alias("d"))
    both = segments.join(last, ["meeting_id", "cluster_id"], "left")
    act = F.col("d.action")
    state = F.when(act == "confirm", "confirmed").when(act == "label", "corrected").when(act == "reject", "anonymous").otherwise(F.col("attribution_state"))
    name = F.when(act.isin("confirm", "label"), F.col("d.name")).when(act == "reject", F.lit(None)).otherwise(F.col("confirmed_display_name"))
    prints = F.when(act == "confirm", F.col("speech_seconds") >= printable).when(act == "label", F.lit(True)).when(act == "reject", F.lit(False)).otherwise(F.col("printable_name"))
    return both.withColumns({"attribution_state": state, "confirmed_display_name": name, "printable_name": prints}).drop("d")


def decision_events(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """One event a cluster and decision: what was decided, when, and how many of the cluster's segments it reached."""
    n = segments.groupBy("meeting_id", "cluster_id").agg(F.count("*").alias("segments"))
    return decisions.join(n, ["meeting_id", "cluster_id"]).select("meeting_id", "cluster_id", "action", "name", "decided_at", "segments")


def attributed_evidence(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Citations (meeting_id, segment_id, ...) with speaker and confirmed name as their segments
    now have them; a name only if it may be printed."""
    own = segments.select("meeting_id", "segment_id", "speaker", F.when(F.col("attribution_state").isin("confirmed", "corrected") & F.col("printable_name"), F.col("confirmed_display_name")).alias("confirmed_name"))
    return evidence.drop("speaker", "confirmed_name").join(own, ["meeting_id", "segment_id"], "left")


def renamed_owners(actions: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Actions (meeting_id, item_id, owner) whose owner was a printed name that a relabelling took
    from the meeting: the owner is the anonymous label again that the name stood for."""
    names = lambda s: s.where(F.col("attribution_state").isin("confirmed", "corrected") & F.col("confirmed_display_name").isNotNull()).select("meeting_id", F.col("confirmed_display_name").alias("owner"), "speaker")
    had = names(before).groupBy("meeting_id", "owner").agg(F.min("speaker").alias("was"))
    lost = had.join(names(after).select("meeting_id", "owner").distinct(), ["meeting_id", "owner"], "left_anti")
    return actions.join(lost, ["meeting_id", "owner"], "left").withColumn("owner", F.coalesce("was", "owner")).select(*actions.columns)


def relabelled(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Segments given another speaker by hand (segment_id, new_speaker) lose their identity."""
    both = segments.join(labels.select("segment_id", "new_speaker"), "segment_id", "left")
    moved = F.col("new_speaker").isNotNull() & (F.col("new_speaker") != F.col("speaker"))
    return both.withColumns({"attribution_state": F.when(moved, "anonymous").otherwise(F.col("attribution_state")), "confirmed_display_name": F.when(~moved, F.col("confirmed_display_name")), "printable_name": F.when(moved, False).otherwise(F.col("printable_name")), "speaker": F.when(moved, F.col("new_speaker")).otherwise(F.col("speaker"))}).drop("new_speaker")
