"""Learning from corrections: a catalogue of events, what of it may be used, rules mined
from it, datasets split without leaks, and the life of models."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions import arrow
from confab.functions.words import NEGATIONS

KEPT = ("audio_start", "audio_end", "audio_checksum", "speaker_cluster", "language")


def upserted(events: DataFrame, key: str = "event_id", order: str = "seq", kept=KEPT, first=("created_at",)) -> DataFrame:
    """The catalogue after all versions of its events came in by ``order``: the last version's
    columns; of ``kept`` ones the last that is not null; of ``first`` ones the first version's."""
    at = F.struct(order)
    cells = []
    for c in events.columns:
        if c == key:
            continue
        if c in kept:
            cells.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c))
        else:
            cells.append((F.min_by(F.col(c), at) if c in first else F.max_by(F.col(c), at)).alias(c))
    return events.groupBy(key).agg(*cells)


def listed(events: DataFrame, meeting_id=None, status: str | None = None, limit: int = 100) -> DataFrame:
    found = events if meeting_id is None else events.where(F.col("meeting_id") == meeting_id)
    found = found if status is None else found.where(F.col("verification_status") == status)
    return found.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


def training_eligible() -> Column:
    return (F.col("verification_status") == "verified") & F.col("verified_against_audio") & F.col("training_reuse_allowed") & (F.col("audio_end") > F.col("audio_start"))


def usable_clips(events: DataFrame, shortest: float = 2.0, longest: float = 28.0) -> DataFrame:
    """Eligible events of a usable length whose new text is a label."""
    text = F.trim(F.coalesce("new_text", F.lit("")))
    return events.where(training_eligible()).withColumns({"label": text, "duration": F.round(F.col("audio_end") - F.col("audio_start"), 3)}).where((F.col("audio_end") - F.col("audio_start")).between(shortest, longest) & ~text.isin("", "[REDACTED]", "[INAUDIBLE]"))


def collection_verdicts(events: DataFrame, meetings: DataFrame, segments: DataFrame, enabled: bool = True) -> DataFrame:
    """(event_id, status, reason): whether an event becomes part of the catalogue, and why not."""
    m = meetings.select("meeting_id", F.lit(True).alias("__m")).distinct()
    s = segments.select("meeting_id", "segment_id", F.lit(True).alias("__s")).distinct()
    both = events.join(m, "meeting_id", "left").join(s, ["meeting_id", "segment_id"], "left")
    bad = (
        F.when(F.lit(not enabled), "learning_disabled").when(F.col("__m").isNull(), "transcript_not_found").when(F.col("__s").isNull(), "segment_not_found")
        .when(F.trim(F.coalesce("new_text", F.lit(""))) == "", "empty_deletion").when(F.col("edit_kind").isin("redaction", "translation"), F.concat(F.lit("edit_kind_"), F.col("edit_kind"), F.lit("_ineligible")))
    )
    return both.select("event_id", F.when(bad.isNull(), "collected").otherwise("ineligible").alias("status"), F.coalesce(bad, F.concat(F.lit("reviewer_"), F.col("edit_kind"))).alias("reason"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "collected").alias("collected"), F.count_if(F.col("status") == "ineligible").alias("ineligible"), F.count_if(F.col("status") == "retry_required").alias("errors"))


def accepted_counts(events: DataFrame) -> DataFrame:
    """Distinct accepted events, meetings and speakers; a missing cluster is the speaker ``unknown``.

    Distinct values are counted exactly, each on its own pre-aggregated shuffle."""
    ok = (F.col("verification_status") == "verified") & F.col("verified_against_audio") & F.col("training_reuse_allowed")
    some = events.where(ok)
    totals = events.agg(F.count("*").alias("total"), F.count_if(F.col("verification_status") == "unverified").alias("unverified"), F.count_if(F.col("verification_status") == "rejected").alias("rejected"))
    out = totals
    for name, c in (("events", F.col("event_id")), ("meetings", F.col("meeting_id")), ("speakers", F.coalesce("speaker_cluster", F.lit("unknown")))):
        out = out.crossJoin(some.select(c.alias("x")).distinct().agg(F.count("x").alias(name)))  # one row each
    return out


def eligible_seconds(events: DataFrame) -> DataFrame:
    length = F.greatest(F.lit(0.0), F.coalesce("audio_end", F.lit(0.0)) - F.coalesce("audio_start", F.lit(0.0)))
    return events.where((F.col("verification_status") == "verified") & F.col("training_reuse_allowed")).agg(F.coalesce(F.sum(length), F.lit(0.0)).alias("seconds"))


def verification_verdict() -> Column:
    """Whether a reviewer may verify a correction; reads revision, current_revision, text, current_text, consent and edit_kind."""
    return (
        F.when(F.col("revision") != F.col("current_revision"), "stale_revision")
        .when(~F.col("new_text").eqNullSafe(F.col("current_text")), "obsolete_text")
        .when(F.col("edit_kind").isin("redaction", "translation"), "kind_not_allowed")
        .when(~F.coalesce("consent_given", F.lit(False)), "no_consent")
        .otherwise("verified")
    )


def decision_verdict() -> Column:
    """Whether a reviewer's decision on a cluster stands; reads expected_revision, current_revision, blockers, person_active and held_by_other."""
    return (
        F.when(F.col("expected_revision") != F.col("current_revision"), "stale_revision")
        .when((F.col("action") == "confirm") & (F.size("blockers") > 0), "blocked")
        .when((F.col("action") == "confirm") & ~F.coalesce("person_active", F.lit(False)), "inactive_person")
        .when((F.col("action") == "confirm") & F.coalesce("held_by_other", F.lit(False)), "already_confirmed_elsewhere")
        .otherwise("accepted")
    )


def valid_label(label) -> Column:
    t = F.trim(label)
    return F.length(t).between(2, 60) & ~t.rlike(r"(?iU)^(?:speaker|vorbitorul|участник|s)\s*_?\d+$")


def edit_verdicts(edits: DataFrame) -> DataFrame:
    """A meeting's edits (meeting_id, segment_id, request_id, seq, expected_revision, old_text,
    new_text) in order. One that expects another revision than the transcript has is stale; a
    request done before is repeated, or a conflict if it asks for something else; one that changes
    nothing is a no-op. Each accepted edit is a revision. ``old_text`` is the text before any edit.

    Each verdict needs all before it, so a meeting's rows pass in order, with its texts and requests as state."""
    from confab.operators.folds import running

    def step(state, row):
        asked = (row["segment_id"], row["new_text"])
        done = state["requests"].get(row["request_id"]) if row["request_id"] is not None else None
        if row["expected_revision"] is not None and row["expected_revision"] != state["revision"]:
            verdict = "stale_revision"
        elif done:
            verdict = "repeated" if done == asked else "conflict"
        elif state["texts"].get(row["segment_id"], row["old_text"]) == row["new_text"]:
            verdict = "no_change"
        else:
            verdict = "accepted"
            state["revision"] += 1
            state["texts"][row["segment_id"]] = row["new_text"]
            state["requests"][row["request_id"]] = asked
        yield row["segment_id"], row["request_id"], row["seq"], verdict, state["revision"]

    rows = edits.select("meeting_id", F.col("segment_id").cast("string").alias("segment_id"), F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), F.col("expected_revision").cast("long").alias("expected_revision"), "old_text", "new_text")
    return running(rows, "meeting_id", ["seq"], lambda: {"revision": 0, "texts": {}, "requests": {}}, step, "segment_id string, request_id string, seq long, verdict string, revision long")


def request_conflicts(requests: DataFrame) -> DataFrame:
    """Requests (request_id, body) that came with more than one body."""
    return requests.select("request_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("b")).distinct().groupBy("request_id").agg(F.count("*").alias("bodies")).where("bodies > 1")


def missed_events(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    return events.join(catalogue.select("event_id"), "event_id", "left_anti")


def reconciled_runs(runs: DataFrame, active=("queued", "running", "processing")) -> DataFrame:
    """Runs found active at a restart have failed."""
    return runs.withColumn("status", F.when(F.col("status").isin(*active), "failed").otherwise(F.col("status")))


def invalidated(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events of withdrawn sources (meeting_id) are revoked and may not be used again."""
    gone = sources.select("meeting_id", F.lit(True).alias("__gone")).distinct()
    both = events.join(gone, "meeting_id", "left")
    hit = F.coalesce("__gone", F.lit(False))
    return both.withColumns({"verification_status": F.when(hit, "revoked").otherwise(F.col("verification_status")), "training_reuse_allowed": F.col("training_reuse_allowed") & ~hit}).drop("__gone")


def stale_manifests(manifests: DataFrame, events: DataFrame) -> DataFrame:
    """Manifests (manifest_id, event_id a row) that hold a revoked event."""
    revoked = events.where("verification_status = 'revoked'").select("event_id")
    return manifests.join(revoked, "event_id", "left_semi").select("manifest_id").distinct()


def purged(tables: dict[str, DataFrame], people: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of people whose consent is withdrawn (person_id)."""
    gone = people.select("person_id").distinct()
    return {n: t.join(gone, "person_id", "left_anti") for n, t in tables.items()}


# --- rules ----------------------------------------------------------------------------


def effective_rules(packs: DataFrame, version: str | None = None) -> DataFrame:
    """The rule of the highest ``priority`` for each id (packaged packs by name, then local ones)."""
    w = Window.partitionBy("rule_id").orderBy(F.desc("priority"), F.desc("pack"))
    one = packs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return one if version is None else one.where(F.col("version") == version)


def overridden_rules(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rules after approvals and rollbacks (rule_id, approval, at), the last one each."""
    last = verdicts.groupBy("rule_id").agg(F.max_by("approval", F.struct("at", "approval")).alias("__a"))
    return rules.join(last, "rule_id", "left").withColumn("approval", F.coalesce("__a", "approval")).drop("__a")


def mined_rules(events: DataFrame, least: int = 2, contexts: int = 3) -> DataFrame:
    """Rules that corrections suggest: one phrase replaced by another ``least`` times.

    The id follows from the rule, so mining again finds it again. A variant corrected to several
    phrases is contradictory, and no such rule is safe. All counts are one grouping that combines
    before the shuffle; the first few contexts of a rule are ranked by a window that each task
    limits first, so no group is gathered."""
    raw = F.coalesce("raw_text", "previous_text")
    diff = arrow.dealt(events).select("language", "event_id", "meeting_id", "reviewer", raw.alias("context"), arrow.single_phrase(raw, F.col("new_text")).alias("p")).where("p is not null")
    each = diff.select("language", F.lower("p.variant").alias("v"), F.lower("p.canonical").alias("c"), "p.*", "event_id", "meeting_id", "reviewer", "context")
    keys = ["language", "v", "c"]
    flags = ("adjacent_negation", "contains_digits", "dosage_or_units_present")
    one = each.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.bool_and("is_safe").alias("safe"), F.max_by("variant", "event_id").alias("variant"), F.max_by("canonical", "event_id").alias("canonical"),
        F.count_distinct("meeting_id").alias("meetings"), F.count_distinct("reviewer").alias("reviewers"),
        *[F.bool_or(F.array_contains("flags", f)).alias(f) for f in flags],
    )
    targets = F.count("*").over(Window.partitionBy("language", "v"))
    w = Window.partitionBy(*keys).orderBy("event_id")
    first = each.select(*keys, "context", F.row_number().over(w).alias("n")).where(F.col("n") <= contexts).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "context"))), lambda x: x["context"]).alias("contexts"))
    out = one.withColumn("targets", targets).where(F.col("occurrences") >= least).join(first, keys)
    rule = F.substring(F.sha2(F.concat_ws("\x1f", *keys), 256), 1, 16)
    seen = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))
    return out.select(rule.alias("rule_id"), "language", "variant", "canonical", "occurrences", "meetings", "reviewers", "contexts", (F.col("safe") & (F.col("targets") == 1)).alias("is_safe"), seen.alias("flags"), (F.col("targets") > 1).alias("contradictory"))


def with_case(original: str, new: str) -> str:
    return new.upper() if original.isupper() else new[:1].upper() + new[1:] if original[:1].isupper() else new


class RuleBook:
    """Approved rules by the first word of their variants: a text is searched once, by its words."""

    _WORD = re.compile(r"\w+")

    def __init__(self, rules: list[dict]):
        self.by_word: dict[str, list] = {}
        self.loose: list = []
        for k, r in enumerate(rules):
            if r["approval"] == "approved":
                for v in filter(None, (v.strip() for v in r["variants"])):
                    first = self._WORD.match(v)
                    entry = (k, re.compile(rf"(?<!\w){re.escape(v)}(?!\w)", re.I), r)
                    (self.by_word.setdefault(first[0].lower(), []) if first else self.loose).append(entry)

    def matches(self, text: str) -> list[tuple[int, int, dict]]:
        found = [(k, m.start(), m.end(), r) for k, p, r in self.loose for m in p.finditer(text)]
        for w in self._WORD.finditer(text):
            found += [(k, m.start(), m.end(), r) for k, p, r in self.by_word.get(w[0].lower(), ()) if (m := p.match(text, w.start()))]
        return [x[1:] for x in sorted(found, key=lambda x: x[:3])]


def rewrite(text: str | None, language: str, rules: RuleBook | list[dict]) -> dict:
    """Approved rules applied to the text as it came: the longest match first, none inside
    another, none to what a rule has written.

    A match in a token with digits is passed over. Near a negation or a dose, of a mixed rule
    in a text that is not mixed, or of a rule that only suggests, it is a suggestion."""
    mixed = ("mixed", "code_switch")
    rules = rules if isinstance(rules, RuleBook) else RuleBook(rules)
    found = [x for x in rules.matches(text or "") if x[2]["language"][:2] == language[:2] or language in mixed or x[2]["language"] in mixed]
    taken: list[tuple] = []
    for a, b, r in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        if all(b <= s or a >= e for s, e, _ in taken):
            taken.append((a, b, r))
    negations = {w for k in ("ro", "ru", language[:2]) for w in NEGATIONS.get(k, ())}
    done, offered = [], []
    for a, b, r in sorted(taken, key=lambda x: x[:2]):
        token = (text[:a].rpartition(" ")[2] if a else "") + text[a:b] + text[b:].partition(" ")[0]
        if any(c.isdigit() for c in token):
            continue
        near = [w.lower() for w in re.findall(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", text[max(0, a - 40) : a])][-3:]
        reason = (
            "blocked_by_adjacent_negation" if negations & set(near)
            else "blocked_by_dosage_or_units" if arrow.DOSE.search(text[max(0, a - 30) : b + 30])
            else "unvalidated_mixed_language_span" if r["language"] in mixed and language not in mixed
            else "suggest_only_rule" if r["action"] == "suggest_only" else None
        )
        if reason:
            offered.append({"was": text[a:b], "now": r["canonical"], "rule_id": r["rule_id"], "reason": reason})
        else:
            done.append({"was": text[a:b], "now": with_case(text[a:b], r["canonical"]), "rule_id": r["rule_id"], "start": a, "end": b})
    out, last = [], 0
    for c in done:
        out += [text[last : c["start"]], c["now"]]
        last = c["end"]
    return {"text": text if text is None else "".join([*out, text[last:]]), "corrections": done, "suggestions": offered}


REWRITTEN = "struct<text:string,corrections:array<struct<was:string,now:string,rule_id:string,start:int,end:int>>,suggestions:array<struct<was:string,now:string,rule_id:string,reason:string>>>"


def normalised(segments: DataFrame, rules: DataFrame, max_rules: int = 20_000) -> DataFrame:
    """Segments with ``rewritten`` (text, corrections, suggestions). Rules are written by people;
    more than ``max_rules`` of them are refused rather than sent to every task."""
    rows = rules.select("rule_id", "language", "variants", "canonical", "action", "approval").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    known = [r.asDict() for r in sorted(rows, key=lambda r: r["rule_id"])]
    text, item = pa.string(), [("was", pa.string()), ("now", pa.string()), ("rule_id", pa.string())]
    kind = pa.struct([("text", text), ("corrections", pa.list_(pa.struct([*item, ("start", pa.int32()), ("end", pa.int32())]))), ("suggestions", pa.list_(pa.struct([*item, ("reason", text)])))])

    @arrow.function(REWRITTEN)
    def apply(texts: pa.Array, languages: pa.Array) -> pa.Array:
        book = RuleBook(known)
        return pa.array([rewrite(t, x or "und", book) for t, x in zip(texts.to_pylist(), languages.to_pylist(), strict=True)], kind)

    return arrow.dealt(segments).withColumn("rewritten", apply("text", "language"))


class Lexicon:
    """Entries (canonical, variants, languages, fuzzy) of each language, compiled once; the nearest
    fuzzy entry of a word is found once a word.

    A word and an entry of T letters together whose blocks match in M of each have ratio 2 M / T. Between blocks there
    is a letter that does not match, so there are at most T - 2 M + 1 blocks, and the pairs of letters within
    blocks, which both hold, are at least 3 M - T - 1. An index of pairs counts those in common, and only entries
    that have enough of them are compared: no entry that is close enough is missed."""

    def __init__(self, entries: list[dict], close: float = 0.80, min_length: int = 5):
        self.close, self.min_length = close, min_length
        self.exact = {e["canonical"].lower() for e in entries}
        self.variants, self.fuzzy, self.pairs, self.known = {}, {}, {}, {}
        for language in ("ro", "ru", "en"):
            own = [e for e in entries if language in e["languages"]]
            self.variants[language] = [(re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, vs))})(?!\w)", re.I), e["canonical"]) for e in own if (vs := sorted(filter(None, e["variants"]), key=len, reverse=True))]
            self.fuzzy[language] = own = [(e["canonical"], e["canonical"].lower()) for e in own if e["fuzzy"]]
            self.pairs[language] = pairs = {}
            for k, (_, low) in enumerate(own):
                for pair, n in Counter(map("".join, zip(low, low[1:]))).items():
                    pairs.setdefault(pair, []).append((k, n))

    def near(self, word: str, language: str) -> list[int]:
        """Entries that may be close enough, in order."""
        own, found = self.fuzzy[language], Counter()
        for pair, n in Counter(map("".join, zip(word, word[1:]))).items():
            for k, m in self.pairs[language].get(pair, ()):
                found[k] += min(n, m)
        rise = 1.5 * self.close - 1  # pairs that each letter of both asks for
        least = lambda k: rise * (len(word) + len(own[k][1])) - 1 - 1e-9
        if own and rise * (len(word) + min(len(low) for _, low in own)) <= 1:
            return list(range(len(own)))  # so short or so far that no pair need be in common
        return sorted(k for k, n in found.items() if n >= least(k))

    def nearest(self, word: str, language: str) -> tuple[str, float] | None:
        if (language, word) not in self.known:
            best = None
            for k in self.near(word, language):
                canonical, low = self.fuzzy[language][k]
                # no ratio is above what the lengths allow
                if 2 * min(len(word), len(low)) >= self.close * (len(word) + len(low)):
                    score = (arrow.matching_ratio(word, low), -k)
                    if score[0] >= self.close and (best is None or score > best[0]):
                        best = score, canonical
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[language, word] = best and (best[1], best[0][0])
        return self.known[language, word]


def lexicon_fix(text: str | None, language: str | None, lexicon: Lexicon | list[dict]) -> dict:
    """Known misspellings replaced by their entry, then words close to a fuzzy entry; tokens with
    digits stay. Only ro, ru and en texts change."""
    lexicon = lexicon if isinstance(lexicon, Lexicon) else Lexicon(lexicon)
    done: list[dict] = []
    if not text or language not in ("ro", "ru", "en"):
        return {"text": text, "corrections": done}

    def put(m, new, score):
        token = m.string[: m.start()].rpartition(" ")[2] + m[0] + m.string[m.end() :].partition(" ")[0]
        if new == m[0] or any(c.isdigit() for c in token):
            return m[0]
        done.append({"was": m[0], "now": new, "score": round(score, 3)})
        return new

    for pattern, canonical in lexicon.variants[language]:
        text = pattern.sub(lambda m, c=canonical: put(m, c, 1.0), text)

    def nearest(m):
        low = m[0].lower()
        got = lexicon.nearest(low, language) if len(low) >= lexicon.min_length and low not in lexicon.exact else None
        return put(m, *got) if got else m[0]

    return {"text": re.sub(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", nearest, text) if lexicon.fuzzy[language] else text, "corrections": done}


def corrected(segments: DataFrame, lexicon: DataFrame, max_entries: int = 20_000) -> DataFrame:
    """Segments with ``corrected`` (text, corrections) by the lexicon, of at most ``max_entries`` entries."""
    rows = lexicon.select("canonical", "variants", "languages", "fuzzy", "pos").limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"more than {max_entries} entries")
    known = [r.asDict() for r in sorted(rows, key=lambda r: r["pos"])]
    kind = pa.struct([("text", pa.string()), ("corrections", pa.list_(pa.struct([("was", pa.string()), ("now", pa.string()), ("score", pa.float64())])))])

    @arrow.function("struct<text:string,corrections:array<struct<was:string,now:string,score:double>>>")
    def apply(texts: pa.Array, languages: pa.Array) -> pa.Array:
        book = Lexicon(known)
        return pa.array([lexicon_fix(t, x, book) for t, x in zip(texts.to_pylist(), languages.to_pylist(), strict=True)], kind)

    return arrow.dealt(segments).withColumn("corrected", apply("text", "language"))


# --- datasets -------------------------------------------------------------------------


def grouped_split(rows: DataFrame, group: str, seed: int = 42, train: float = 0.70, dev: float = 0.15) -> DataFrame:
    """``rows`` with a ``split`` that no group crosses: a group's place is a hash of the seed and its
    key, so it needs no count of the groups, and stays when others come; shares are approximate (see ``exact_split``)."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))), 1, 7), 16, 10).cast("long") / float(1 << 28)
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test"))


def shares(n: int, train: float = 0.70, dev: float = 0.15) -> tuple[int, int]:
    """How many of ``n`` groups train and develop; the rest test. One group trains, two train and test,
    and a rounding that leaves none to test takes one from those that develop."""
    if n < 3:
        return min(n, 1), 0
    a, b = max(1, round(train * n)), max(1, round(dev * n))
    return a, b - 1 if a + b >= n else b


def exact_split(rows: DataFrame, group: str, seed: int = 42, train: float = 0.70, dev: float = 0.15, bits: int = 16) -> DataFrame:
    """``rows`` with a ``split`` that no group crosses, with exact shares of the groups.

    Groups stand in order of a seeded hash. A histogram of its first ``bits`` says in which cell the
    group of a given place stands; only such a cell's groups are put in order, to find the group after which a split
    ends. What a row's split is then follows from its group alone: rows are neither ranked nor joined."""
    text = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    place = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), text)).alias("h"), text.alias("k"))
    groups = rows.select(place.alias("at")).distinct()
    cell = F.conv(F.substring("at.h", 1, bits // 4), 16, 10).cast("int")
    counts = {r.cell: r.n for r in groups.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}  # at most 2**bits rows
    trained, developed = shares(sum(counts.values()), train, dev)

    def last(k: int) -> Column:
        """Whether a row's group is one of the first ``k``."""
        if k == 0:
            return F.lit(False)
        before = 0
        for c in sorted(counts):
            if before + counts[c] >= k:
                break
            before += counts[c]
        found = groups.where(cell == c).orderBy("at").limit(k - before).agg(F.max("at").alias("at")).first()["at"]
        return place <= F.struct(F.lit(found.h).alias("h"), F.lit(found.k).alias("k"))

    return rows.withColumn("split", F.when(last(trained), "train").when(last(trained + developed), "dev").otherwise("test"))


def shuffled_split(groups: list, seed: int = 42) -> dict:
    """Split of a few groups by a seeded shuffle with exact shares: three groups or more fill all
    splits, two are train and test, one is train."""
    import random

    keys = sorted(groups)
    random.Random(seed).shuffle(keys)
    n = len(keys)
    if n < 3:
        return dict(zip(keys, ("train", "test")))
    a, b = max(1, round(0.70 * n)), max(1, round(0.15 * n))
    out = {k: "train" if i < a else "dev" if i < a + b else "test" for i, k in enumerate(keys)}
    if "test" not in out.values():
        out[next(k for k in keys if out[k] == "dev")] = "test"
    return out


def leaks(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.select(key, "split").distinct().groupBy(key).agg(F.count("*").alias("splits")).where("splits > 1")


def speaker_disjoint(rows: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Test rows of speakers who are not in train."""
    return rows.where("split = 'test'").join(rows.where("split = 'train'").select(speaker).distinct(), speaker, "left_anti")


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Per language its clips, seconds and share of all seconds."""
    sums = rows.groupBy("language").agg(F.count("*").alias("clips"), F.sum("duration").alias("seconds"))
    whole = rows.agg(F.sum("duration").alias("__all"))
    return sums.crossJoin(whole).select("language", "clips", F.round("seconds", 3).alias("seconds"), F.round(F.col("seconds") / F.col("__all"), 3).alias("share"))  # one row on the right


def manifest_violations(clips: DataFrame) -> DataFrame:
    """(clip_id, rule) for clips without a label, with a bad split, a missing checksum, or a meeting or checksum in two splits."""
    own = F.array_compact(F.array(F.when(F.trim(F.coalesce("label", F.lit(""))).isin("", "[REDACTED]", "[INAUDIBLE]"), "no_label"), F.when(~F.col("split").isin("train", "dev", "test"), "unknown_split"), F.when(~F.col("audio_sha256").rlike("^[0-9a-f]{64}$"), "bad_checksum")))
    out = clips.select("clip_id", F.explode(own).alias("rule"))
    for key, rule in (("meeting_id", "meeting_leak"), ("audio_sha256", "audio_leak")):
        out = out.unionByName(clips.join(leaks(clips, key), key, "left_semi").select("clip_id", F.lit(rule).alias("rule")))
    return out


# --- models ---------------------------------------------------------------------------


def registry(actions: DataFrame) -> DataFrame:
    """State of each model after its actions (runtime, artifact_id, seq, action, report, passed) in order.

    register, evaluate, approve (of a passed evaluation with the same report), activate (of an
    approved model; the active one retires and is remembered) and rollback (the active one
    retires, the remembered one returns). What is not allowed changes nothing.
    A runtime's actions pass in order, with its models as state.
    """
    from confab.operators.folds import running

    def step(models, r):
        m = models.get(r["artifact_id"])
        active = models.get(models.get(None))
        match r["action"]:
            case "register" if m is None:
                models[r["artifact_id"]] = {"status": "candidate", "report": None, "passed": False, "previous": None}
            case "evaluate" if m and m["status"] not in ("retired", "invalidated"):
                if m is active:
                    models[None] = None
                m.update(status="evaluated", report=r["report"], passed=bool(r["passed"]))
            case "approve" if m and m["passed"] and m["report"] == r["report"]:
                if m is active:
                    models[None] = None
                m["status"] = "approved"
            case "activate" if m and m["status"] == "approved":
                if active:
                    active["status"] = "retired"
                m.update(status="active", previous=models.get(None))
                models[None] = r["artifact_id"]
            case "rollback" if active and active["previous"]:
                active["status"] = "retired"
                models[active["previous"]]["status"] = "active"
                models[None] = active["previous"]
        return ()

    def end(models):
        return ((k, m["status"], m["previous"]) for k, m in models.items() if k is not None)

    return running(actions, "runtime", ["seq"], dict, step, "artifact_id string, status string, previous_id string", "string", end)


def chunk_outcome(chunks: DataFrame, most: float = 0.20) -> DataFrame:
    """Per meeting its chunks (meeting_id, chunk, failed), how many failed, and whether that is over
    ``most`` of them, so that the extraction as a whole has failed."""
    n = chunks.groupBy("meeting_id").agg(F.count("*").alias("chunks"), F.count_if("failed").alias("failed"))
    return n.withColumn("rejected", F.col("failed") > most * F.col("chunks"))


def call_totals(calls: DataFrame) -> DataFrame:
    """Per meeting the model's calls (meeting_id, prompt_tokens, completion_tokens, attempt, ok):
    tokens, and the share of chunks right at the first attempt."""
    sums = calls.groupBy("meeting_id").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count_if(F.col("attempt") == 1).alias("firsts"), F.count_if((F.col("attempt") == 1) & F.col("ok")).alias("passed"))
    return sums.select("meeting_id", "calls", "prompt_tokens", "completion_tokens", F.when(F.col("firsts") > 0, F.col("passed") / F.col("firsts")).alias("first_pass_rate"))


def report_hash(*columns: str) -> Column:
    """SHA-256 of a row's report: its fields as JSON in order of their names, so their order in the table does not matter."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
