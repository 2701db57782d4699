"""Transcript segments: what is shown, what is flagged, who speaks when.

A segment has meeting_id, segment_id, idx, start_s, end_s, speaker and texts; other columns
pass through. Windows are partitioned by meeting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions import text as T

PRINTABLE_S = 2.0


def in_order() -> Window:
    return Window.partitionBy("meeting_id").orderBy("idx", "segment_id")


# --- projections and predicates -------------------------------------------------------


def display_text() -> Column:
    """A correction counts even if empty, then the normalised text, then the raw one."""
    return F.coalesce("corrected_text", "normalized_text", "raw_text")


def display_speaker() -> Column:
    """The confirmed name where it may be printed, else the cluster's label."""
    return F.when(F.col("printable_name") & (F.coalesce("confirmed_display_name", F.lit("")) != ""), F.col("confirmed_display_name")).otherwise(F.col("speaker"))


def attribution_violations(segments: DataFrame) -> DataFrame:
    """(segment_id, rule) for each broken rule of the attribution states."""
    named = F.col("attribution_state").isin("confirmed", "corrected")
    has_name = F.coalesce("confirmed_display_name", F.lit("")) != ""
    rules = F.array(
        F.when(~F.col("attribution_state").isin("anonymous", "suggested", "confirmed", "corrected"), "unknown_state"),
        F.when(named & ~has_name, "named_without_name"),
        F.when(~named & has_name, "name_without_decision"),
        F.when(F.col("printable_name") & ~named, "printable_without_decision"),
    )
    return segments.select("segment_id", F.explode(F.array_compact(rules)).alias("rule"))


def migrated_attribution(segments: DataFrame) -> DataFrame:
    """Names kept by an older schema move to ``legacy_name``; running it again changes nothing."""
    old = (F.col("attribution_state") == "anonymous") & (F.coalesce("confirmed_display_name", F.lit("")) != "")
    return segments.withColumns({"legacy_name": F.when(old, F.col("confirmed_display_name")), "confirmed_display_name": F.when(old, F.lit(None)).otherwise(F.col("confirmed_display_name"))})


def human_attributed(segments: DataFrame) -> DataFrame:
    signals = F.col("attribution_state").isin("confirmed", "corrected") | F.col("speaker_id").isNotNull() | F.col("confirmed_display_name").isNotNull() | F.col("printable_name")
    return segments.where(signals)


def garbage_reason(logprob: float = -1.5, compression: float = 2.4, no_speech: float = 0.85, max_rate: float = 40.0, min_chars: int = 10) -> Column:
    """``low_confidence_asr`` for a decode that is likely noise, else null. The segment stays."""
    length = F.length("text")
    dense = (length >= min_chars) & (length / F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.01)) > max_rate)
    bad = (F.col("compression_ratio") > compression) | (F.col("avg_logprob") < logprob) | (F.col("no_speech_prob") > no_speech) | ~F.col("text").rlike(r"\p{L}") | dense
    return F.when(bad, "low_confidence_asr")


def review_flag(critical_terms: list[str], logprob: float = -1.1) -> Column:
    """Why a reviewer must look at a segment; the first reason that holds."""
    out = F.when(F.col("avg_logprob") < logprob, "unclear_speech").when(F.col("text").rlike(r"\p{Nd}"), "contains_numbers")
    for term in critical_terms:
        out = out.when(F.col("text").rlike(rf"(?iU)\b{term}\b"), f"critical_term:{term}")
    return out


def needs_rescoring(weak: float = 0.70, confident: float = 0.70) -> Column:
    """A weak acoustic language, or a text that confidently says another one.
    Reads acoustic_language, p1 and text_lid (of ``functions.text.text_language``)."""
    lid = F.col("text_lid")
    other = lid["language"].isin("ro", "ru", "en") & (lid["language"] != F.col("acoustic_language")) & (lid["confidence"] >= confident)
    return (F.col("p1") < weak) | other


def hotword_echo(text, hotwords, min_items: int = 3, min_share: float = 0.5) -> Column:
    """The text is mostly the list of hints read back."""
    items = F.filter(F.transform(F.split(F.coalesce(hotwords, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    both = F.struct(items.alias("items"), T.words(F.coalesce(text, F.lit(""))).alias("tokens"))
    n = T.bound(both, lambda c: F.struct(F.size(F.filter(c["tokens"], lambda w: F.array_contains(c["items"], w))).alias("hits"), F.size(c["tokens"]).alias("all")))
    return T.bound(n, lambda c: (c["hits"] > 0) & ((c["hits"] >= min_items) | (c["hits"] / c["all"] >= min_share)))


def reconciled_language(weak: float = 0.70, confident: float = 0.70) -> Column:
    """struct(language, confidence, source, rescore) of a decoded window.

    Reads acoustic_language, p1, forced and text_lid: no letters is ``und`` and garbage; mixed
    text is mixed; a window to rescore is marked; Latin text of the other Latin language relabels."""
    lid = F.col("text_lid")
    acoustic = F.struct(F.col("acoustic_language").alias("language"), F.round("p1", 3).alias("confidence"), F.lit("acoustic").alias("source"), F.lit(False).alias("rescore"))

    def made(language, confidence, source, rescore=False):
        return F.struct(language.alias("language"), confidence.alias("confidence"), F.lit(source).alias("source"), F.lit(rescore).alias("rescore"))

    latin = lid["language"].isin("ro", "en") & F.col("acoustic_language").isin("ro", "en") & (lid["language"] != F.col("acoustic_language")) & (lid["confidence"] >= confident)
    return (
        F.when((lid["language"] == "und") & (lid["letters"] == 0), made(F.lit("und"), F.lit(0.0), "text"))
        .when(lid["language"] == "und", acoustic)
        .when(lid["language"] == "mixed", made(F.lit("mixed"), lid["confidence"], "text"))
        .when(F.col("forced"), acoustic)
        .when(needs_rescoring(weak, confident), made(F.col("acoustic_language"), F.round("p1", 3), "acoustic", True))
        .when(latin, made(lid["language"], lid["confidence"], "text"))
        .otherwise(acoustic)
    )


def alternative_language(allowed: list[str]) -> Column:
    """What to decode a window in again: the text's language if it is another allowed one,
    else the best ranked other one. Reads acoustic_language, ranking (array of structs) and text_lid."""
    text = F.col("text_lid")["language"]
    other = F.element_at(F.filter("ranking", lambda x: x["language"] != F.col("acoustic_language")), 1)["language"]
    return F.when(text.isin(*allowed) & (text != F.col("acoustic_language")), text).otherwise(F.coalesce(F.try_element_at(F.transform(F.filter("ranking", lambda x: x["language"] != F.col("acoustic_language")), lambda x: x["language"]), F.lit(1)), F.col("acoustic_language")))


def better_decode(windows: DataFrame, decodes: DataFrame) -> DataFrame:
    """Of a window's decodes (window_id, attempt, language, mean_logprob) the one with the best
    mean log probability, the earlier on ties, with the margin as its confidence."""
    best = decodes.groupBy("window_id").agg(F.max_by(F.struct("language", "mean_logprob", "attempt"), F.struct("mean_logprob", -F.col("attempt"))).alias("won"), F.min("mean_logprob").alias("worst"), F.count("*").alias("decodes"))
    out = windows.join(best, "window_id", "left")
    margin = F.when(F.col("decodes") > 1, F.col("won.mean_logprob") - F.col("worst")).otherwise(F.lit(1.0))
    return out.select(*windows.columns, F.col("won.language").alias("language"), F.col("won.attempt").alias("attempt"), T.rescored_confidence(margin).alias("confidence"))


def shifted(segments: DataFrame, digits: int = 2) -> DataFrame:
    """Window-relative times as times of the recording, those of words too if there are any."""
    at = lambda x: F.round(x + F.col("window_start"), digits)
    out = segments.withColumns({"start_s": at(F.col("start_s")), "end_s": at(F.col("end_s"))})
    if "words" in segments.columns:
        out = out.withColumn("words", F.transform("words", lambda w: F.struct(w["word"].alias("word"), at(w["start_s"]).alias("start_s"), at(w["end_s"]).alias("end_s"))))
    return out


def search(segments: DataFrame, query: str = "", language: str | None = None, speaker: str | None = None) -> DataFrame:
    found = segments
    if language:
        found = found.where(F.col("language") == language)
    if speaker:
        found = found.where(F.col("speaker") == speaker)
    return found.where(F.contains(F.lower("text"), F.lit(query.lower()))) if query else found


def excerpt(segments: DataFrame, start: float, end: float) -> DataFrame:
    """Segments that overlap the interval."""
    return segments.where((F.col("start_s") < end) & (F.col("end_s") > start))


def at_playback(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """For each position (meeting_id, position_s) the first segment that holds it."""
    both = positions.join(segments, "meeting_id").where((F.col("position_s") >= F.col("start_s")) & (F.col("position_s") < F.col("end_s")))
    return both.groupBy("meeting_id", "position_s").agg(F.min_by("segment_id", F.struct("start_s", "idx")).alias("segment_id"))


def invalid_results(segments: DataFrame, duration: Column | float) -> DataFrame:
    """Segments of a remote result that break its contract: (segment_id, rule)."""
    before = F.lag("start_s").over(in_order())
    limit = duration if isinstance(duration, Column) else F.lit(duration)
    finite = ~(F.isnan("start_s") | F.isnan("end_s") | F.col("start_s").isNull() | F.col("end_s").isNull())
    rules = F.array(
        F.when(~finite, "not_finite"),
        F.when(F.col("start_s") < 0, "negative_start"),
        F.when(F.col("end_s") < F.col("start_s"), "ends_before_start"),
        F.when(F.col("end_s") > limit + 0.5, "beyond_recording"),
        F.when(F.col("start_s") < before, "start_goes_back"),
    )
    return segments.withColumn("__rules", F.array_compact(rules)).select("segment_id", F.explode("__rules").alias("rule"))


# --- order within a meeting -----------------------------------------------------------


def indexed_lines(segments: DataFrame) -> DataFrame:
    """``idx label: text`` at a change of speaker, ``idx text`` within a turn."""
    new = ~F.coalesce(F.lag("speaker").over(in_order()) == F.col("speaker"), F.lit(False))
    label = F.concat(F.col("idx").cast("string"), F.when(new, F.concat(F.lit(" "), F.regexp_replace("speaker", "^Speaker ", "S"), F.lit(":"))).otherwise(F.lit("")))
    return segments.select("meeting_id", "idx", new.alias("turn_start"), F.concat_ws(" ", label, "text").alias("line"))


def turn_starts(segments: DataFrame) -> DataFrame:
    return indexed_lines(segments).where("turn_start").select("meeting_id", "idx")


def going_back(segments: DataFrame) -> DataFrame:
    """Segments that start before the one before them."""
    return segments.withColumn("before_s", F.lag("start_s").over(in_order())).where(F.col("start_s") < F.col("before_s"))


def transcript_stats(segments: DataFrame, default_language: str = "ro") -> DataFrame:
    """Per meeting: words, end, and its languages in order. Mixed segments count by their
    ``spans``, und not at all; a meeting with no language left has the default one."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    spoken = F.when(F.col("language") == "mixed", F.col("spans")).when((F.col("language") == "und") | F.col("language").isNull(), F.array().cast("array<string>")).otherwise(F.array("language"))
    sums = segments.groupBy("meeting_id").agg(F.sum(words).cast("long").alias("words"), F.max("end_s").alias("end_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(spoken)))).alias("found"))
    return sums.select("meeting_id", "words", "end_s", F.when(F.size("found") > 0, F.array_join("found", ",")).otherwise(default_language).alias("languages"))


def language_histogram(segments: DataFrame) -> DataFrame:
    return segments.groupBy("language").agg(F.count("*").alias("segments")).orderBy(F.desc("segments"), "language")


def run_statistics(segments: DataFrame) -> DataFrame:
    """Per meeting: segments, whole-second durations, gaps of nothing, mean log probability, repeated texts."""
    w = in_order()
    return summed_run(segments.select("meeting_id", "avg_logprob", F.round(F.col("end_s") - F.col("start_s"), 2).alias("d"), (F.abs(F.col("start_s") - F.lag("end_s").over(w)) < 1e-9).alias("touch"), (F.col("text") == F.lag("text").over(w)).alias("again")))


def summed_run(marked: DataFrame) -> DataFrame:
    return marked.groupBy("meeting_id").agg(
        F.count("*").alias("segments"), F.count_if(F.abs(F.col("d") - F.round("d")) < 1e-9).alias("integer_durations"), F.count_if("touch").alias("zero_gaps"),
        F.round(F.avg("avg_logprob"), 4).alias("mean_logprob"), F.count_if("again").alias("repeated_texts"),
    )


LANGUAGES = ("ro", "ru", "en")


def window_statistics(windows: DataFrame, timings: DataFrame, languages=LANGUAGES) -> DataFrame:
    """Per meeting, of its decoded windows (meeting_id, language, text_language, segments, inherited, rescored, echoed)
    and timings (meeting_id, audio_seconds, total_seconds): windows, windows of each language (of ``languages``
    in any case), how many were inherited, rescored and decoded again for an echo, the share of decided windows whose
    text speaks the language that was heard, and the real-time factor.

    A window is decided if it has segments, its text a language, and it was heard in one of ``languages``. Shares and
    factors without a base are null. Counts of a language are sums before they are a map."""
    known = F.array(*map(F.lit, languages))
    decided = (F.col("segments") > 0) & F.col("text_language").isNotNull() & ~F.col("text_language").isin("und", "mixed") & F.array_contains(known, F.col("language"))
    sums = windows.groupBy("meeting_id", "language").agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("inherited", "rescored", "echoed")], F.count_if(decided).alias("decided"), F.count_if(decided & (F.col("text_language") == F.col("language"))).alias("agreed")
    )
    seen = F.map_from_entries(F.collect_list(F.when(F.col("language").isNotNull(), F.struct("language", "n"))))
    none = F.map_from_arrays(known, F.array_repeat(F.lit(0).cast("long"), len(languages)))
    one = sums.groupBy("meeting_id").agg(F.sum("n").alias("windows"), seen.alias("seen"), *[F.sum(c).alias(f"{c}_windows") for c in ("inherited", "rescored", "echoed")], F.sum("decided").alias("decided"), F.sum("agreed").alias("agreed"))
    rest = F.map_filter(none, lambda k, v: ~F.map_contains_key("seen", k))
    counts = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat("seen", rest))))
    agreement = F.round(F.when(F.col("decided") > 0, F.col("agreed") / F.col("decided")), 3)
    factor = F.round(F.when(F.col("audio_seconds") > 0, F.col("total_seconds") / F.col("audio_seconds")), 4)
    return one.join(timings, "meeting_id", "left").select("meeting_id", "windows", counts.alias("window_languages"), "inherited_windows", "rescored_windows", "echoed_windows", agreement.alias("agreement"), factor.alias("rtf"))


def speech_share(segments: DataFrame) -> DataFrame:
    """Speaking time of each speaker and its share of the meeting."""
    sums = segments.groupBy("meeting_id", "speaker").agg(F.sum("speech_seconds").alias("seconds"), F.count("*").alias("turns"))
    return sums.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy("meeting_id")))


def dominant_label(segments: DataFrame) -> DataFrame:
    """Per meeting the speaker with the most speech, the one heard first on ties."""
    sums = segments.groupBy("meeting_id", "speaker").agg(F.sum("speech_seconds").alias("seconds"), F.min("idx").alias("first"))
    return sums.groupBy("meeting_id").agg(F.max_by("speaker", F.struct("seconds", -F.col("first"))).alias("speaker"))


def language_runs(words: DataFrame, default_language: str | None = None) -> DataFrame:
    """Runs of one language over a segment's words (segment_id, pos, start_s, end_s, word):
    unknown words take the language before them, leading ones the one after; words that
    stay unknown are left out, adjacent runs of one language are one."""
    w = Window.partitionBy("segment_id").orderBy("pos")
    known = words.withColumn("own", T.word_language(F.trim("word")))
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = known.withColumn("language", F.coalesce(F.last("own", True).over(w), F.lit(default_language).cast("string"), F.first("own", True).over(ahead))).where("language is not null")
    new = F.when(F.lag("language").over(w) == F.col("language"), 0).otherwise(1)
    runs = filled.withColumn("run", F.sum(new).over(w))
    return runs.groupBy("segment_id", "run", "language").agg(F.round(F.min("start_s"), 2).alias("start_s"), F.round(F.max("end_s"), 2).alias("end_s"))


def numbered_clusters(segments: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters of a meeting numbered by first appearance, as Speaker n and SPEAKER_0n."""
    first = segments.groupBy("meeting_id", cluster).agg(F.min(F.struct("start_s", "end_s", "idx")).alias("first"))
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("first"))
    return first.select("meeting_id", cluster, n.alias("number"), F.concat(F.lit("Speaker "), n.cast("string")).alias("speaker"), F.format_string("SPEAKER_%02d", n).alias("cluster_id"))
