"""Queries on transcript segments, languages and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions import text as T
from confab.functions.words import AMBIGUOUS, ENGLISH, KEYWORD_STOPWORDS, ROMANIAN
from confab.operators import folds, intervals, speech
from confab.operators import segments as S

from . import tables as t
from .registry import query

DISPLAY = "select segment_id, coalesce(case when idx % 5 = 0 then '' end, case when idx % 2 = 0 then lower(text) end, text) as shown, case when printable_name then confirmed_display_name else speaker end as speaker_shown from "


@query(DISPLAY + t.SEGMENTS)
def display_layers(spark, sf):
    s = t.segments(spark, sf).withColumns({"raw_text": F.col("text"), "normalized_text": F.when(F.col("idx") % 2 == 0, F.lower("text")), "corrected_text": F.when(F.col("idx") % 5 == 0, "")})
    return s.select("segment_id", S.display_text().alias("shown"), S.display_speaker().alias("speaker_shown"))


@query(f"select segment_id, 'named_without_name' as rule from {t.SEGMENTS} where attribution_state = 'confirmed' and meeting_id % 6 = 0 union all select segment_id, 'printable_without_decision' from {t.SEGMENTS} where attribution_state = 'suggested' and idx = 1")
def attribution_violations(spark, sf):
    s = t.segments(spark, sf).withColumns({"confirmed_display_name": F.when(F.col("meeting_id") % 6 != 0, F.col("confirmed_display_name")), "printable_name": F.col("printable_name") | ((F.col("attribution_state") == "suggested") & (F.col("idx") == 1))})
    return S.attribution_violations(s)


@query(f"select segment_id, case when attribution_state = 'anonymous' then 'Old name' end as legacy_name, case when attribution_state <> 'anonymous' then 'Old name' end as confirmed_display_name from {t.SEGMENTS}")
def attribution_migration(spark, sf):
    return S.migrated_attribution(t.segments(spark, sf).withColumn("confirmed_display_name", F.lit("Old name"))).select("segment_id", "legacy_name", "confirmed_display_name")


@query(f"select segment_id from {t.SEGMENTS} where attribution_state = 'confirmed' or idx = 3")
def human_attributed(spark, sf):
    return S.human_attributed(t.segments(spark, sf).withColumn("speaker_id", F.when(F.col("idx") == 3, "p1"))).select("segment_id")


@query(f"select segment_id, case when compression_ratio > 2.4e0 or avg_logprob < -1.5e0 or no_speech_prob > 0.85e0 or not regexp_matches(text, '\\p{{L}}') or (length(text) >= 10 and length(text) / greatest(end_s - start_s, 0.01e0) > 40) then 'low_confidence_asr' end as reason from {t.SEGMENTS}")
def garbage_flags(spark, sf):
    return t.segments(spark, sf).select("segment_id", S.garbage_reason().alias("reason"))


@query(f"select segment_id, case when avg_logprob < -1.1e0 then 'unclear_speech' when regexp_matches(text, '[0-9]') then 'contains_numbers' when regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)') then 'critical_term:the' end as reason from {t.SEGMENTS}")
def review_flags(spark, sf):
    return t.segments(spark, sf).select("segment_id", S.review_flag(["the"]).alias("reason"))


@query(f"select segment_id, round(start_s + meeting_id, 2) as start_s, round(end_s + meeting_id, 2) as end_s from {t.SEGMENTS}")
def stitched_times(spark, sf):
    return S.shifted(t.segments(spark, sf).withColumn("window_start", F.col("meeting_id").cast("double"))).select("segment_id", "start_s", "end_s")


@query(f"select segment_id from {t.SEGMENTS} where language = 'ro' and contains(lower(text), 'an')")
def segment_search(spark, sf):
    return S.search(t.segments(spark, sf), "AN", language="ro").select("segment_id")


@query(f"select segment_id from {t.SEGMENTS} where start_s < 20 and end_s > 10")
def excerpt(spark, sf):
    return S.excerpt(t.segments(spark, sf), 10.0, 20.0).select("segment_id")


@query(f"with p as (select distinct meeting_id, meeting_id % 40 + 0.5e0 as position_s from {t.SEGMENTS}), m as (select p.meeting_id, p.position_s, s.segment_id, row_number() over (partition by p.meeting_id order by s.start_s, s.idx) as n from p join {t.SEGMENTS} s on p.meeting_id = s.meeting_id and p.position_s >= s.start_s and p.position_s < s.end_s) select meeting_id, position_s, segment_id from m where n = 1")
def playback_segment(spark, sf):
    s = t.segments(spark, sf)
    return S.at_playback(s, s.select("meeting_id", (F.col("meeting_id") % 40 + 0.5).alias("position_s")).distinct())


@query(f"with s as (select *, lag(start_s) over (partition by meeting_id order by idx) as before from (select * replace (case when idx = 4 then -1e0 else start_s end as start_s) from {t.SEGMENTS})) select segment_id, 'negative_start' as rule from s where start_s < 0 union all select segment_id, 'beyond_recording' from s where end_s > 60.5e0 union all select segment_id, 'start_goes_back' from s where start_s < before")
def remote_result_violations(spark, sf):
    return S.invalid_results(t.segments(spark, sf).withColumn("start_s", F.when(F.col("idx") == 4, -1.0).otherwise(F.col("start_s"))), 60.0)


_LINES = f"(select meeting_id, idx, speaker, text, coalesce(lag(speaker) over (partition by meeting_id order by idx) <> speaker, true) as turn_start from {t.SEGMENTS})"


@query(f"select meeting_id, idx, turn_start, idx || case when turn_start then ' S' || right(speaker, 1) || ':' else '' end || ' ' || text as line from {_LINES}")
def indexed_lines(spark, sf):
    return S.indexed_lines(t.segments(spark, sf))


@query(f"select meeting_id, idx from {_LINES} where turn_start")
def turn_starts(spark, sf):
    return S.turn_starts(t.segments(spark, sf))


@query("with e as (select user_id as meeting_id, event_id, value as start_s, lag(value) over (partition by user_id order by event_id) as before_s from events) select event_id, start_s, before_s from e where start_s < before_s")
def monotonic_violations(spark, sf):
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("meeting_id"), "event_id", F.col("event_id").alias("idx"), F.col("event_id").alias("segment_id"), F.col("value").alias("start_s"))
    return S.going_back(e).select("event_id", "start_s", "before_s")


@query(f"with s as (select meeting_id, len(list_filter(regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> '')) as w, end_s, case language when 'mixed' then ['ro', 'en'] when 'und' then [] else [language] end as ls from {t.SEGMENTS}), g as (select meeting_id, cast(sum(w) as bigint) as words, max(end_s) as end_s, list_sort(list_distinct(flatten(list(ls)))) as found from s group by meeting_id) select meeting_id, words, end_s, case when len(found) > 0 then array_to_string(found, ',') else 'ro' end as languages from g")
def transcript_stats(spark, sf):
    return S.transcript_stats(t.segments(spark, sf).withColumn("spans", F.array(F.lit("ro"), F.lit("en"))))


@query("select lang as language, count(*) as segments from documents group by lang")
def language_histogram(spark, sf):
    return S.language_histogram(t.table(spark, sf, "documents").withColumnRenamed("lang", "language"))


@query("with e as (select user_id as meeting_id, value as d, abs(value - lag(value) over w) < 1e-9 as touch, event_type = lag(event_type) over w as again, value from events window w as (partition by user_id order by event_id)) select meeting_id, count(*) as segments, count(*) filter (where abs(d - round(d)) < 1e-9) as integer_durations, count(*) filter (where touch) as zero_gaps, round(avg(value), 4) as mean_logprob, count(*) filter (where again) as repeated_texts from e group by meeting_id")
def run_statistics(spark, sf):
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("idx"), F.col("event_id").alias("segment_id"), F.col("value").alias("start_s"), F.col("value").alias("end_s"), F.col("value").alias("avg_logprob"), F.col("event_type").alias("text"))
    # the duration is the value here
    w = S.in_order()
    marked = e.select("meeting_id", "avg_logprob", F.col("end_s").alias("d"), (F.abs(F.col("start_s") - F.lag("end_s").over(w)) < 1e-9).alias("touch"), (F.col("text") == F.lag("text").over(w)).alias("again"))
    return S.summed_run(marked)


@query(f"with g as (select meeting_id, speaker, sum(speech_seconds) as seconds, count(*) as turns from {t.SEGMENTS} group by all) select meeting_id, speaker, round(seconds, 6) as seconds, turns, round(seconds / sum(seconds) over (partition by meeting_id), 6) as share from g")
def speaker_share(spark, sf):
    return S.speech_share(t.segments(spark, sf)).withColumns({"seconds": F.round("seconds", 6), "share": F.round("share", 6)})


@query(f"with g as (select meeting_id, speaker, sum(speech_seconds) as seconds, min(idx) as first from {t.SEGMENTS} group by all), r as (select *, row_number() over (partition by meeting_id order by seconds desc, first) as n from g) select meeting_id, speaker from r where n = 1")
def dominant_speaker(spark, sf):
    return S.dominant_label(t.segments(spark, sf))


def _in(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


_RO, _EN = _in(set(ROMANIAN) - AMBIGUOUS), _in(set(ENGLISH) - AMBIGUOUS)
_LID = f"""
with a as (select doc_id, text, len(regexp_extract_all(text, '{T.CYRILLIC}')) as cyr, len(regexp_extract_all(text, '{T.LATIN}')) as lat,
  list_transform(regexp_extract_all(text, '\\p{{L}}+(?:[-'']\\p{{L}}+)*'), lambda w: lower(w)) as ws, len(regexp_extract_all(text, '{T.DIACRITICS}')) as dia from documents),
b as (select doc_id, cyr + lat as letters, case when cyr + lat > 0 then cyr / (cyr + lat)::double else 0 end as ratio,
  len(list_filter(ws, lambda w: list_contains({_RO}, w))) + 2e0 * dia as ro0, len(list_filter(ws, lambda w: list_contains({_EN}, w)))::double as en0 from a),
c as (select doc_id, letters, ratio, case when ratio < 0.15e0 then ro0 else 0e0 end as ro, case when ratio < 0.15e0 then en0 else 0e0 end as en from b)
select doc_id, case when letters = 0 then 'und' when ratio > 0.6e0 then 'ru' when ratio >= 0.15e0 then 'mixed' when ro + en = 0 then 'und' when ro >= en then 'ro' else 'en' end as language,
  round(case when letters = 0 then 1e0 when ratio > 0.6e0 then least(1e0, 0.5e0 + ratio / 2) when ratio >= 0.15e0 then greatest(0.5e0, least(1e0, 0.5e0 + (1e0 - abs(ratio - 0.375e0) / 0.225e0) / 2)) when ro + en = 0 then 0e0
    else abs(ro - en) / (ro + en) * (0.5e0 + 0.5e0 * least(1e0, (ro + en) / 4e0)) end, 3) as confidence, ro as ro_score, en as en_score, letters::bigint as letters from c
"""


@query(_LID)
def text_language_id(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", T.text_language("text").alias("lid"))
    return d.select("doc_id", "lid.language", "lid.confidence", "lid.ro_score", "lid.en_score", "lid.letters")


_RECONCILED = f"""
with l as ({_LID}), w as (select l.*, case doc_id % 3 when 0 then 'ro' when 1 then 'ru' else 'en' end as acoustic, (doc_id % 50) / 50e0 as p1, doc_id % 7 = 0 as forced from l),
f as (select *, language in ('ro', 'ru', 'en') and language <> acoustic and confidence >= 0.7e0 as other from w)
select doc_id, case when language = 'und' and letters = 0 then 'und' when language = 'und' then acoustic when language = 'mixed' then 'mixed' when forced or p1 < 0.7e0 or other then acoustic else acoustic end as window_language,
  round(case when language = 'und' and letters = 0 then 0e0 when language = 'und' then p1 when language = 'mixed' then confidence else p1 end, 3) as window_confidence,
  language not in ('und', 'mixed') and not forced and (p1 < 0.7e0 or other) as rescore from f
"""


@query(_RECONCILED)
def reconciled_language(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", T.text_language("text").alias("text_lid"), F.element_at(F.array(F.lit("ro"), F.lit("ru"), F.lit("en")), (F.col("doc_id") % 3 + 1).cast("int")).alias("acoustic_language"), (F.col("doc_id") % 50 / 50.0).alias("p1"), (F.col("doc_id") % 7 == 0).alias("forced"))
    r = d.select("doc_id", S.reconciled_language().alias("r"))
    return r.select("doc_id", F.col("r.language").alias("window_language"), F.col("r.confidence").alias("window_confidence"), F.col("r.rescore").alias("rescore"))


@query("with d as (select event_id // 3 as window_id, event_id % 3 as attempt, event_type as language, -value as lp from events), r as (select *, row_number() over (partition by window_id order by lp desc, attempt) as n, min(lp) over (partition by window_id) as worst, count(*) over (partition by window_id) as c from d) select window_id, language, attempt, round(least(1e0, 0.5e0 + greatest(0e0, case when c > 1 then lp - worst else 1e0 end)), 3) as confidence from r where n = 1")
def better_decode(spark, sf):
    d = t.table(spark, sf, "events").select(F.floor(F.col("event_id") / 3).cast("long").alias("window_id"), (F.col("event_id") % 3).alias("attempt"), F.col("event_type").alias("language"), (-F.col("value")).alias("mean_logprob"))
    return S.better_decode(d.select("window_id").distinct(), d)


@query("select event_id, len(list_filter(['view', 'click'], lambda x: x = event_type)) > 0 as echo from events")
def hotword_echo(spark, sf):
    return t.table(spark, sf, "events").select("event_id", S.hotword_echo(F.col("event_type"), F.lit("View, click,")).alias("echo"))


@query("with p as (select event_id, case when event_type = 'view' then 0e0 else value end as ro, value / 2 as en from events) select event_id, case when ro >= en then 'ro' else 'en' end as best, round(case when ro + en > 0 then greatest(ro, en) / (ro + en) else 0.5e0 end, 6) as p from p")
def restricted_languages(spark, sf):
    e = t.table(spark, sf, "events")
    probs = F.create_map(F.lit("ro"), F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value")), F.lit("en"), F.col("value") / 2, F.lit("fr"), F.lit(9.0))
    r = e.select("event_id", T.restricted_probabilities(probs, ["ro", "en"])[0].alias("r"))
    return r.select("event_id", F.col("r.language").alias("best"), F.round("r.p", 6).alias("p"))


_WORDS = f"""(select segment_id, generate_subscripts(ws, 1) - 1 as pos, unnest(ws) as word from (select segment_id, regexp_split_to_array(text, '[ \\n]+') as ws from {t.SEGMENTS}))"""
_RUNS = f"""
with w as (select segment_id, pos, word, pos * 0.5e0 as start_s, pos * 0.5e0 + 0.4e0 as end_s, lower(trim(word)) as low from {_WORDS} where word <> ''),
k as (select *, case when regexp_matches(word, '{T.CYRILLIC}') and not regexp_matches(word, '{T.LATIN}') then 'ru' when regexp_matches(word, '{T.CYRILLIC}') or not regexp_matches(word, '{T.LATIN}') then null
  when regexp_matches(word, '{T.DIACRITICS}') or list_contains({_RO}, low) then 'ro' when list_contains({_EN}, low) then 'en' end as own from w),
f as (select *, coalesce(last_value(own ignore nulls) over (partition by segment_id order by pos), first_value(own ignore nulls) over (partition by segment_id order by pos rows between current row and unbounded following)) as language from k),
n as (select *, case when lag(language) over (partition by segment_id order by pos) = language then 0 else 1 end as fresh from f where language is not null),
r as (select *, sum(fresh) over (partition by segment_id order by pos) as run from n)
select segment_id, run::bigint as run, language, round(min(start_s), 2) as start_s, round(max(end_s), 2) as end_s from r group by all
"""


@query(_RUNS)
def language_runs(spark, sf):
    w = t.segments(spark, sf).select("segment_id", F.posexplode(F.split("text", "[ \\n]+")).alias("pos", "word")).where("word <> ''")
    return S.language_runs(w.withColumns({"start_s": F.col("pos") * 0.5, "end_s": F.col("pos") * 0.5 + 0.4}))


@query("select doc_id, cast(case when length(text) = 0 then 0 else ceil(length(text) / 2e0) end as bigint) as tokens from documents")
def token_estimate(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@query(f"with w as (select conv_id, turn, list_filter(regexp_extract_all(text, '\\p{{L}}+'), lambda x: length(x) >= 3 and regexp_full_match(x, '[A-Za-zĂăÂâÎîȘșȚțА-Яа-яЁё]+')) as ws from conversations), k as (select conv_id, turn, generate_subscripts(ws, 1) as pos, unnest(ws) as w from w), f as (select conv_id, turn, lower(w) as low, min(pos) as pos from k group by all) select conv_id, turn, count(*) as keywords from f where not list_contains({_in(KEYWORD_STOPWORDS)}, low) group by all")
def keyword_terms(spark, sf):
    k = t.table(spark, sf, "conversations").select("conv_id", "turn", F.size(T.keyword_list("text")).cast("long").alias("keywords"))
    return k.where("keywords > 0")


@query("select doc_id, regexp_replace(trim(regexp_replace(regexp_replace(lower(text), '[.,;:!?\"''“”«»()\\[\\]{}]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), '^$', '') as form from documents")
def scoring_form(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", T.scoring_form("text").alias("form"))


# --- intervals ------------------------------------------------------------------------


@query(f"with o as (select s.meeting_id, s.segment_id, w.idx % 3 as label, least(s.end_s, w.end_s + 3) - greatest(s.start_s, w.start_s + 3) as o from {t.SEGMENTS} s join {t.SEGMENTS} w using (meeting_id)), g as (select meeting_id, segment_id, label, sum(o) as sec from o where o > 0 group by all), r as (select *, sum(sec) over (partition by meeting_id, segment_id) as speech, row_number() over (partition by meeting_id, segment_id order by sec desc, label) as n from g) select meeting_id, segment_id, max(label) filter (where n = 1)::bigint as label, round(max(speech), 6) as speech_s, round(max(sec) filter (where n = 1) / max(speech), 6) as share, round(coalesce(max(sec) filter (where n = 2) / max(speech), 0), 6) as second_share from r group by all")
def interval_overlap_label(spark, sf):
    s = t.segments(spark, sf)
    windows = s.select("meeting_id", (F.col("idx") % 3).cast("long").alias("label"), (F.col("start_s") + 3).alias("start_s"), (F.col("end_s") + 3).alias("end_s"))
    # as the SQL rounds: F.round takes the shortest decimal that reads as the number, which can be a half where the number is below it
    return intervals.overlap_labels(s, windows).withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in ("speech_s", "share", "second_share")})


@query(f"with p as (select distinct meeting_id, meeting_id * 10 + k as point_id, 2.9e0 * k as at_s from {t.SEGMENTS}, range(0, 20) r(k)), d as (select p.meeting_id, p.point_id, i.idx, case when p.at_s < i.start_s then i.start_s - p.at_s when p.at_s > i.start_s + 1.5e0 then p.at_s - (i.start_s + 1.5e0) else 0e0 end as d from p join {t.SEGMENTS} i using (meeting_id)), r as (select *, row_number() over (partition by meeting_id, point_id order by round(d, 9), idx) as n from d) select meeting_id, point_id, idx::bigint as interval_id, round(d, 6) as distance_s from r where n = 1")
def nearest_interval(spark, sf):
    s = t.segments(spark, sf)
    points = s.select("meeting_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("meeting_id", (F.col("meeting_id") * 10 + F.col("k")).alias("point_id"), (2.9 * F.col("k")).alias("at_s"))
    found = intervals.nearest_interval(points, s.select("meeting_id", F.col("idx").cast("long").alias("interval_id"), "start_s", (F.col("start_s") + 1.5).alias("end_s")))
    return found.withColumn("distance_s", F.round("distance_s", 6))


@query(f"with r as (select meeting_id, region_id, start_s, end_s, greatest(1, ceil((end_s - start_s) / 900e0))::bigint as n from {t.REGIONS} where end_s > start_s), p as (select *, unnest(range(0, n)) as part from r) select meeting_id, region_id, part::int as part, start_s + part * (end_s - start_s) / n as start_s, case when part = n - 1 then end_s else start_s + (part + 1) * (end_s - start_s) / n end as end_s from p")
def equal_split_windows(spark, sf):
    return intervals.equal_parts(t.regions(spark, sf).drop("label"), 900.0)


@query(f"with l as (select meeting_id, region_id, end_s - start_s as len from {t.REGIONS}), f as (select *, greatest(0, floor((len - 600) / 300 + 1e-9) + 1)::bigint as n from l), t as (select *, case when n = 0 then 0e0 else n * 300e0 end as tail from f) select meeting_id, region_id, (n + case when n = 0 or len - tail >= 300 then 1 else 0 end)::bigint as windows from t where n > 0 or len > 0")
def sliding_windows(spark, sf):
    w = intervals.sliding(t.regions(spark, sf), 600.0, 300.0)
    return w.groupBy("meeting_id", "region_id").agg(F.count("*").alias("windows"))


_ISLANDS = f"with r as (select *, max(end_s) over (partition by meeting_id order by start_s, end_s rows between unbounded preceding and 1 preceding) as reached from {t.REGIONS}), n as (select *, sum(case when start_s - reached < 600 then 0 else 1 end) over (partition by meeting_id order by start_s, end_s rows unbounded preceding) as run from r)"


@query(_ISLANDS + " select meeting_id, run::bigint as run, min(start_s) as start_s, max(end_s) as end_s, count(*) as regions from n group by all")
def gap_islands(spark, sf):
    return intervals.islands(t.regions(spark, sf), 600.0)


@query(f"with seg as (select meeting_id, start_s, end_s from {t.SEGMENTS}), reg as (select meeting_id, idx as region_id, start_s + 2 as start_s, start_s + 7 as end_s from {t.SEGMENTS}), e as (select meeting_id, start_s as at from seg union select meeting_id, end_s from seg), c as (select r.meeting_id, r.region_id, e.at from reg r join e on e.meeting_id = r.meeting_id and e.at > r.start_s and e.at < r.end_s union select meeting_id, region_id, start_s from reg), p as (select c.meeting_id, c.region_id, c.at as start_s, coalesce(lead(c.at) over (partition by c.meeting_id, c.region_id order by c.at), r.end_s) as end_s from c join reg r using (meeting_id, region_id)) select meeting_id, region_id::bigint as region_id, round(start_s, 6) as start_s, round(end_s, 6) as end_s, exists (select 1 from seg s where s.meeting_id = p.meeting_id and (p.start_s + p.end_s) / 2 between s.start_s and s.end_s) as inside from p")
def region_intersection(spark, sf):
    s = t.segments(spark, sf)
    regions = s.select("meeting_id", F.col("idx").cast("long").alias("region_id"), (F.col("start_s") + 2).alias("start_s"), (F.col("start_s") + 7).alias("end_s"))
    return intervals.regions_in_segments(regions, s).withColumns({c: F.round(c, 6) for c in ("start_s", "end_s")})


@query(f"with f as (select meeting_id, cluster_id, start_s, end_s, idx, row_number() over (partition by meeting_id, cluster_id order by start_s, end_s, idx) as n from {t.SEGMENTS}), r as (select meeting_id, cluster_id as cluster, row_number() over (partition by meeting_id order by start_s, end_s, idx) as number from f where n = 1) select meeting_id, cluster, number::int as number, 'Speaker ' || number as speaker, 'SPEAKER_0' || number as cluster_id from r")
def numbered_clusters(spark, sf):
    return S.numbered_clusters(t.segments(spark, sf).withColumnRenamed("cluster_id", "cluster"), "cluster")


_VAD = f"select meeting_id, start_s / 300 as start_s, end_s / 300 as end_s from {t.REGIONS}"
_PIECES = """select {key}, unnest(range(0, greatest(n, 1))) as k, case when n > 1 then round(a + k * (b - a) / n, 3) else a end as start_s, case when n > 1 then round(a + (k + 1) * (b - a) / n, 3) else b end as end_s from (select {key}, {a} as a, {b} as b, ceil(({b} - {a}) / {most}e0)::int as n from {rows})"""
# Each step of a recursion decides on one more row of every recording.
_PACKED = f"""
with recursive cut as ({_PIECES.format(key="meeting_id", a="start_s", b="end_s", most=28, rows=f"({_VAD} where end_s > start_s)")}),
p as (select *, row_number() over (partition by meeting_id order by start_s, end_s) as n from cut),
w as (
  select meeting_id, n, 1 as win, start_s as a, end_s as b from p where n = 1
  union all
  select meeting_id, p.n, case when takes then win else win + 1 end, case when takes then a else start_s end, end_s
  from (select w.*, p.n as m, p.start_s, p.end_s, p.start_s - w.b <= 3 and p.end_s - w.a <= case when w.b - w.a < 1.5e0 then 20 else 12 end as takes from w join p on p.meeting_id = w.meeting_id and p.n = w.n + 1) x join (select meeting_id, n from p) p using (meeting_id) where p.n = x.m
),
g as (select meeting_id, win, min(w.a) as a, arg_max(w.b, n) as b, count(*) as regions, sum(end_s - start_s) as speech from w join p using (meeting_id, n) group by all),
j as (
  select meeting_id, win, 0 as k, a from g where win = 1
  union all
  select meeting_id, g.win, case when g.b - g.a < 1.5e0 and g.b - j.a <= 28 then k else k + 1 end, case when g.b - g.a < 1.5e0 and g.b - j.a <= 28 then j.a else g.a end from j join g using (meeting_id) where g.win = j.win + 1
)
select meeting_id, k::int as "window", min(g.a) as start_s, arg_max(g.b, win) as end_s, sum(regions)::int as regions, round(sum(speech), 6) as speech_s from j join g using (meeting_id, win) group by meeting_id, k
"""


@query(_PACKED)
def pack_windows(spark, sf):
    r = t.regions(spark, sf).withColumns({"start_s": F.col("start_s") / 300, "end_s": F.col("end_s") / 300})
    return folds.packed_windows(r.where("end_s > start_s")).withColumn("speech_s", F.round("speech_s", 6))


_MERGED = f"""
with recursive p as (select *, row_number() over (partition by meeting_id order by start_s, end_s) as n from ({_VAD})),
m as (
  select meeting_id, n, 1 as run, start_s as a, end_s as b from p where n = 1
  union all
  select meeting_id, p.n, case when start_s - b < 0.45e0 and end_s - a <= 12 then run else run + 1 end, case when start_s - b < 0.45e0 and end_s - a <= 12 then a else start_s end, end_s from m join p using (meeting_id) where p.n = m.n + 1
),
g as (select meeting_id, run, min(a) as a, arg_max(b, n) as b from m group by all)
select meeting_id, (row_number() over (partition by meeting_id order by run, k) - 1)::int as region, start_s, end_s from ({_PIECES.format(key="meeting_id, run", a="a", b="b", most=12, rows="g")})
"""


@query(_MERGED)
def merged_vad_regions(spark, sf):
    return folds.merged_regions(t.regions(spark, sf).withColumns({"start_s": F.col("start_s") / 300, "end_s": F.col("end_s") / 300}))


_HEARD = """
with recursive f as (select user_id as meeting_id, least(1e0, value / 150) as p, row_number() over (partition by user_id order by event_id) as n from events),
h as (
  select 0::bigint as n, meeting_id, null::double as since, null::double as quiet, null::double as a, null::double as b from f where n = 1
  union all
  select n, meeting_id, case when since is null then case when p >= 0.5e0 then here end when overlong then stop when ended then null else since end,
    case when since is null or overlong or ended or p >= 0.5e0 then null when p >= 0.35e0 then quiet else coalesce(quiet, here) end,
    case when overlong or ended then since end, case when overlong then stop when ended then coalesce(quiet, here) end
  from (select *, since is not null and p >= 0.35e0 and stop - since >= 20 as overlong, since is not null and p < 0.35e0 and stop - coalesce(quiet, here) >= 0.4e0 as ended
    from (select f.n, f.meeting_id, f.p, h.since, h.quiet, (f.n - 1) * 0.032e0 as here, (f.n - 1) * 0.032e0 + 0.032e0 as stop from h join f on f.meeting_id = h.meeting_id and f.n = h.n + 1))
),
l as (select meeting_id, max(n) * 0.032e0 as stop, arg_max(coalesce(since, -1e0), n) as open from h group by 1),
s as (select meeting_id, a, b from h where a is not null union all select meeting_id, open, stop from l where open >= 0 and open < stop),
k as (select *, lag(b) over w as before, lead(a) over w as after, row_number() over w as r from s join l using (meeting_id) where b - a >= 0.25e0 window w as (partition by meeting_id order by a))
select meeting_id, (r - 1)::int as region, round(a - least(0.2e0, coalesce((a - before) / 2, a)), 3) as start_s, round(b + least(0.2e0, coalesce((after - b) / 2, stop - b)), 3) as end_s from k
"""


_WINDOW_STATS = """
with w as (select conv_id as m, case (turn * 7 + conv_id) % 5 when 0 then 'ro' when 1 then 'ru' when 2 then 'en' when 3 then 'und' else 'ro' end as l, case (turn * 3 + conv_id) % 6 when 0 then 'ro' when 1 then 'ru' when 2 then 'en' when 3 then 'mixed' when 4 then 'und' end as tl, turn % 4 as s, turn % 3 = 1 as i, turn % 5 = 2 as r, turn % 7 = 3 as e, length(text) as c from conversations),
c as (select m, l, count(*) as n from w group by all union all select m, l, 0 from (select distinct m from w), (select unnest(['ro', 'ru', 'en']) as l)),
k as (select m, string_agg(l || '=' || n, ',' order by l) as langs from (select m, l, sum(n)::bigint as n from c group by all) group by 1),
d as (select *, s > 0 and tl not in ('und', 'mixed') and l in ('ro', 'ru', 'en') as ok from w)
select m as meeting_id, count(*) as windows, langs, count(*) filter (where i) as inherited_windows, count(*) filter (where r) as rescored_windows, count(*) filter (where e) as echoed_windows,
  round(case when count(*) filter (where ok) > 0 then count(*) filter (where ok and tl = l) / (count(*) filter (where ok))::double end, 3) as agreement, round(case when sum(c) % 4 <> 0 then count(*) / (sum(c) / 15e0) end, 4) as rtf
from d join k using (m) group by m, langs
"""


@query(_WINDOW_STATS)
def window_statistics(spark, sf):
    """Turns as decoded windows; a fourth of the recordings has no length."""
    c = t.table(spark, sf, "conversations")
    pick = lambda at, names: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    w = c.select(F.col("conv_id").alias("meeting_id"), pick((F.col("turn") * 7 + F.col("conv_id")) % 5, ("ro", "ru", "en", "und", "ro")).alias("language"), pick((F.col("turn") * 3 + F.col("conv_id")) % 6, ("ro", "ru", "en", "mixed", "und", None)).alias("text_language"), (F.col("turn") % 4).alias("segments"), (F.col("turn") % 3 == 1).alias("inherited"), (F.col("turn") % 5 == 2).alias("rescored"), (F.col("turn") % 7 == 3).alias("echoed"))
    chars = F.sum(F.length("text"))
    timings = c.groupBy(F.col("conv_id").alias("meeting_id")).agg(F.when(chars % 4 != 0, chars / 15).otherwise(0.0).alias("audio_seconds"), F.count("*").cast("double").alias("total_seconds"))
    s = S.window_statistics(w, timings)
    langs = F.array_join(F.transform(F.map_entries("window_languages"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return s.withColumn("langs", langs).drop("window_languages")


@query(_HEARD)
def hysteresis_regions(spark, sf):
    f = t.table(spark, sf, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("frame"), F.least(F.lit(1.0), F.col("value") / 150).alias("probability"))
    return speech.detected_speech(f)


@query()
def build_chunks(spark, sf):
    return folds.chunks(S.indexed_lines(t.segments(spark, sf)), budget=300, overlap=80)


_INHERITED = f"""
with w as (select meeting_id, idx, case (meeting_id + idx) % 3 when 0 then 'ro' when 1 then 'ru' else 'en' end as language, end_s - start_s < 4 as short, row_number() over (partition by meeting_id order by idx) as n from {t.SEGMENTS})
select meeting_id, idx as "window", last_value(case when n = 1 or not short then language end ignore nulls) over (partition by meeting_id order by n rows unbounded preceding) as language, short and n > 1 as inherited from w
"""


@query(_INHERITED)
def inherited_languages(spark, sf):
    kind = (F.col("meeting_id") + F.col("idx")) % 3
    s = t.segments(spark, sf).select("meeting_id", F.col("idx").alias("window"), "start_s", "end_s", F.when(kind == 0, "ro").when(kind == 1, "ru").otherwise("en").alias("language"))
    return folds.inherited_languages(s)


_REPAIRED = f"""
with recursive s as (select *, lead(speaker) over w as other, lead(start_s) over w as next_start, lead(end_s) over w as next_end, row_number() over w as n from {t.SEGMENTS} window w as (partition by meeting_id order by start_s, end_s, segment_id)),
p as (select meeting_id, segment_id, n, start_s, end_s, next_start, round((end_s + next_start) / 2, 3) as middle, coalesce(speaker <> other and end_s > next_start and middle < next_end - 0.1e0, false) as meets from s),
r as (
  select meeting_id, n, start_s as here from p where n = 1
  union all
  select meeting_id, n + 1, case when meets and here + 0.1e0 < middle then middle else next_start end from r join p using (meeting_id, n) where next_start is not null
)
select meeting_id, segment_id, here as start_s, case when meets and here + 0.1e0 < middle then middle else end_s end as end_s from r join p using (meeting_id, n)
"""


@query(_REPAIRED)
def overlap_repair(spark, sf):
    return folds.repaired_overlaps(t.segments(spark, sf).select("meeting_id", "segment_id", "start_s", "end_s", "speaker"))
