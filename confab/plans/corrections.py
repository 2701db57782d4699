"""Queries on the learning loop, evaluation, and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions import text as T
from confab.operators import evaluation as E
from confab.operators import learning as L
from confab.streaming import streams

from . import tables as t
from .registry import query

_LATEST = f"""(select event_id, arg_max(seq, seq) as seq, arg_max(meeting_id, seq) as meeting_id, arg_max(edit_kind, seq) as edit_kind, arg_min(created_at, seq) as created_at, arg_max(verification_status, seq) as verification_status,
arg_max(audio_start, seq) as audio_start, arg_max(audio_end, seq) as audio_end, arg_max(speaker_cluster, seq) as speaker_cluster, arg_max(new_text, seq) as new_text from {t.CORRECTIONS} group by 1)"""


@query(f"select * from {_LATEST}")
def catalog_upsert_latest(spark, sf):
    """arg_max skips nulls, as kept columns do; the other columns have none."""
    return L.upserted(t.corrections(spark, sf)).select("event_id", "seq", "meeting_id", "edit_kind", "created_at", "verification_status", "audio_start", "audio_end", "speaker_cluster", "new_text")


@query(f"select seq from {t.CORRECTIONS} where verification_status = 'verified' order by created_at desc, event_id desc limit 100")
def event_list(spark, sf):
    return L.listed(t.corrections(spark, sf), status="verified").select("seq")


@query(f"select seq, trim(new_text) as label, round(audio_end - audio_start, 3) as duration from {t.CORRECTIONS} where verification_status = 'verified' and verified_against_audio and training_reuse_allowed and audio_end > audio_start and audio_end - audio_start between 2 and 28 and trim(new_text) <> ''")
def usable_clips(spark, sf):
    return L.usable_clips(t.corrections(spark, sf)).select("seq", "label", "duration")


_VERDICTS = f"""(select seq as event_id, case when meeting_id % 7 = 0 then 'transcript_not_found' when s.segment_id is null then 'segment_not_found' when trim(new_text) = '' then 'empty_deletion' when edit_kind = 'translation' then 'edit_kind_translation_ineligible' end as bad, edit_kind
from (select * replace (case edit_kind when 'error' then 'translation' else edit_kind end as edit_kind) from {t.CORRECTIONS}) c left join (select distinct meeting_id, segment_id from {t.SEGMENTS}) s using (meeting_id, segment_id))"""


def _verdicts(spark, sf):
    e = t.corrections(spark, sf).withColumns({"event_id": F.col("seq"), "edit_kind": F.when(F.col("edit_kind") == "error", "translation").otherwise(F.col("edit_kind"))})
    m = e.where("meeting_id % 7 <> 0").select("meeting_id")
    return L.collection_verdicts(e, m, t.segments(spark, sf))


@query(f"select event_id, case when bad is null then 'collected' else 'ineligible' end as status, coalesce(bad, 'reviewer_' || edit_kind) as reason from {_VERDICTS}")
def eligibility_verdicts(spark, sf):
    return _verdicts(spark, sf)


@query(f"select count(*) as checked, count(*) filter (where bad is null) as collected, count(*) filter (where bad is not null) as ineligible, 0::bigint as errors from {_VERDICTS}")
def reconciliation_counts(spark, sf):
    return L.verdict_counts(_verdicts(spark, sf))


_OK = "verification_status = 'verified' and verified_against_audio and training_reuse_allowed"


@query(f"select count(*) as total, count(*) filter (where verification_status = 'unverified') as unverified, count(*) filter (where verification_status = 'rejected') as rejected, count(distinct event_id) filter (where {_OK}) as events, count(distinct meeting_id) filter (where {_OK}) as meetings, count(distinct coalesce(speaker_cluster, 'unknown')) filter (where {_OK}) as speakers from {t.CORRECTIONS}")
def distinct_accepted(spark, sf):
    return L.accepted_counts(t.corrections(spark, sf))


@query(f"select round(sum(greatest(0, coalesce(audio_end, 0) - coalesce(audio_start, 0))), 4) as seconds from {t.CORRECTIONS} where verification_status = 'verified' and training_reuse_allowed")
def eligible_duration(spark, sf):
    return L.eligible_seconds(t.corrections(spark, sf)).select(F.round("seconds", 4).alias("seconds"))


@query(f"select seq, case when meeting_id % 3 <> seq % 3 then 'stale_revision' when seq % 6 = 0 then 'obsolete_text' when edit_kind = 'error' then 'kind_not_allowed' when seq % 5 = 0 then 'no_consent' else 'verified' end as verdict from {t.CORRECTIONS}")
def verification_verdicts(spark, sf):
    e = t.corrections(spark, sf)
    e = e.withColumns({"revision": F.col("meeting_id") % 3, "current_revision": F.col("seq") % 3, "current_text": F.when(F.col("seq") % 6 == 0, "other").otherwise(F.col("new_text")), "edit_kind": F.when(F.col("edit_kind") == "error", "redaction").otherwise(F.col("edit_kind")), "consent_given": F.col("training_reuse_allowed")})
    return e.select("seq", L.verification_verdict().alias("verdict"))


@query("select event_id, case when event_id % 9 = 0 then 'stale_revision' when event_type = 'click' and event_id % 4 = 0 then 'blocked' when event_type = 'click' and event_id % 5 = 0 then 'inactive_person' when event_type = 'click' and event_id % 7 = 0 then 'already_confirmed_elsewhere' else 'accepted' end as verdict from events")
def decision_verdicts(spark, sf):
    e = t.table(spark, sf, "events")
    k = F.col("event_id")
    e = e.withColumns({"expected_revision": F.when(k % 9 == 0, 0).otherwise(1), "current_revision": F.lit(1), "action": F.when(F.col("event_type") == "click", "confirm").otherwise("label"), "blockers": F.when(k % 4 == 0, F.array(F.lit("mixed"))).otherwise(F.array().cast("array<string>")), "person_active": k % 5 != 0, "held_by_other": k % 7 == 0})
    return e.select("event_id", L.decision_verdict().alias("verdict"))


@query("select event_id, event_id % 4 in (0, 3) as valid from events")
def label_checks(spark, sf):
    label = F.get(F.array(F.lit("Dr. House"), F.lit(" x "), F.lit("Speaker 12"), F.lit("Team S")), (F.col("event_id") % 4).cast("int"))
    return t.table(spark, sf, "events").select("event_id", L.valid_label(label).alias("valid"))


_EDITS = """
with recursive e as (select user_id as m, (event_id % 3)::varchar as seg, (event_id // 2)::varchar as req, event_id as seq, event_type as x, case when event_id % 2 = 1 then (event_id // 7) % 4 end as exp, row_number() over (partition by user_id order by event_id) as n from events),
f(m, n, seg, req, seq, verdict, done) as (
select distinct m, 0::bigint, null::varchar, null::varchar, null::bigint, null::varchar, []::struct(req varchar, seg varchar, x varchar)[] from e
union all
select m, n, seg, req, seq, verdict, case when verdict = 'accepted' then list_append(done, {'req': req, 'seg': seg, 'x': x}) else done end from (
select e.m, e.n, e.seg, e.req, e.seq, e.x, f.done, case when e.exp <> len(f.done) then 'stale_revision'
when len(list_filter(f.done, lambda d: d.req = e.req)) > 0 then case when len(list_filter(f.done, lambda d: d.req = e.req and d.seg = e.seg and d.x = e.x)) > 0 then 'repeated' else 'conflict' end
when coalesce(list_filter(f.done, lambda d: d.seg = e.seg)[-1].x, 'view') = e.x then 'no_change' else 'accepted' end as verdict
from f join e on e.m = f.m and e.n = f.n + 1))
select m as meeting_id, seg as segment_id, req as request_id, seq, verdict, len(done)::bigint as revision from f where n > 0
"""


@query(_EDITS)
def edit_verdicts(spark, sf):
    """Every other edit expects a revision, most of them an old one."""
    k = F.col("event_id")
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("meeting_id"), (k % 3).alias("segment_id"), F.floor(k / 2).cast("long").alias("request_id"), k.alias("seq"), F.when(k % 2 == 1, F.floor(k / 7) % 4).alias("expected_revision"), F.lit("view").alias("old_text"), F.col("event_type").alias("new_text"))
    return L.edit_verdicts(e)


@query("select event_id // 3 as request_id, count(distinct event_type) as bodies from events group by 1 having count(distinct event_type) > 1")
def request_conflicts(spark, sf):
    return L.request_conflicts(t.table(spark, sf, "events").select(F.floor(F.col("event_id") / 3).cast("long").alias("request_id"), F.col("event_type").alias("body")))


@query("select event_id from events where event_id % 3 <> 0")
def missed_events(spark, sf):
    e = t.table(spark, sf, "events")
    return L.missed_events(e, e.where("event_id % 3 = 0")).select("event_id")


@query("select event_id, case when event_type in ('click', 'view') then 'failed' else event_type end as status from events")
def reconciled_runs(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", F.col("event_type").alias("status"))
    return L.reconciled_runs(e, ("click", "view"))


@query(f"select seq, case when meeting_id % 10 = 0 then 'revoked' else verification_status end as verification_status, training_reuse_allowed and meeting_id % 10 <> 0 as training_reuse_allowed from {t.CORRECTIONS}")
def status_invalidation(spark, sf):
    e = t.corrections(spark, sf)
    return L.invalidated(e, e.where("meeting_id % 10 = 0")).select("seq", "verification_status", "training_reuse_allowed")


@query(f"select distinct seq % 50 as manifest_id from {t.CORRECTIONS} where meeting_id = 10")
def stale_manifests(spark, sf):
    e = t.corrections(spark, sf).withColumn("event_id", F.col("seq"))
    gone = L.invalidated(e, spark.createDataFrame([(10,)], "meeting_id long"))
    return L.stale_manifests(e.select("event_id", (F.col("seq") % 50).alias("manifest_id")), gone)


@query("select c_custkey as person_id, count(*) as orders from orders join customer on o_custkey = c_custkey where c_nationkey <> 3 group by 1")
def consent_purge(spark, sf):
    o = t.table(spark, sf, "orders").withColumnRenamed("o_custkey", "person_id")
    gone = t.people(spark, sf).where("consent_withdrawn_at is not null")
    return L.purged({"o": o}, gone)["o"].groupBy("person_id").agg(F.count("*").alias("orders"))


@query("with p as (select p_partkey % 300 as rule_id, p_brand as pack, p_size as priority, p_name as canonical, row_number() over (partition by p_partkey % 300 order by p_size desc, p_brand desc, p_partkey desc) as n from part) select rule_id, priority, pack from p where n = 1")
def effective_rules(spark, sf):
    p = t.table(spark, sf, "part").select((F.col("p_partkey") % 300).alias("rule_id"), F.col("p_brand").alias("pack"), F.col("p_size").alias("priority"))
    return L.effective_rules(p)


@query("select p_partkey as rule_id, case when p_partkey % 4 = 0 then 'rolled_back' else 'approved' end as approval from part")
def rule_overrides(spark, sf):
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), F.lit("approved").alias("approval"))
    v = p.where("rule_id % 4 = 0").select("rule_id", F.explode(F.array(F.struct(F.lit("approved").alias("approval"), F.lit(1).alias("at")), F.struct(F.lit("rolled_back").alias("approval"), F.lit(2).alias("at")))).alias("v")).select("rule_id", "v.*")
    return L.overridden_rules(p, v)


def _split(spark, sf):
    d = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id")
    return L.grouped_split(d.select("doc_id", "source", (F.col("doc_id") % 25).alias("speaker_id"), "lang", F.col("n_chars").cast("double").alias("duration")), "source")


@query("with h as (select doc_id, source, ('0x' || substr(md5('42:' || source), 1, 7))::bigint / 268435456e0 as u from documents join labels using (doc_id)) select doc_id, source, case when u < 0.7e0 then 'train' when u < 0.85e0 then 'dev' else 'test' end as split from h")
def grouped_split(spark, sf):
    return _split(spark, sf).select("doc_id", "source", "split")


@query("with g as (select source, row_number() over (order by md5('42:=' || source), source) as r, count(*) over () as n from (select distinct source from documents)), c as (select source, r, greatest(1, round_even(0.7e0 * n, 0)) as a, greatest(1, round_even(0.15e0 * n, 0)) as b, n from g) select doc_id, source, case when r <= a then 'train' when r <= a + b - case when a + b >= n then 1 else 0 end then 'dev' else 'test' end as split from documents join c using (source)")
def exact_split(spark, sf):
    return L.exact_split(t.table(spark, sf, "documents").select("doc_id", "source"), "source")


@query("select 0::bigint as leaking_groups")
def split_leakage(spark, sf):
    return L.leaks(_split(spark, sf), "source").agg(F.count("*").alias("leaking_groups"))


@query("with s as (select doc_id, doc_id % 25 as speaker_id, case when doc_id % 25 < 10 and doc_id % 3 = 0 then 'train' else 'test' end as split from documents) select doc_id from s where split = 'test' and speaker_id not in (select speaker_id from s where split = 'train')")
def speaker_disjoint(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 25).alias("speaker_id"))
    return L.speaker_disjoint(d.withColumn("split", F.when((F.col("speaker_id") < 10) & (F.col("doc_id") % 3 == 0), "train").otherwise("test"))).select("doc_id")


@query("with g as (select lang as language, count(*) as clips, sum(n_chars::double) as seconds from documents group by 1) select language, clips, round(seconds, 3) as seconds, round(seconds / sum(seconds) over (), 3) as share from g")
def dataset_summary(spark, sf):
    return L.dataset_summary(t.table(spark, sf, "documents").select(F.col("lang").alias("language"), F.col("n_chars").cast("double").alias("duration")))


@query("select doc_id as clip_id, 'no_label' as rule from documents where doc_id % 10 = 0 union all select doc_id, 'unknown_split' from documents where doc_id % 10 = 1 union all select doc_id, 'meeting_leak' from documents where doc_id // 2 in (select doc_id // 2 from documents group by 1 having count(distinct doc_id % 10 = 1) > 1) union all select doc_id, 'audio_leak' from documents where doc_id in (select doc_id from documents where false)")
def dataset_violations(spark, sf):
    d = t.table(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"), F.floor(F.col("doc_id") / 2).cast("long").alias("meeting_id"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise("x").alias("label"), F.when(F.col("doc_id") % 10 == 1, "other").otherwise("train").alias("split"), F.sha2(F.col("doc_id").cast("string"), 256).alias("audio_sha256"))
    return L.manifest_violations(d)


_MINED = f"""
with e as (select language, seq, meeting_id, reviewer, edit_kind as v, case when seq % 7 = 0 then 'another' else 'the' end as c from {t.CORRECTIONS}),
g as (select language, v, c, count(*) as occurrences, count(distinct meeting_id) as meetings, count(distinct reviewer) as reviewers from e group by all),
r as (select *, count(*) over (partition by language, v) as targets from g)
select substr(sha256(language || chr(31) || v || chr(31) || c), 1, 16) as rule_id, language, v as variant, c as canonical, occurrences, meetings, reviewers, 'we saw ' || v || ' there' as context, targets = 1 as is_safe, targets > 1 as contradictory from r where occurrences >= 2
"""


@query(_MINED)
def mine_rules(spark, sf):
    e = t.corrections(spark, sf)
    before = F.concat(F.lit("we saw "), F.col("edit_kind"), F.lit(" there"))
    after = F.concat(F.lit("we saw "), F.when(F.col("seq") % 7 == 0, "another").otherwise("the"), F.lit(" there"))
    r = L.mined_rules(e.select("language", F.col("seq").alias("event_id"), "meeting_id", "reviewer", before.alias("raw_text"), F.lit(None).cast("string").alias("previous_text"), after.alias("new_text")))
    return r.select("rule_id", "language", "variant", "canonical", "occurrences", "meetings", "reviewers", F.element_at("contexts", 1).alias("context"), "is_safe", "contradictory")


_PLAYED = """
with recursive e as (select 'run' || user_id % 5 as runtime, 'm' || event_id // 40 as id, ['register', 'evaluate', 'approve', 'activate', 'rollback'][(event_id // 5) % 5 + 1] as action, row_number() over (partition by user_id % 5 order by event_id) as n from events),
f(runtime, n, models, active) as (select distinct runtime, 0::bigint, map([]::varchar[], []::struct(status varchar, passed boolean, previous varchar)[]), null::varchar from e
union all
select f.runtime, e.n, case
when action = 'register' and f.models[e.id] is null then map_concat(f.models, map([e.id], [{'status': 'candidate', 'passed': false, 'previous': null::varchar}]))
when action = 'evaluate' and f.models[e.id].status <> 'retired' then map_concat(f.models, map([e.id], [{'status': 'evaluated', 'passed': true, 'previous': f.models[e.id].previous}]))
when action = 'approve' and f.models[e.id].passed then map_concat(f.models, map([e.id], [{'status': 'approved', 'passed': true, 'previous': f.models[e.id].previous}]))
when action = 'activate' and f.models[e.id].status = 'approved' then map_concat(case when f.active is null then f.models else map_concat(f.models, map([f.active], [{'status': 'retired', 'passed': f.models[f.active].passed, 'previous': f.models[f.active].previous}])) end, map([e.id], [{'status': 'active', 'passed': true, 'previous': f.active}]))
when action = 'rollback' and f.active is not null and f.models[f.active].previous is not null then map_concat(f.models, map([f.active, f.models[f.active].previous], [{'status': 'retired', 'passed': f.models[f.active].passed, 'previous': f.models[f.active].previous}, {'status': 'active', 'passed': f.models[f.models[f.active].previous].passed, 'previous': f.models[f.models[f.active].previous].previous}]))
else f.models end,
case when action = 'evaluate' and f.models[e.id].status <> 'retired' and e.id = f.active or action = 'approve' and f.models[e.id].passed and e.id = f.active then null
when action = 'activate' and f.models[e.id].status = 'approved' then e.id
when action = 'rollback' and f.active is not null and f.models[f.active].previous is not null then f.models[f.active].previous else f.active end
from f join e on e.runtime = f.runtime and e.n = f.n + 1),
l as (select runtime, unnest(map_entries(models)) as m from (select runtime, arg_max(models, n) as models from f group by 1))
select runtime, m.key as artifact_id, m.value.status as status, m.value.previous as previous_id from l
"""


@query()
def dialect_rules(spark, sf):
    r = spark.createDataFrame([("r1", "en", ["the", "and"], "le", "safe_replace", "approved"), ("r2", "mixed", ["die"], "da", "safe_replace", "approved")], "rule_id string, language string, variants array<string>, canonical string, action string, approval string")
    s = L.normalised(t.table(spark, sf, "conversations").withColumn("language", F.lit("en")), r)
    return s.select("conv_id", "turn", F.size("rewritten.corrections").alias("corrections"), F.size("rewritten.suggestions").alias("suggestions"))


@query()
def lexicon_corrections(spark, sf):
    x = spark.createDataFrame([("thee", ["the"], ["en"], False, 0), ("orders", [], ["en"], True, 1)], "canonical string, variants array<string>, languages array<string>, fuzzy boolean, pos int")
    s = L.corrected(t.table(spark, sf, "conversations").withColumn("language", F.lit("en")), x)
    return s.select("conv_id", "turn", F.size("corrected.corrections").alias("corrections"))


@query(_PLAYED)
def model_registry(spark, sf):
    e = t.table(spark, sf, "events")
    return L.registry(e.select(F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string")).alias("runtime"), F.format_string("m%d", F.floor(F.col("event_id") / 40).cast("long")).alias("artifact_id"), F.col("event_id").alias("seq"), F.get(F.array(*[F.lit(x) for x in ("register", "evaluate", "approve", "activate", "rollback")]), (F.floor(F.col("event_id") / 5) % 5).cast("int")).alias("action"), F.lit("r").alias("report"), F.lit(True).alias("passed")))


# --- evaluation -----------------------------------------------------------------------


def _pairs(spark, sf):
    """A recogniser that hears every seventh document's 'the' as 'a', and nothing of every twentieth."""
    d = t.table(spark, sf, "conversations")
    hyp = F.when((F.col("conv_id") + F.col("turn")) % 20 == 0, "").when(F.col("conv_id") % 7 == 0, F.regexp_replace("text", r"(?iU)\bthe\b", "a")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", "role", F.col("text").alias("reference"), hyp.alias("hypothesis"), (F.col("conv_id") % 3).alias("condition"))


_FORM = "trim(regexp_replace(regexp_replace(lower({}), '[.,;:!?\"''“”«»()\\[\\]{{}}]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"
_HEARD_THE = "len(regexp_extract_all(text, '(?i)(^|[^\\pL\\pN_])the\\b'))"
# Each 'the' heard as 'a' is a word substituted, or a letter substituted and two deleted.
_EDITS = f"""
with p as (select conv_id, turn, role, conv_id % 3 as condition, {_FORM.format("text")} as form, (conv_id + turn) % 20 = 0 as mute, case when conv_id % 7 = 0 then {_HEARD_THE} else 0 end::bigint as k from conversations),
c as (select *, len(list_filter(string_split(form, ' '), lambda w: w <> ''))::bigint as n, length(replace(form, ' ', ''))::bigint as cn from p)
select conv_id, turn, role, condition, n, cn, case when mute then 0 else k end as s, case when mute then n else 0 end as d, 0::bigint as i, case when mute then 0 else k end as cs, case when mute then cn else 2 * k end as cd, 0::bigint as ci from c
"""


@query(_EDITS)
def edit_counts(spark, sf):
    return E.error_counts(_pairs(spark, sf)).drop("reference", "hypothesis")


_SLICES = """
with c as (select doc_id % 4 as language, doc_id % 3 as condition, doc_id % 11 as s, doc_id % 5 as d, doc_id % 7 as i, n_chars as n, doc_id % 13 as cs, 0 as cd, 0 as ci, n_chars * 3 as cn from documents)
select language, condition, sum(s)::bigint as s, sum(n)::bigint as n, count(*) as rows, round(sum(s + d + i) / sum(n), 6) as wer, round(sum(cs) / sum(cn), 6) as cer from c group by rollup (language, condition)
"""


@query(_SLICES)
def slice_error_rates_rollup(spark, sf):
    d, k = t.table(spark, sf, "documents"), F.col("doc_id")
    c = d.select((k % 4).alias("language"), (k % 3).alias("condition"), (k % 11).alias("s"), (k % 5).alias("d"), (k % 7).alias("i"), F.col("n_chars").alias("n"), (k % 13).alias("cs"), F.lit(0).alias("cd"), F.lit(0).alias("ci"), (F.col("n_chars") * 3).alias("cn"))
    return E.error_slices(c, ["language", "condition"]).select("language", "condition", "s", "n", "rows", F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"))


@query(f"select coalesce(sum(case when mute or form = '' then len(list_filter(string_split(form, ' '), lambda w: w <> '')) else 0 end), 0)::bigint as silence_insertions from (select (conv_id + turn) % 20 = 0 as mute, {_FORM.format('text')} as form from conversations)")
def silence_insertions(spark, sf):
    return E.silence_insertions(_pairs(spark, sf).select(F.col("hypothesis").alias("reference"), F.col("reference").alias("hypothesis")))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 2 when 1 then 1 when 2 then 0 else 1 end::bigint as critical_errors from orders")
def critical_facts(spark, sf):
    o, k = t.table(spark, sf, "orders"), F.col("o_orderkey") % 4
    ref = F.when(k < 2, "nu dați 4 mg").otherwise("dați 4 mg")
    hyp = F.when(k == 0, "dați 4 mg").when(k == 1, "nu dați 5 mg").when(k == 2, "dati 14 mg").otherwise("dați mg")
    facts = F.array(F.struct(F.lit("negation").alias("kind"), F.lit("Nu").alias("token")), F.struct(F.lit("dosage").alias("kind"), F.lit("4 mg").alias("token")))
    return E.critical_errors(o.select("o_orderkey", ref.alias("reference"), hyp.alias("hypothesis"), F.lit("ro").alias("language"), facts.alias("facts"))).select("o_orderkey", "critical_errors")


@query("select count(*) filter (where o_orderkey % 3 = 0) as found, count(*) as entities, round(count(*) filter (where o_orderkey % 3 = 0) / count(*), 6) as recall from orders")
def entity_recall(spark, sf):
    hyp = F.when(F.col("o_orderkey") % 3 == 0, "a STENT, was put").when(F.col("o_orderkey") % 3 == 1, "stents were put").otherwise("none")
    return E.entity_recall(t.table(spark, sf, "orders").select(F.lit("Stent").alias("term"), hyp.alias("hypothesis"))).withColumn("recall", F.round("recall", 6))


@query("with g as (select source, count(*) filter (where quality = 1 and toxic = 0) as tp, count(*) filter (where toxic = 0) as predicted, count(*) filter (where quality = 1) as gold from documents join labels using (doc_id) group by 1), r as (select *, case when predicted > 0 then tp / predicted when gold = 0 then 1e0 else 0e0 end as p, case when gold > 0 then tp / gold else 1e0 end as r from g) select source, round(p, 6) as p, round(r, 6) as r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from r")
def prf_scorecard(spark, sf):
    d = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id")
    g = d.groupBy("source").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("tp"), F.count_if(F.col("toxic") == 0).alias("predicted"), F.count_if(F.col("quality") == 1).alias("gold"))
    s = g.select("source", E.prf(F.col("tp"), F.col("predicted"), F.col("gold")).alias("x"))
    return s.select("source", F.round("x.p", 6).alias("p"), F.round("x.r", 6).alias("r"), F.round("x.f1", 6).alias("f1"))


_GATES = """
with s as (select o_orderkey % 2 as side, o_orderstatus as lang, count(*) as n, count(*) filter (where o_custkey % 10 < 2 - o_orderkey % 2) as bad from orders group by all),
t as (select side, sum(bad) / sum(n) as wer, max(n) as m from s group by 1),
w as (select bool_or(c.bad / c.n > b.bad / b.n + 1e-6) as regressed from s b join s c on b.lang = c.lang and b.side = 0 and c.side = 1),
x as (select b.wer as bw, c.wer as cw, (b.wer - c.wer) / b.wer as gain, regressed, b.m as bm, c.m as cm from t b, t c, w where b.side = 0 and c.side = 1),
g as (select gain, list_filter([case when gain < 0.05 then 'relative_wer_improvement' end, case when cw - bw >= 0 then 'paired_bootstrap_ci' end, case when regressed then 'no_language_regression' end, case when cm > bm then 'critical_fact_errors' end, case when bm > cm + 1000000 then 'silence_hallucinations' end, case when 0.5e0 < 0.25e0 then 'entity_recognition' end, case when cw > bw * 1.2 then 'latency_rtf' end], lambda k: k is not null) as failed from x)
select case when len(failed) = 0 then 'pass' else 'fail' end as status, array_to_string(failed, ',') as failed, round(gain, 4) as relative_improvement from g
"""


@query(_GATES)
def release_gate(spark, sf):
    """Reports computed from the table: odd orders are the candidate's recordings, even ones the baseline's."""
    o = t.table(spark, sf, "orders")
    s = o.groupBy((F.col("o_orderkey") % 2).alias("side"), F.col("o_orderstatus").alias("language")).agg(F.count("*").alias("n"), F.count_if(F.col("o_custkey") % 10 < 2 - F.col("o_orderkey") % 2).alias("bad"))
    report = s.groupBy("side").agg((F.sum("bad") / F.sum("n")).alias("corpus_wer"), F.max("n").cast("int").alias("critical_fact_errors"))
    report = report.withColumns({"silence_hallucinations": F.lit(0), "entity_precision": F.lit(0.25), "entity_recall": F.lit(0.5), "rtf": F.col("corpus_wer")})
    b, c = report.where("side = 0").drop("side"), report.where("side = 1").drop("side")
    difference = c.select(F.col("corpus_wer").alias("cw")).crossJoin(b.select("corpus_wer")).select((F.col("cw") - F.col("corpus_wer")).alias("difference_upper"))  # one row each
    langs = s.groupBy("language").agg(F.max(F.when(F.col("side") == 0, F.col("bad") / F.col("n"))).alias("baseline_wer"), F.max(F.when(F.col("side") == 1, F.col("bad") / F.col("n"))).alias("candidate_wer"))
    return E.release_gate(b, c.crossJoin(difference), langs)


@query("select coalesce(a.k, b.k) as metric, a.v as baseline, b.v as candidate, b.v - a.v as delta, round(case when a.v <> 0 then (b.v - a.v) / a.v end, 6) as relative from (select o_orderstatus as k, count(*)::double as v from orders where o_orderkey % 2 = 0 group by 1) a full join (select o_orderstatus as k, count(*)::double as v from orders where o_orderkey % 2 = 1 group by 1) b on a.k = b.k")
def report_delta(spark, sf):
    n = lambda k: t.table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return E.report_delta(n(0), n(1)).withColumn("relative", F.round("relative", 6))


@query("with c as (select distinct o_orderkey // 4 as p, o_orderkey % 2 = 0 as x from orders), d as (select count(*) filter (where o_orderkey % 3 = 0) as cited, count(*) as proposals from orders) select cited, proposals, round(cited / proposals, 6) as rate from d")
def false_decisions(spark, sf):
    o = t.table(spark, sf, "orders")
    p = o.select(F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("line"))
    d = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("meeting_id"), F.array(F.col("o_orderkey"), F.lit(-1).cast("long")).alias("evidence"))
    return E.false_decisions(p, d).withColumn("rate", F.round("rate", 6))


_BOOTSTRAP = """
with r as (select row_number() over (order by substr(md5(doc_id::varchar), 1, 7), doc_id::varchar) - 1 as row, count(*) over () as n, doc_id % 9 as e, 50 as w, doc_id % 7 as f from documents),
a as (select b, (b * 48271 + 42 * 69621) % 2147483647 as lot, j, n from range(1000) as x(b), (select distinct n from r) as c, range((select count(*) from r)) as y(j)),
d as (select b, n, lot, ((j + 1) * 16807 + lot) % 2147483647 as u from a),
g as (select b, n, lot, (((u * u % 2147483647) * (u * u % 2147483647)) % 2147483647) * u % 2147483647 as u from d),
h as (select b, n, (u * 39373 + lot) % 2147483647 as u from g),
k as (select b, ((((u * u % 2147483647) * (u * u % 2147483647)) % 2147483647) * u % 2147483647) * n // 2147483647 as row from h),
s as (select b, sum(e) / sum(w) as wer, sum(f) / sum(w) as wer_b from k join r using (row) group by 1)
select round(avg(wer), 9) as mean_wer, round(list_sort(list(wer))[26], 9) as lower, round(list_sort(list(wer))[976], 9) as upper, round(list_sort(list(wer_b - wer))[976], 9) as difference_upper from s
"""


@query(_BOOTSTRAP)
def bootstrap_ci(spark, sf):
    d = t.table(spark, sf, "documents").select(F.col("doc_id").alias("recording_id"), (F.col("doc_id") % 9).alias("edits"), F.lit(50).alias("words"), (F.col("doc_id") % 7).alias("edits_b"))
    b = E.bootstrap(d)
    return b.select(*[F.round(c, 9).alias(c) for c in b.columns])


@query()
def extraction_scorecard(spark, sf):
    i = t.items(spark, sf).where("kind = 'action'").select("meeting_id", F.col("weight").cast("int").alias("pos"), "text", F.array((F.col("weight") % 10).cast("int")).alias("evidence"), "owner")
    s = E.scorecard(i.where("pos % 2 = 0"), i)
    return s.select("meeting_id", "matched", "predicted", "gold", "score.f1", "owner_accuracy")


# --- events over time -----------------------------------------------------------------


@query("select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as stop, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling(spark, sf):
    return streams.windowed(t.table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("with w as (select event_type, value, unnest([date_trunc('day', ts) + (floor(date_part('hour', ts) / 6) * 6 - 6 * k) * interval 1 hour for k in range(0, 4)]) as start from events) select start, start + interval 1 day as stop, event_type, count(*) as n, round(sum(value), 4) as total from w group by all")
def sliding(spark, sf):
    return streams.windowed(t.table(spark, sf, "events"), "1 day", "6 hours").withColumn("total", F.round("total", 4))


@query("with e as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 2 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e) select min(ts) as start, max(ts) + interval 2 hour as stop, user_id, count(*) as n from s group by user_id, k")
def session_windows(spark, sf):
    return streams.sessions(t.table(spark, sf, "events"))


@query("with j as (select user_id as queue, event_id as job_id, ts as created_at from events where event_type = 'click'), r as (select *, row_number() over (partition by queue order by created_at, job_id) as n from j) select queue, job_id from r where n = 1")
def next_jobs(spark, sf):
    j = t.table(spark, sf, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "click", "queued").otherwise("done").alias("status"))
    return streams.next_job(j)


@query("select user_id as queue, count(*) filter (where event_type = 'click') as queued, count(*) filter (where event_type = 'view') as running from events group by 1")
def queue_depths(spark, sf):
    return streams.queue_depth(t.table(spark, sf, "events").select(F.col("user_id").alias("queue"), F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").alias("status")))


@query("select distinct user_id as job_key from events")
def submitted_once(spark, sf):
    return streams.submitted_once(t.table(spark, sf, "events").select("ts", F.col("user_id").alias("job_key"))).select("job_key")
