"""Queries on voices and identities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.functions import vectors as V
from confab.operators import acoustics
from confab.operators import linkage as L
from confab.operators import voices as O

from . import tables as t
from .registry import query

_DOT = "list_dot_product({a}::double[], {b}::double[])"
_COS = "(list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[]))))"


def _cos(a, b):
    return _COS.format(a=a, b=b)


def _prints(spark, sf):
    return t.voices(spark, sf).select(F.col("label").alias("person_id"), F.col("vec_id").alias("voiceprint_id"), "vector")


def _clusters(spark, sf):
    """Every hundredth vector asks who else has its voice."""
    return t.voices(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("cluster_id"), F.col("vector").alias("centroid"))


def _pairs(spark, sf):
    return O.nearest(_clusters(spark, sf), _prints(spark, sf), but_itself=True)


_RANKED = f"""(with p as (select c.vec_id as cluster_id, v.label as person_id, v.vec_id as voiceprint_id, {_cos("c.embedding", "v.embedding")} as s from embeddings c, embeddings v where c.vec_id % 100 = 0 and v.vec_id <> c.vec_id),
b as (select cluster_id, person_id::bigint as person_id, max(s) as score from p group by all),
r as (select *, row_number() over w as rank, lead(score) over w as next, first_value(score) over w as top from b window w as (partition by cluster_id order by score desc, person_id))
select cluster_id, person_id, rank::int as rank, round(score, 4) as score, round(case when rank = 1 then score - coalesce(next, 0) else score - top end, 4) as margin, case when score >= 0.8e0 then 'strong' when score >= 0.65e0 then 'moderate' when score >= 0.5e0 then 'weak' else 'no_match' end as band from r)"""


@query(f"select * from {_RANKED}")
def match_margin_band(spark, sf):
    return O.candidates(_pairs(spark, sf)).drop("voiceprint_id")


@query(f"select cluster_id, person_id from {_RANKED} where rank = 1 and score >= 0.5e0 and margin >= 0.08e0 and band <> 'no_match'")
def picked_suggestions(spark, sf):
    return O.suggestions(match_margin_band(spark, sf)).select("cluster_id", "person_id")


@query(f"select person_id, string_agg(cluster_id, ',' order by cluster_id) as clusters from {_RANKED} where rank = 1 group by 1 having count(*) > 1")
def merge_suggestions(spark, sf):
    m = O.merge_suggestions(match_margin_band(spark, sf).where("rank = 1"))
    return m.select("person_id", F.array_join(F.col("clusters").cast("array<string>"), ",").alias("clusters"))


@query(f"with s as (select *, cluster_id // 1000 as meeting_id from {_RANKED} where rank = 1) select a.meeting_id, a.person_id, a.cluster_id as a, b.cluster_id as b from s a join s b using (meeting_id, person_id) where a.cluster_id < b.cluster_id")
def merge_pairs(spark, sf):
    return O.merge_pairs(match_margin_band(spark, sf).where("rank = 1").withColumn("meeting_id", F.floor(F.col("cluster_id") / 1000).cast("long")))


@query(f"""with raw as (select c.vec_id as cluster_id, v.label::bigint as person_id, v.vec_id as voiceprint_id, {_cos("c.embedding", "v.embedding")} as s from embeddings c, embeddings v where c.vec_id % 100 = 0 and v.vec_id in (select min(vec_id) from embeddings group by label)),
ex as (select c.vec_id as cluster_id, v.label::bigint as person_id, {_cos("c.embedding", "v.embedding")} as s from embeddings c, embeddings v where c.vec_id % 100 = 0 and v.vec_id not in (select min(vec_id) from embeddings group by label)),
top as (select cluster_id, person_id, max(s) as best, avg(s) as three from (select *, row_number() over (partition by cluster_id, person_id order by s desc) as n from ex) where n <= 3 group by all),
f as (select r.cluster_id, r.person_id, case when best is null then s else greatest(s, 0.5e0 * best + 0.3e0 * s + 0.2e0 * three) end as score from raw r left join top using (cluster_id, person_id))
select cluster_id, person_id, (row_number() over (partition by cluster_id order by score desc, 100000 - person_id, person_id))::int as rank, round(score, 4) as score from f""")
def fused_candidates(spark, sf):
    """A person's first vector is the print, the others its samples; names run against ids."""
    v = _prints(spark, sf)
    first = v.groupBy("person_id").agg(F.min_by(F.struct("voiceprint_id", "vector"), "voiceprint_id").alias("p")).select("person_id", "p.*")
    samples = v.withColumnRenamed("voiceprint_id", "exemplar_id").join(first.select("person_id", "voiceprint_id"), "person_id").where("exemplar_id <> voiceprint_id")
    pairs = O.nearest(_clusters(spark, sf), first.withColumn("full_name", F.format_string("%06d", F.lit(100_000) - F.col("person_id"))))
    return O.candidates(O.fused(pairs, samples, _clusters(spark, sf))).select("cluster_id", "person_id", "rank", "score")


@query(f"with g as (select meeting_id, speaker, cluster_id, count(*) as n from (select meeting_id, speaker, case when idx % 3 = 0 then 'SPEAKER_09' when idx % 5 = 0 then null else cluster_id end as cluster_id from {t.SEGMENTS}) where cluster_id is not null group by all) select meeting_id, speaker, cluster_id from g qualify row_number() over (partition by meeting_id, speaker order by n desc, cluster_id) = 1")
def cluster_modes(spark, sf):
    s = t.segments(spark, sf).withColumn("cluster_id", F.when(F.col("idx") % 3 == 0, "SPEAKER_09").when(F.col("idx") % 5 != 0, F.col("cluster_id")))
    return O.cluster_mode(s)


@query(f"select cluster_id, person_id from {_RANKED} where not (cluster_id % 200 = 0 and person_id < 5)")
def rejected_people(spark, sf):
    rejected = _clusters(spark, sf).where("cluster_id % 200 = 0").select("cluster_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("person_id"))
    return O.without_rejected(match_margin_band(spark, sf), rejected).select("cluster_id", "person_id")


@query(f"with s as (select q.vec_id, v.vec_id as other, {_cos('q.embedding', 'v.embedding')} as s from embeddings q, embeddings v where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id), r as (select vec_id, other, s, row_number() over (partition by vec_id order by round(s, 12) desc, other) as rank from s) select vec_id, other, rank::int as rank, round(s, 6) as score from r where rank <= 3")
def cosine_topk(spark, sf):
    """Every hundredth vector as a query against all."""
    from pyspark.sql import Window

    v = t.voices(spark, sf)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("cluster_id"), F.col("vector").alias("centroid"))
    pairs = O.nearest(asked, v.select("vec_id", "vector"), 3, None, "vec_id", but_itself=True)
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    ranked = pairs.select(F.col("cluster_id").alias("q"), F.col("vec_id").alias("other"), "score", F.row_number().over(w).alias("rank")).where("rank <= 3")
    return ranked.select(F.col("q").alias("vec_id"), "other", "rank", F.round("score", 6).alias("score"))


@query(f"with g as (select label, vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), e as (select label, vec_id, generate_subscripts(v, 1) as dim, unnest(v) as x from g), m as (select label, dim, sum(x * (1 + vec_id % 9)) / sum(1 + vec_id % 9) as x from e group by all), n as (select label, sqrt(sum(x * x)) as n from m group by 1) select m.label::bigint as label, m.dim::int as dim, round(m.x / n.n, 6) as x from m join n using (label)")
def centroids(spark, sf):
    c = O.centroids(t.voices(spark, sf), ["label"], F.col("speech_s"))
    return c.select("label", F.posexplode("centroid").alias("p", "v")).select("label", (F.col("p") + 1).alias("dim"), F.round("v", 6).alias("x"))


@query(f"select a.label::bigint as label, round(avg({_cos('a.embedding', 'b.embedding')}), 6) as cohesion from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by 1")
def cohesion(spark, sf):
    return O.cohesion(t.voices(spark, sf), ["label"]).select("label", F.round("cohesion", 6).alias("cohesion"))


_CENTERS = "(select c.label, c.embedding from embeddings c where c.vec_id in (select min(vec_id) from embeddings group by label))"


@query(f"with s as (select v.vec_id, c.label, row_number() over (partition by v.vec_id order by round({_cos('v.embedding', 'c.embedding')}, 12) desc, c.label) as n from embeddings v, {_CENTERS} c) select vec_id, label::bigint as label from s where n = 1")
def nearest_centroid(spark, sf):
    v = t.voices(spark, sf)
    return O.nearest_centroid(v, v.groupBy("label").agg(F.min_by("vector", "vec_id").alias("centroid")))


@query("with g as (select label::bigint as person_id, count(*) as samples, sum(1 + vec_id % 9)::double as speech_s from embeddings group by 1) select person_id, samples, speech_s, samples >= 2 and speech_s >= 20 and false as is_active from g")
def built_voiceprints(spark, sf):
    b = O.built_voiceprints(t.voices(spark, sf).withColumnRenamed("label", "person_id"), min_cohesion=0.99)
    return b.select("person_id", "samples", "speech_s", "is_active")


_PRINTS = "(select c_custkey as voiceprint_id, c_custkey % 500 as person_id, 'space' || c_custkey % 2 as space_id, c_custkey % 3 <> 0 as is_active, c_acctbal as enrolled_at from customer)"


def _enrolled(spark, sf):
    c = t.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("voiceprint_id"), (F.col("c_custkey") % 500).alias("person_id"), F.concat(F.lit("space"), (F.col("c_custkey") % 2).cast("string")).alias("space_id"), (F.col("c_custkey") % 3 != 0).alias("is_active"), F.col("c_acctbal").alias("enrolled_at"))


@query(f"select v.voiceprint_id, p.full_name from {_PRINTS} v join {t.PEOPLE} p using (person_id) where v.is_active and v.space_id = 'space1' and p.is_active and p.consent_given and p.consent_withdrawn_at is null")
def eligible_voiceprints(spark, sf):
    return O.eligible_voiceprints(t.people(spark, sf), _enrolled(spark, sf), "space1").select("voiceprint_id", "full_name")


@query(f"with s as (select person_id, count(*) filter (where is_active and space_id = 'space1') as usable from {_PRINTS} group by 1) select person_id, case when not (consent_given and consent_withdrawn_at is null) then 'no_consent' else 'needs_reenrollment' end as reason from {t.PEOPLE} join s using (person_id) where is_active and (not (consent_given and consent_withdrawn_at is null) or usable = 0)")
def skipped_people(spark, sf):
    return O.skipped_people(t.people(spark, sf), _enrolled(spark, sf), "space1")


@query(f"select p.person_id, case when bool_or(v.is_active and v.space_id = 'space1') then 'enrolled' when bool_or(v.is_active) then 'needs_reenrollment' else 'not_enrolled' end as state from {t.PEOPLE} p left join {_PRINTS} v using (person_id) group by 1")
def enrollment_states(spark, sf):
    return O.enrollment_state(t.people(spark, sf), _enrolled(spark, sf), "space1")


@query(f"select state, count(*) as people from (select p.person_id, case when bool_or(v.is_active and v.space_id = 'space1') then 'enrolled' when bool_or(v.is_active) then 'needs_reenrollment' else 'not_enrolled' end as state from {t.PEOPLE} p left join {_PRINTS} v using (person_id) group by 1) group by 1")
def enrollment_counts(spark, sf):
    return enrollment_states(spark, sf).groupBy("state").agg(F.count("*").alias("people"))


@query(f"select person_id, arg_max(voiceprint_id, (enrolled_at, voiceprint_id)) as voiceprint_id, max(enrolled_at) as enrolled_at from {_PRINTS} group by 1")
def latest_voiceprints(spark, sf):
    return O.latest_voiceprint(_enrolled(spark, sf))


@query("with e as (select event_id, value / 20 as speech_s, -(event_id % 60)::double as dbfs, (event_id % 30) / 1000e0 as clipped, (event_id % 7) / 15e0 as second from events), f as (select *, speech_s < 4 as a, dbfs < -45 as b, dbfs > -6 as c, clipped > 0.02e0 as d from e), g as (select *, a or b or c or d as lv, not (a or b or c or d) and second >= 0.3e0 as two from f) select event_id, case when lv or two then 'reject' when speech_s < 10 or dbfs < -35 then 'usable' else 'good' end as verdict, array_to_string(list_filter([case when a then 'too_short' end, case when b then 'too_quiet' end, case when c then 'too_loud' end, case when d then 'clipped' end, case when two then 'two_voices' end, case when not (lv or two) and speech_s < 10 then 'short' end, case when not (lv or two) and dbfs < -35 then 'quiet' end], lambda x: x is not null), ',') as reasons from g")
def sample_verdicts(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", (F.col("value") / 20).alias("speech_s"), (-(F.col("event_id") % 60)).cast("double").alias("dbfs"), ((F.col("event_id") % 30) / 1000.0).alias("clipped"), ((F.col("event_id") % 7) / 15.0).alias("second_share"))
    return e.withColumn("v", O.sample_verdict()).select("event_id", "v.verdict", "v.reasons")


@query("with s as (select user_id as sample_id, event_type as label, sum(value) as s from events group by all), r as (select *, row_number() over (partition by sample_id order by s desc, label) as n, sum(s) over (partition by sample_id) as a from s) select sample_id, round(coalesce(max(s / a) filter (where n = 2), 0), 6) as second_share, coalesce(max(s / a) filter (where n = 2), 0) >= 0.25e0 as two_voices from r group by 1")
def two_voice_shares(spark, sf):
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("label"), F.col("value").alias("seconds"))
    return O.two_voice_share(e, 0.25).withColumn("second_share", F.round("second_share", 6))


@query("with v as (select user_id as cluster_id, case when value > 10 then event_type end as person_id from events), g as (select cluster_id, person_id, count(*) as votes from v group by all) select cluster_id, person_id, votes, (sum(votes) over (partition by cluster_id))::bigint as total, round(votes / sum(votes) over (partition by cluster_id), 3) as ratio from g qualify person_id is not null")
def vote_ratios(spark, sf):
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("cluster_id"), F.when(F.col("value") > 10, F.col("event_type")).alias("person_id"))
    return O.vote_ratio(e)


@query("with r as (select user_id as cluster_id, event_id as segment_id, row_number() over (partition by user_id order by value, event_id) as rank from events) select cluster_id, segment_id, rank::int as rank from r where rank <= 5")
def lowest_turns(spark, sf):
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("cluster_id"), F.col("event_id").alias("segment_id"), F.col("event_id").alias("start_s"), F.col("value").alias("score"))
    return O.lowest_turns(e).select("cluster_id", "segment_id", "rank")


@query(f"select meeting_id, cluster_id, round(sum(speech_seconds), 2) as seconds, count(*) as turns, count(*) filter (where speech_seconds >= 2) as printable, count(*) filter (where speech_seconds < 2) as unprintable, max(attribution_state) as state from {t.SEGMENTS} group by all")
def cluster_views(spark, sf):
    # a meeting's segments have one state here
    return O.cluster_view(t.segments(spark, sf))


@query("select s_suppkey as cluster_id, array_to_string(list_filter([case when s_suppkey % 4 = 0 then 'no_diagnostics' end, case when s_suppkey % 4 <> 0 and s_suppkey % 6 = 1 then 'mixed' end, case when s_suppkey % 4 <> 0 and s_suppkey % 5 = 1 then 'short' end, case when n > 0 then 'straddling:' || n end], lambda x: x is not null), ',') as reasons from supplier left join (select l_suppkey as s_suppkey, count(*) as n from lineitem where l_returnflag = 'R' and l_linenumber = 7 group by 1) using (s_suppkey)")
def blocking_reasons(spark, sf):
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cluster_id"))
    d = s.where("cluster_id % 4 <> 0").select("cluster_id", (F.col("cluster_id") % 6 == 1).alias("mixed"), (F.col("cluster_id") % 5 == 1).alias("short"))
    seg = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), "speaker_change").alias("flag_reason"))
    return O.blocking_reasons(s, d, seg).select("cluster_id", F.array_join("reasons", ",").alias("reasons"))


@query("select user_id, round(20 * log10(greatest(sqrt(avg((value / 500) ** 2)), 1e-6)), 6) as dbfs from events group by 1")
def signal_levels(spark, sf):
    e = t.table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.col("value") / 500).alias("x"))
    return e.select("user_id", F.round(V.rms_dbfs("x"), 6).alias("dbfs"))


_LOG_MEL = """
with e as (select vec_id % 40 as rec, row_number() over (partition by vec_id % 40 order by vec_id) - 1 as v, embedding from embeddings),
x as (select rec, v * len(embedding) + i - 1 as pos, embedding[i]::double * 32768 as x from (select rec, v, embedding, unnest(range(1, len(embedding) + 1)) as i from e)),
n as (select rec, count(*) as n from x group by 1),
f as (select rec, unnest(range(0, (n - 400) // 160 + 1)) as frame from n where n >= 400),
s as (select f.rec, frame, pos - frame * 160 as k, x - avg(x) over (partition by f.rec, frame) as x from f join x on x.rec = f.rec and pos between frame * 160 and frame * 160 + 399),
p as (select rec, frame, k, (x - 0.97e0 * coalesce(lag(x) over (partition by rec, frame order by k), x)) * (0.54e0 - 0.46e0 * cos(2 * pi() * k / 399)) as x from s),
d as (select rec, frame, b, sum(x * cos(2 * pi() * ((b * k) % 512) / 512)) ** 2 + sum(x * sin(2 * pi() * ((b * k) % 512) / 512)) ** 2 as power from p, range(256) as r(b) group by all),
m as (select 1127e0 * ln(1 + 20 / 700e0) as lo, 1127e0 * ln(1 + 8000 / 700e0) as hi),
t as (select j, b, greatest(0, least((1127e0 * ln(1 + b * 31.25e0 / 700) - (lo + j * (hi - lo) / 9)) / ((hi - lo) / 9), ((lo + (j + 2) * (hi - lo) / 9) - 1127e0 * ln(1 + b * 31.25e0 / 700)) / ((hi - lo) / 9))) as w from m, range(8) as a(j), range(256) as c(b)),
g as (select rec, frame, j, ln(greatest(sum(power * w), 1.1920928955078125e-7)) as e from d join t using (b) group by all)
select rec as recording_id, frame, j::int as bin, round(e - avg(e) over (partition by rec, j), 3) as energy from g
"""


@query(_LOG_MEL)
def log_mel_features(spark, sf):
    """A meeting's vectors, one after another, as its samples: features of eight bins, by chunks."""
    v = t.voices(spark, sf).select(F.col("cluster_id").alias("recording_id"), "vec_id", "vector")
    order = Window.partitionBy("recording_id").orderBy("vec_id")
    rows = v.withColumn("n", F.row_number().over(order) - 1).select("recording_id", "n", F.size("vector").alias("size"), F.posexplode("vector").alias("k", "sample"))
    samples = rows.select("recording_id", (F.col("n") * F.col("size") + F.col("k")).alias("position"), "sample")
    found = acoustics.log_mel_features(acoustics.chunked(samples, "recording_id", 1_000), chunk=1_000, n_mels=8)
    return found.select("recording_id", "frame", F.posexplode("features").alias("bin", "e")).select("recording_id", "frame", "bin", F.round("e", 3).alias("energy"))


@query()
def ahc_clusters(spark, sf):
    v = t.voices(spark, sf).select(F.col("cluster_id").alias("meeting_id"), F.col("vec_id").alias("window"), F.lit(0.0).alias("start_s"), F.col("speech_s").alias("end_s"), "vector")
    return L.clustered(v, stop=0.9)


@query('with r as (select vec_id % 40 as meeting_id, vec_id as "window", label, min(vec_id) over (partition by vec_id % 40, label) as root from embeddings) select meeting_id, "window", (dense_rank() over (partition by meeting_id order by root) - 1)::bigint as label from r')
def ahc_separated(spark, sf):
    """Voices of known speakers with what the table's vectors add to them: clusters are the speakers."""
    v = t.voices(spark, sf)
    own = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k == F.pmod("label", F.lit(64)), 1.0).otherwise(0.0))
    far = F.concat(own, F.transform("vector", lambda x: x.cast("double") * 0.2))
    return L.clustered(v.select(F.col("cluster_id").alias("meeting_id"), F.col("vec_id").alias("window"), F.lit(0.0).alias("start_s"), F.lit(2.0).alias("end_s"), far.alias("vector")))


@query("select (vec_id % 40) % 8 as meeting_id, label::bigint as label, round(sum(1 + vec_id % 9), 3)::double as seconds, count(distinct vec_id % 4) as regions, count(distinct vec_id % 4) < 3 as short from embeddings group by all")
def cluster_evidence(spark, sf):
    v = t.voices(spark, sf).select((F.col("cluster_id") % 8).alias("meeting_id"), "label", (F.col("vec_id") % 4).alias("region"), F.lit(0.0).alias("start_s"), F.col("speech_s").alias("end_s"))
    return L.evidence(v)


@query()
def cluster_diagnostics(spark, sf):
    v = t.voices(spark, sf).select((F.col("cluster_id") % 8).alias("meeting_id"), "label", F.col("vec_id").alias("window"), (F.col("vec_id") % 4).alias("region"), F.lit(0.0).alias("start_s"), F.col("speech_s").alias("end_s"), "vector")
    return L.diagnosed(v)


_REMATCHED = f"""
with c as (select vec_id % 40 as cluster_id, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x, (1 + vec_id % 9)::double as w from embeddings where vec_id % 40 <> 3),
m as (select cluster_id, k, sum(x * w) / sum(w) as x from c group by all), v as (select cluster_id, list(x order by k) as centroid from m group by 1),
who as (select person_id, full_name from {t.PEOPLE} where is_active and consent_given and consent_withdrawn_at is null),
s as (select v.cluster_id, e.label::bigint as person_id, max({_cos("v.centroid", "e.embedding")}) as score, arg_max(e.vec_id, ({_cos("v.centroid", "e.embedding")}, -e.vec_id)) as voiceprint_id, min(full_name) as full_name from v, embeddings e join who on who.person_id = e.label where not (v.cluster_id = 1 and e.label = 1) group by all),
r as (select *, row_number() over w as rank, lead(score) over w as next from s window w as (partition by cluster_id order by score desc, full_name, person_id))
select cluster_id, person_id, voiceprint_id, rank::int as rank, round(score, 4) as score, round(score - coalesce(next, 0), 4) as margin, case when score >= 0.8e0 then 'strong' when score >= 0.65e0 then 'moderate' else 'weak' end as band from r where rank = 1 and round(score, 4) >= 0.5e0 and round(score - coalesce(next, 0), 4) >= 0.08e0
"""


@query(_REMATCHED)
def rematched_speakers(spark, sf):
    v = t.voices(spark, sf).select("cluster_id", "vector", F.col("speech_s").alias("speech_seconds"), F.when(F.col("cluster_id") == 3, "confirmed").otherwise("anonymous").alias("attribution_state"))
    people = t.people(spark, sf).select("person_id", "full_name", "is_active", "consent_given", "consent_withdrawn_at")
    prints = t.voices(spark, sf).select(F.col("label").alias("person_id"), F.col("vec_id").alias("voiceprint_id"), "vector", F.lit("s").alias("space_id"), F.lit(True).alias("is_active"))
    return O.rematched(v, people, prints, spark.createDataFrame([(1, 1)], "cluster_id long, person_id long"), "s")


@query()
def assigned_speakers(spark, sf):
    s = t.segments(spark, sf)
    w = s.select("meeting_id", F.col("idx").cast("long").alias("window"), (F.col("idx") % 2).cast("long").alias("label"), F.col("start_s"), (F.col("end_s") + 1).alias("end_s"))
    return O.assigned_speakers(s.select("meeting_id", "segment_id", "idx", "start_s", "end_s"), w)
