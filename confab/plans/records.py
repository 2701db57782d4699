"""Queries on meetings, minutes, delivery and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions import text as T
from confab.operators import context, delivery, folds, meetings as M, minutes, translation

from . import tables as t
from .registry import query

_FORM = "trim(regexp_replace(regexp_replace(lower(text), '[.,;:!?\"''“”«»()\\[\\]{}]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"
_GROUNDED = f"(select b.item_id as claim_id, d.doc_id as text_id, d.lang from (select item_id, ' ' || {_FORM} || ' ' as c from benchmark) b join (select doc_id, lang, ' ' || {_FORM} || ' ' as t from documents) d on contains(d.t, b.c))"


def _grounded(spark, sf):
    claims = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return claims, minutes.grounded_claims(claims, t.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query(f"select claim_id, text_id, lang from {_GROUNDED}")
def evidence_grounding(spark, sf):
    """The flagship: which claims stand verbatim in which texts."""
    return _grounded(spark, sf)[1].join(t.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "lang"), "text_id").select("claim_id", "text_id", "lang")


@query(f"select item_id as claim_id from benchmark where item_id not in (select claim_id from {_GROUNDED})")
def ungrounded_review_queue(spark, sf):
    claims, found = _grounded(spark, sf)
    return minutes.review_queue(claims, found).select("claim_id")


@query(f"select item_id as claim_id from benchmark where item_id in (select claim_id from {_GROUNDED})")
def supported_claims(spark, sf):
    claims, found = _grounded(spark, sf)
    return minutes.supported(claims, found).select("claim_id")


@query(f"select lang, count(distinct claim_id) as claims, count(*) as citations from {_GROUNDED} group by lang")
def grounding_by_language(spark, sf):
    return evidence_grounding(spark, sf).groupBy("lang").agg(F.count_distinct("claim_id").alias("claims"), F.count("*").alias("citations"))


_CITES = f"(select meeting_id || '/' || idx as cite_id, meeting_id, segment_id, start_s, end_s, idx, case idx % 3 when 0 then text when 1 then substr(text, 3, 30) else 'nobody said ' || idx end as quote from {t.SEGMENTS})"
_BARE = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_ \\t\\n\\r\\f\\x0b]', '', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"


@query(f"with c as (select *, {_BARE.format('quote')} as q from {_CITES} where length(trim(quote)) >= 3), s as (select meeting_id, segment_id as found_in, idx as i, {_BARE.format('text')} as t, start_s as s0, end_s as s1 from {t.SEGMENTS}), p as (select c.cite_id, s.found_in, 0 as way, i from c join s on c.meeting_id = s.meeting_id and c.segment_id = s.found_in where c.start_s <= s1 + 1 and c.end_s >= s0 - 1 and (contains(t, q) or len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(t, ' ')))) >= 0.9e0 * len(list_distinct(string_split(q, ' ')))) union all select c.cite_id, s.found_in, 1, i from c join s using (meeting_id) where length(q) > 8 and contains(t, q)), r as (select *, row_number() over (partition by cite_id order by way, i) as n from p) select cite_id, found_in from r where n = 1")
def verified_citations(spark, sf):
    s = t.segments(spark, sf)
    quote = F.when(F.col("idx") % 3 == 0, F.col("text")).when(F.col("idx") % 3 == 1, F.substring("text", 3, 30)).otherwise(F.concat(F.lit("nobody said "), F.col("idx").cast("string")))
    e = s.select(F.concat_ws("/", "meeting_id", "idx").alias("cite_id"), "meeting_id", "segment_id", "start_s", "end_s", quote.alias("quote"))
    return minutes.verified_citations(e, s)


@query(f"select i.meeting_id, i.idx as item, s.segment_id, s.start_s, s.speaker from (select meeting_id, idx, unnest([idx - 1, idx, idx + 3]) as line from {t.SEGMENTS}) i join {t.SEGMENTS} s on s.meeting_id = i.meeting_id and s.idx = i.line")
def evidence_from_lines(spark, sf):
    s = t.segments(spark, sf)
    i = s.select("meeting_id", F.col("idx").alias("item_id"), F.array(F.col("idx") - 1, F.col("idx"), F.col("idx") + 3).alias("evidence_idx"))
    return minutes.evidence_from_lines(i, s).select("meeting_id", F.col("item_id").alias("item"), "segment_id", "start_s", "speaker")


@query(f"select e.cite, s.segment_id, s.start_s, s.end_s, s.speaker from (select segment_id as cite, meeting_id, meeting_id || '-' || (idx + 1) as segment_id from {t.SEGMENTS}) e join {t.SEGMENTS} s using (meeting_id, segment_id)")
def evidence_coordinates(spark, sf):
    s = t.segments(spark, sf)
    e = s.select(F.col("segment_id").alias("cite"), "meeting_id", F.concat_ws("-", F.col("meeting_id"), F.col("idx") + 1).alias("segment_id"))
    return minutes.evidence_coordinates(e, s).select("cite", "segment_id", "start_s", "end_s", "speaker")


@query(f"with e as (select segment_id as cite_id, meeting_id, case when idx % 2 = 0 then segment_id else 'lost' end as segment_id, start_s + 0.03e0 as start_s, end_s - case when idx % 4 = 3 then 0.2e0 else 0.02e0 end as end_s from {t.SEGMENTS}) select e.cite_id, coalesce(a.idx, (select min(g.idx) from {t.SEGMENTS} g where g.meeting_id = e.meeting_id and abs(g.start_s - e.start_s) < 0.05e0 and abs(g.end_s - e.end_s) < 0.05e0)) as idx from e left join {t.SEGMENTS} a on a.meeting_id = e.meeting_id and a.segment_id = e.segment_id")
def evidence_gold_index(spark, sf):
    s = t.segments(spark, sf)
    e = s.select(F.col("segment_id").alias("cite_id"), "meeting_id", F.when(F.col("idx") % 2 == 0, F.col("segment_id")).otherwise("lost").alias("segment_id"), (F.col("start_s") + 0.03).alias("start_s"), (F.col("end_s") - F.when(F.col("idx") % 4 == 3, 0.2).otherwise(0.02)).alias("end_s"))
    return minutes.evidence_index(e, s)


@query(f"with i as (select meeting_id, idx, list_sort(list_distinct(list_filter([idx - 2, idx, idx + 1, idx], lambda x: x between 2 and 5))) as own from {t.SEGMENTS}) select meeting_id, idx as item, array_to_string(own, ',') as lines from i where len(own) > 0 and list_max(own) >= 3")
def chunk_hygiene(spark, sf):
    i = t.segments(spark, sf).select("meeting_id", F.col("idx").alias("item"), F.array(F.col("idx") - 2, F.col("idx"), F.col("idx") + 1, F.col("idx")).alias("evidence_idx"), F.lit(1).alias("chunk"), F.lit(2).alias("first_idx"), F.lit(5).alias("last_idx"), F.lit(3).alias("fresh_idx"))
    return minutes.within_chunk(i).select("meeting_id", "item", F.array_join(F.col("evidence_idx").cast("array<string>"), ",").alias("lines"))


@query(f"select meeting_id, idx % 2 as chunk from {t.SEGMENTS} group by all having not bool_or(idx between 3 and 5)")
def stray_answers(spark, sf):
    r = t.segments(spark, sf).select("meeting_id", (F.col("idx") % 2).alias("chunk"), F.array("idx").alias("evidence_idx"), F.lit(3).alias("first_idx"), F.lit(5).alias("last_idx"))
    return minutes.strays(r)


@query(f"with f as (select meeting_id, right(speaker, 1)::int as n, confirmed_display_name as name, row_number() over (partition by meeting_id, speaker order by case when attribution_state = 'confirmed' and printable_name then 0 else 1 end, start_s, idx) as r, attribution_state = 'confirmed' and printable_name as ok from {t.SEGMENTS}) select meeting_id, n as number, case when ok then name else 'Участник ' || n end as shown from f where r = 1")
def label_map(spark, sf):
    m = minutes.label_map(t.segments(spark, sf), "ru")
    return m.select("meeting_id", F.explode("names").alias("number", "shown"))


@query(f"with n as (select meeting_id, confirmed_display_name as name, start_s, idx, speaker, row_number() over (partition by meeting_id, confirmed_display_name order by start_s, idx) as r from {t.SEGMENTS} where attribution_state = 'confirmed' and printable_name) select meeting_id, name, speaker, 1 as pos from n where r = 1")
def attribution_legend(spark, sf):
    return minutes.attribution_legend(t.segments(spark, sf))


@query(f"with a as (select segment_id as item_id, meeting_id, case when idx % 2 = 0 then speaker else 'Unassigned' end as owner from {t.SEGMENTS}), c as (select a.item_id, bool_and(coalesce(s.speaker = a.owner and s.printable_name and s.confirmed_display_name is not null, false)) as ok, min(s.confirmed_display_name) as name from a join {t.SEGMENTS} s on s.meeting_id = a.meeting_id and s.speaker = 'Speaker 1' group by 1) select a.item_id, a.owner, case when starts_with(a.owner, 'Speaker') and ok then name else a.owner end as owner_shown from a left join c using (item_id)")
def rendered_owners(spark, sf):
    s = t.segments(spark, sf)
    a = s.select(F.col("segment_id").alias("item_id"), "meeting_id", F.when(F.col("idx") % 2 == 0, F.col("speaker")).otherwise("Unassigned").alias("owner"))
    cited = a.select("item_id", "meeting_id").join(s.where("speaker = 'Speaker 1'"), "meeting_id").select("item_id", "speaker", "printable_name", "confirmed_display_name")
    return minutes.rendered_owner(a.select("item_id", "owner"), cited)


@query(f"with d as (select meeting_id, cluster_id, case meeting_id % 4 when 0 then 'confirm' when 1 then 'label' when 2 then 'reject' end as action from {t.SEGMENTS} where meeting_id % 4 < 3 group by all) select s.segment_id, case d.action when 'confirm' then 'confirmed' when 'label' then 'corrected' when 'reject' then 'anonymous' else s.attribution_state end as attribution_state, case when d.action in ('confirm', 'label') then 'Given' when d.action = 'reject' then null else s.confirmed_display_name end as confirmed_display_name, case d.action when 'confirm' then s.speech_seconds >= 2 when 'label' then true when 'reject' then false else s.printable_name end as printable_name from {t.SEGMENTS} s left join d using (meeting_id, cluster_id)")
def cluster_decisions(spark, sf):
    s = t.segments(spark, sf)
    m = F.col("meeting_id") % 4
    d = s.where(m < 3).select("meeting_id", "cluster_id").distinct().withColumn("r", F.explode(F.array(F.lit(1), F.lit(2))))
    action = F.when(F.col("r") == 1, "reject").when(m == 0, "confirm").when(m == 1, "label").otherwise("reject")
    d = d.select("meeting_id", "cluster_id", action.alias("action"), F.lit("p").alias("person_id"), F.lit("Given").alias("name"), F.col("r").alias("decided_at"))
    return minutes.decided_clusters(s, d).select("segment_id", "attribution_state", "confirmed_display_name", "printable_name")


@query(f"select segment_id, case when idx = 2 and speaker <> 'Speaker 2' then 'Speaker 2' else speaker end as speaker, case when idx = 2 and speaker <> 'Speaker 2' then 'anonymous' else attribution_state end as attribution_state from {t.SEGMENTS}")
def relabelled_segments(spark, sf):
    s = t.segments(spark, sf)
    moved = s.where("idx = 2").select("segment_id", F.lit("Speaker 2").alias("new_speaker"))
    return minutes.relabelled(s, moved).select("segment_id", "speaker", "attribution_state")


@query("select n.o_orderkey as meeting_id, o.o_orderstatus as review_status, 'edited ' || n.o_orderkey as title from orders n join orders o using (o_orderkey)")
def server_owned_fields(spark, sf):
    m = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderstatus").alias("review_status"), F.lit("x").alias("title"))
    edited = m.select("meeting_id", F.lit("?").alias("review_status"), F.concat(F.lit("edited "), F.col("meeting_id").cast("string")).alias("title"))
    return minutes.kept_fields(m, edited, "meeting_id", ["review_status"])


_PHRASES = ["it is decided", "we decided tomorrow", "aprobat by Friday, then", "responsible for this до пятницы. urgent", "must prepare it by Monday", "risc de complicații", "does it hold?", "nothing at all"]


@query("select segment_id, kind, level, owner, deadline_phrase from (values " + ", ".join([
    "(0, 'decision', null, null, null)", "(1, 'decision', null, null, null)", "(2, 'decision', null, null, null)", "(3, 'action', 'high', 'Speaker 2', 'до пятницы')",
    "(4, 'action', 'medium', 'Unassigned', 'by Monday')", "(5, 'risk', 'high', null, null)", "(6, 'risk', 'medium', null, null)"]) + ") v(k, kind, level, owner, deadline_phrase) join (select o_orderkey as segment_id, o_orderkey % 8 as k from orders) using (k)")
def heuristic_items(spark, sf):
    o = t.table(spark, sf, "orders").withColumn("k", (F.col("o_orderkey") % 8).cast("int"))
    phrases = F.array(*[F.lit(p) for p in _PHRASES])
    s = o.select(F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("segment_id"), F.col("k").alias("idx"), F.get(phrases, F.col("k")).alias("text"), F.when(F.col("k") % 2 == 0, "Speaker 1").otherwise("Speaker 2").alias("speaker"))
    return minutes.heuristic_items(s).select("segment_id", "kind", "level", "owner", "deadline_phrase")


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then o_orderdate::date + 1 when '2-HIGH' then o_orderdate::date + 2 when '3-MEDIUM' then last_day(o_orderdate::date) when '5-LOW' then o_orderdate::date + case when (5 - isodow(o_orderdate)) <= 0 then 12 - isodow(o_orderdate)::int else (5 - isodow(o_orderdate))::int end else o_orderdate::date + 7 end as deadline from orders")
def relative_deadline(spark, sf):
    o = t.table(spark, sf, "orders")
    phrase = F.when(F.col("o_orderpriority") == "1-URGENT", "până mâine").when(F.col("o_orderpriority") == "2-HIGH", "послезавтра").when(F.col("o_orderpriority") == "3-MEDIUM", "la sfârșitul lunii").when(F.col("o_orderpriority") == "5-LOW", "by Friday next week").otherwise("next week")
    return o.select("o_orderkey", T.relative_deadline(phrase, "o_orderdate").alias("deadline"))


@query(f"select segment_id, lpad((floor(start_s)::bigint // 60)::varchar, 2, '0') || ':' || lpad((floor(start_s)::bigint % 60)::varchar, 2, '0') as at, case when length(text) > 40 then rtrim(substr(text, 1, 39), ' ') || '…' else text end as quote from (select * replace (start_s * 7 as start_s) from {t.SEGMENTS})")
def evidence_lines(spark, sf):
    return t.segments(spark, sf).select("segment_id", T.clock(F.col("start_s") * 7).alias("at"), T.truncated("text", 40).alias("quote"))


@query("select vec_id, 'Speaker ' || (vec_id % 40) as label, 'Vorbitorul ' || (vec_id % 40) as shown, round(least(1e0, greatest(0e0, 1e0 - vec_id / 500e0)), 2) as confidence from embeddings")
def cluster_labels(spark, sf):
    v = t.table(spark, sf, "embeddings").withColumn("label", T.cluster_label(F.format_string("SPEAKER_%02d", F.col("vec_id") % 40)))
    return v.select("vec_id", "label", T.localized_label("label", "ro").alias("shown"), T.logprob_confidence(-F.col("vec_id") / 100.0).alias("confidence"))


# --- meetings -------------------------------------------------------------------------


@query(f"select meeting_id, coalesce(scheduled_at, created_at) as held_at from {t.MEETINGS}")
def meetings_by_time(spark, sf):
    return M.newest_first(t.meetings(spark, sf)).select("meeting_id", "held_at")


@query(f"select meeting_id, title from {t.MEETINGS} where meeting_id = 77")
def point_lookup(spark, sf):
    return M.one_meeting(t.meetings(spark, sf), 77).select("meeting_id", "title")


@query(f"select person_id, full_name from {t.PEOPLE} where is_active")
def people_list(spark, sf):
    return M.people_list(t.people(spark, sf)).select("person_id", "full_name")


@query(f"select m.meeting_id, m.title, count(i.item_id) filter (where kind = 'decision') as decisions, count(i.item_id) filter (where kind = 'action') as actions from {t.MEETINGS} m left join {t.ITEMS} i using (meeting_id) group by all")
def meeting_catalog(spark, sf):
    return M.catalog(t.meetings(spark, sf), t.items(spark, sf)).select("meeting_id", "title", "decisions", "actions")


@query(f"with m as (select meeting_id, coalesce(scheduled_at, created_at) >= timestamp '{t.AS_OF}' - interval 7 day as w, coalesce(scheduled_at, created_at) >= timestamp '{t.AS_OF}' - interval 30 day as mo from {t.MEETINGS}), i as (select kind, status, w from {t.ITEMS} join m using (meeting_id)) select * from (select count(*) as meetings, count(*) filter (where w) as meetings_7d, count(*) filter (where mo) as meetings_30d from m), (select count(*) filter (where kind = 'decision') as decisions, count(*) filter (where kind = 'decision' and w) as decisions_7d, count(*) filter (where kind = 'action') as actions, count(*) filter (where kind = 'action' and status in ('open', 'in_progress')) as lagging from i)")
def dashboard_metrics(spark, sf):
    return M.dashboard(t.meetings(spark, sf), t.items(spark, sf), t.AS_OF)


@query(f"with c as (select lower(coalesce(category, 'clinical')) as category, count(*) as n from {t.ITEMS} where kind = 'decision' group by 1) select coalesce(c.category, s.category) as category, coalesce(n, 0) as decisions from c full join (values ('clinical'), ('budget'), ('operations'), ('protocol')) s(category) on c.category = s.category")
def category_counts(spark, sf):
    return M.category_counts(t.items(spark, sf))


@query(f"select trim(coalesce(owner, 'Unassigned')) as owner, count(*) as total, count(*) filter (where status in ('open', 'in_progress')) as open, count(*) filter (where status = 'completed') as completed from {t.ITEMS} where kind = 'action' group by 1")
def owner_workload(spark, sf):
    return M.owner_workload(t.items(spark, sf))


@query(f"select meeting_id, coalesce(scheduled_at, created_at) as held_at from {t.MEETINGS} order by held_at desc, meeting_id desc limit 4")
def recent_top_k(spark, sf):
    return M.recent(t.meetings(spark, sf)).select("meeting_id", "held_at")


@query(f"select item_id from {t.ITEMS} i join {t.MEETINGS} m using (meeting_id) where kind = 'action' and i.status in ('open', 'in_progress') order by coalesce(scheduled_at, created_at) desc, meeting_id desc, item_id limit 15")
def lagging_actions(spark, sf):
    return M.lagging_actions(t.items(spark, sf), t.meetings(spark, sf)).select("item_id")


@query(f"select item_id from {t.ITEMS} i join {t.MEETINGS} m using (meeting_id) where kind = 'risk' and severity = 'high' order by coalesce(scheduled_at, created_at) desc, meeting_id desc, item_id limit 5")
def high_risks(spark, sf):
    return M.high_risks(t.items(spark, sf), t.meetings(spark, sf)).select("item_id")


@query("select o_orderkey as meeting_id from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'F' and (contains(lower(o_orderpriority || ' #' || o_orderkey), 'urgent') or contains(lower(c_name), 'urgent') or contains(lower(c_mktsegment), 'urgent')) union all select o_orderkey from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' and contains(lower(c_mktsegment), 'build')")
def meeting_search(spark, sf):
    who = t.people(spark, sf).select(F.col("person_id").alias("chair"), F.array(F.struct(F.col("full_name").alias("name"), "department")).alias("attendees"))
    m = t.meetings(spark, sf).join(who, "chair")
    return M.meeting_search(m, "Urgent", mode="live").select("meeting_id").unionByName(M.meeting_search(m, "build", mode="batch").select("meeting_id"))


@query(f"select item_id from {t.ITEMS} where kind = 'action' and status <> 'completed' and priority = 'high' and (contains(text, '7') or contains(coalesce(owner, ''), '7'))")
def open_action_filter(spark, sf):
    return M.item_search(t.items(spark, sf), "action", "7", priority="high", open_only=True).select("item_id")


@query(f"select item_id from {t.ITEMS} where kind = 'decision' and category = 'budget' and (contains(text, '12') or contains(lower(coalesce(owner, '')), '12'))")
def decision_search(spark, sf):
    return M.item_search(t.items(spark, sf), "decision", "12", category="budget").select("item_id")


@query(f"select item_id from {t.ITEMS} where kind = 'risk' and meeting_id % 3 = 0")
def audit_marked_risks(spark, sf):
    i = t.items(spark, sf).withColumn("text", F.when(F.col("meeting_id") % 3 == 0, F.concat(F.lit("NOTĂ AUDIT: "), F.col("text"))).otherwise(F.col("text")))
    return M.audit_marked(i).select("item_id")


@query(f"select person_id from {t.PEOPLE} where department = 'BUILDING' and (contains(lower(full_name), '42') or contains(email, '42') or contains(person_id::varchar, '42'))")
def people_search(spark, sf):
    return M.people_search(t.people(spark, sf).withColumn("role", F.lit("member")), "42", "BUILDING").select("person_id")


@query(f"select (select count(*) filter (where review_status = 'open') from {t.MEETINGS}) as pending, (select count(*) filter (where status = 'dispatched') from {t.DELIVERIES}) as delivered, (select count(distinct department) from {t.PEOPLE}) as departments")
def kpi_counts(spark, sf):
    return M.kpis(t.meetings(spark, sf), t.deliveries(spark, sf), t.people(spark, sf))


@query("select o_orderkey, case o_orderstatus when 'F' then 'tasks' when 'O' then 'risks' else 'overview' end as topic from orders")
def fallback_topics(spark, sf):
    q = F.when(F.col("o_orderstatus") == "F", "Ce sarcini sunt?").when(F.col("o_orderstatus") == "O", "What RISKS exist").otherwise("hello")
    return t.table(spark, sf, "orders").select("o_orderkey", M.fallback_topic(q).alias("topic"))


@query("with a as (select o_custkey as answer_id, o_orderkey as meeting_id, o_orderdate as held_at from orders), r as (select answer_id, meeting_id, row_number() over (partition by answer_id order by held_at desc, meeting_id desc) as rank from a) select answer_id, meeting_id, rank::int as rank from r where rank <= 4")
def referenced_meetings(spark, sf):
    m = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.format_string("m%d end", "o_orderkey").alias("title"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("scheduled_at"), "o_custkey")
    answers = m.groupBy(F.col("o_custkey").alias("answer_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("see M"), F.substr("title", F.lit(2))))), ", ").alias("text"))
    return M.referenced_meetings(answers, m.drop("o_custkey"))


@query("select l_orderkey as meeting_id, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P') group by 1")
def cascade_delete(spark, sf):
    gone = t.meetings(spark, sf).where("review_status = 'pending'")
    return M.cascade_delete({"items": t.items(spark, sf)}, gone)["items"].groupBy("meeting_id").agg(F.count("*").alias("n"))


@query(f"select segment_id, case when attribution_state = 'suggested' and meeting_id % 5 = 0 then 'anonymous' else attribution_state end as attribution_state, attribution_state = 'suggested' and meeting_id % 5 = 0 as changed from {t.SEGMENTS}")
def withdrawn_suggestions(spark, sf):
    s = t.segments(spark, sf).withColumn("suggested_id", F.col("meeting_id") % 5)
    gone = spark.createDataFrame([(0,)], "person_id long")
    return M.withdrawn_suggestions(s, gone).select("segment_id", "attribution_state", "changed")


# --- delivery -------------------------------------------------------------------------


@query(f"with d as (select *, max(case when status = 'dispatched' then revision end) over (partition by meeting_id) as top, row_number() over (partition by meeting_id, revision order by status = 'dispatched' desc, created_at desc nulls last, delivery_id desc) as n from {t.DELIVERIES}) select meeting_id, revision, status, created_at from d where n = 1 and (status = 'dispatched' or revision >= coalesce(top, -1))")
def delivery_collapse(spark, sf):
    return delivery.collapsed(t.deliveries(spark, sf)).select("meeting_id", "revision", "status", "created_at")


@query(f"select delivery_id, coalesce(created_at, sent_at) as at from {t.DELIVERIES} where meeting_id = 5")
def delivery_list(spark, sf):
    return delivery.deliveries_listed(t.deliveries(spark, sf), 5).select("delivery_id", "at")


@query(f"select delivery_id from {t.DELIVERIES} where status = 'failed' or meeting_id % 3 = 0")
def delivery_search(spark, sf):
    d = t.deliveries(spark, sf).withColumns({"title": F.lit("Minutes"), "recipients": F.when(F.col("meeting_id") % 3 == 0, F.array(F.lit("Failed@x.org"))).otherwise(F.array(F.lit("a@x.org")))})
    return delivery.delivery_search(d, "FAILED").select("delivery_id")


_MAIL = f"(select o_orderkey as meeting_id, o_orderkey % 4 = 0 as own, lower(c_mktsegment) || '.' || c_custkey || '@example.org' as email, o_orderpriority from orders join customer on o_custkey = c_custkey)"


@query(f"select meeting_id, array_to_string(case when own then ['own@x.org'] else list_sort(list_distinct([email, 'archive@x.org', 'head@x.org'])) end, ',') as recipients from {_MAIL}")
def recipient_union(spark, sf):
    m = t.meetings(spark, sf).withColumn("distribution_list", F.when(F.col("meeting_id") % 4 == 0, F.array(F.lit(" OWN@x.org"), F.lit("nobody"), F.lit("own@x.org "))).otherwise(F.array(F.lit(""))))
    policies = m.select("meeting_type").distinct().withColumns({"default_recipients": F.array(F.lit("Head@x.org")), "cc_recipients": F.array(F.lit("archive@x.org"), F.lit(None))})
    came = m.join(t.people(spark, sf).select(F.col("person_id").alias("chair"), "email"), "chair").select("meeting_id", "email")
    return delivery.recipients(m.join(came.select("meeting_id"), "meeting_id"), policies, came).select("meeting_id", F.array_join("recipients", ",").alias("recipients"))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'a@x.org,b@x.org' else 'p' || s_suppkey || '@x.org' end as to_list, case when s_suppkey % 3 = 0 then '' else 'a@x.org' end as cc_list from supplier")
def cc_split(spark, sf):
    resolved = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("a@x.org"), F.lit("b@x.org"))).otherwise(F.array(F.lit("a@x.org"), F.format_string("p%d@x.org", "s_suppkey")))
    s = t.table(spark, sf, "supplier").select("s_suppkey", delivery.to_and_cc(resolved, F.array(F.lit("A@x.org"), F.lit("b@x.org"))).alias("r"))
    return s.select("s_suppkey", F.array_join("r.to", ",").alias("to_list"), F.array_join("r.cc", ",").alias("cc_list"))


@query(f"select o_orderkey as meeting_id, coalesce(primary_language, 'ro') as languages from orders join {t.PEOPLE} on o_custkey = person_id")
def email_languages(spark, sf):
    p = t.people(spark, sf)
    a = t.meetings(spark, sf).join(p.select(F.col("person_id").alias("chair")), "chair").select("meeting_id", F.col("chair").alias("person_id"), F.lit(None).cast("string").alias("primary_language"))
    return delivery.email_languages(a, p)


@query(f"select meeting_id, case when revision = 0 then 'degraded_draft' when meeting_id % 4 = 1 then 'stale_minutes' end as dispatch, case when review_status = 'approved' then 'already_approved' when mode = 'batch' then 'not_completed' when revision = 0 then 'degraded_draft' when meeting_id % 4 = 1 then 'stale_minutes' else 'approve' end as approval from {t.MEETINGS}")
def dispatch_guard(spark, sf):
    m = t.meetings(spark, sf).withColumns({"is_degraded": F.col("revision") == 0, "needs_transcript_review": F.col("meeting_id") % 4 == 1, "processing_status": F.when(F.col("mode") == "batch", "running").otherwise("completed")})
    return m.select("meeting_id", delivery.dispatch_verdict().alias("dispatch"), delivery.approval_verdict().alias("approval"))


@query(f"select d.delivery_id, case when m.mode = 'batch' then 'not_completed' when m.chair % 5 = 0 then 'not_approved' when d.revision <> m.revision then 'old_revision' when d.status = 'dispatched' then 'already_sent' end as reason from {t.DELIVERIES} d join {t.MEETINGS} m using (meeting_id)")
def resend_guard(spark, sf):
    m = t.meetings(spark, sf).select("meeting_id", F.col("revision").alias("current_revision"), F.when(F.col("mode") == "batch", "running").otherwise("completed").alias("processing_status"), F.when(F.col("chair") % 5 != 0, "somebody").alias("approved_by"))
    return t.deliveries(spark, sf).join(m, "meeting_id").select("delivery_id", delivery.resend_verdict().alias("reason"))


@query(f"select m.meeting_id, m.revision + case when review_status = 'approved' or exists (select 1 from {t.DELIVERIES} d where d.meeting_id = m.meeting_id and d.revision = m.revision and d.status = 'dispatched') then 1 else 0 end as revision from {t.MEETINGS} m")
def revision_bumps(spark, sf):
    return delivery.bumped_revisions(t.meetings(spark, sf), t.deliveries(spark, sf))


@query(f"with o as (select meeting_id, revision, created_at as at, status, row_number() over (partition by meeting_id order by revision desc, created_at desc, status desc) as n from {t.DELIVERIES} where created_at is not null), s as (select meeting_id, revision, created_at as at, 'queued' as status from {t.MEETINGS}) select coalesce(o.meeting_id, s.meeting_id) as meeting_id, case when o.meeting_id is not null and (s.meeting_id is null or o.revision > s.revision or o.revision = s.revision and o.at >= s.at) then o.status else s.status end as status from (select * from o where n = 1) o full join s on o.meeting_id = s.meeting_id")
def outcome_merge(spark, sf):
    state = t.meetings(spark, sf).select("meeting_id", "revision", F.lit("queued").alias("status"), F.col("created_at").alias("at"))
    out = t.deliveries(spark, sf).where("created_at is not null").select("meeting_id", "revision", "status", F.col("created_at").alias("at"))
    return delivery.merged_outcomes(state, out).select("meeting_id", "status")


@query(f"select meeting_id, '[MoM] ' || title || ' - ' || strftime(created_at, '%d.%m.%Y') || ' (Rev.' || revision || ')' as subject from {t.MEETINGS}")
def subject_lines(spark, sf):
    return t.meetings(spark, sf).select("meeting_id", delivery.subject(F.lit("[MoM]"), F.col("title"), F.col("created_at"), F.col("revision")).alias("subject"))


@query(f"select meeting_id, count(*) filter (where kind = 'decision') as decisions, count(*) filter (where kind = 'action') as actions, count(*) filter (where kind = 'risk') as risks from {t.ITEMS} group by 1")
def body_counts(spark, sf):
    return delivery.body_counts(t.items(spark, sf))


@query(f"select full_name as name from {t.PEOPLE} union select trim(owner) from {t.ITEMS} where kind = 'action' and owner is not null union select confirmed_display_name from {t.SEGMENTS} where confirmed_display_name is not null")
def protected_names(spark, sf):
    a = t.items(spark, sf).where("kind = 'action'").withColumn("owner_source", F.lit("roster"))
    return delivery.protected_names(t.people(spark, sf), a, t.segments(spark, sf))


@query("select o_orderkey as body_id, 'Customer One' as name from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'Dr. Popescu Ana' from orders where o_orderkey % 3 = 1")
def leaked_names(spark, sf):
    body = F.when(F.col("o_orderkey") % 3 == 0, "all about CUSTOMER things").when(F.col("o_orderkey") % 3 == 1, "as popescu said, ana too").otherwise("nothing by dr ana one")
    bodies = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("body_id"), body.alias("body"))
    return minutes.leaked_names(bodies, spark.createDataFrame([("Customer One",), ("Dr. Popescu Ana",)], "name string"))


# --- context and translation ----------------------------------------------------------


_TERMS = "(select c_custkey as meeting_id, unnest([{'term': c_name, 'weight': 2.5e0}, {'term': lower(c_name), 'weight': 3e0}, {'term': c_mktsegment, 'weight': 2e0}, {'term': 'nation' || c_nationkey, 'weight': 2e0}], recursive := true) from customer)"


@query(f"with f as (select meeting_id, lower(term) as low, term, weight, row_number() over (partition by meeting_id, lower(term) order by weight desc, term) as n from {_TERMS}) select meeting_id, term, weight, (row_number() over (partition by meeting_id order by weight desc, low))::int as rank from f where n = 1")
def ranked_terms(spark, sf):
    c = t.table(spark, sf, "customer")
    term = lambda x, w: F.struct(x.alias("term"), F.lit("term").alias("category"), F.lit("s").alias("source"), F.lit(w).alias("weight"))
    every = F.array(term(F.col("c_name"), 2.5), term(F.lower("c_name"), 3.0), term(F.col("c_mktsegment"), 2.0), term(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")), 2.0))
    return context.best_terms(c.select(F.col("c_custkey").alias("meeting_id"), F.explode(every).alias("t")).select("meeting_id", "t.*")).select("meeting_id", "term", "weight", "rank")


@query("select c_custkey as meeting_id, unnest(case when c_custkey % 2 = 0 then ['Popov', 'Ion Popov', 'Попов'] else ['Иванова', 'Анна Иванова', 'Ivanova', 'Anna Ivanova'] end) as term from customer")
def attendee_terms(spark, sf):
    a = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("meeting_id"), F.when(F.col("c_custkey") % 2 == 0, "Dr. Ion Popov").otherwise("Анна Иванова").alias("name"), F.lit(None).cast("string").alias("primary_language"))
    return context.attendee_terms(a).select("meeting_id", "term")


@query("select c_custkey as meeting_id, unnest(case when c_mktsegment = 'BUILDING' then ['brick', 'BUILDING'] when c_mktsegment = 'MACHINERY' then ['gear', 'MACHINERY'] else [c_mktsegment] end) as term from customer")
def department_terms(spark, sf):
    v = spark.createDataFrame([("building site", "brick", "term", 2.0), ("machine", "gear", "term", 1.5), ("none", "x", "term", 1.0)], "department string, term string, category string, weight double")
    m = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("meeting_id"), F.col("c_mktsegment").alias("department"))
    return context.department_terms(m, v).select("meeting_id", "term")


@query("with t as (select *, row_number() over (partition by o_custkey order by o_orderkey) as rank from orders), c as (select *, sum(greatest(1, floor(length('term' || o_orderkey) / 3.5e0 + 0.5e0)) + case when rank > 1 then 1 else 0 end) over (partition by o_custkey order by rank) as used from t) select o_custkey as meeting_id, coalesce(string_agg('term' || o_orderkey, ', ' order by rank) filter (where used <= 20), '') as prompt_seed, string_agg('term' || o_orderkey, ',' order by rank) filter (where rank <= 5) as hotwords from c group by 1")
def budgeted_hotwords(spark, sf):
    from pyspark.sql import Window

    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("meeting_id"), F.format_string("term%d", "o_orderkey").alias("term"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"))
    return context.budgeted(o, max_items=5, max_tokens=20).select("meeting_id", "prompt_seed", F.array_join("hotwords", ",").alias("hotwords"))


@query("select o_orderkey as item_id, case when o_orderkey % 4 = 3 then null when o_orderkey % 4 = 2 then 'place ' || o_orderkey else 'id ' || o_orderkey end as translated from orders")
def translation_join(spark, sf):
    from pyspark.sql import Window

    i = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("item_id"), F.lit("text").alias("text"))
    k = F.col("item_id") % 4
    placed = i.withColumn("pos", F.row_number().over(Window.partitionBy("meeting_id").orderBy("item_id")) - 1)
    r = placed.select("meeting_id", "pos", F.when(k < 2, F.col("item_id")).alias("item_id"), F.when(k == 3, "names S3").when(k == 2, F.format_string("place %d", "item_id")).otherwise(F.format_string("id %d", "item_id")).alias("translated"))
    return translation.joined_back(i, r).select("item_id", "translated")


@query(f"select item_id, case when category = 'budget' then 'B' else text end as shown from {t.ITEMS}")
def localized_items(spark, sf):
    return translation.localized(t.items(spark, sf).withColumn("text_ru", F.when(F.col("category") == "budget", "B").otherwise("")), "ru").select("item_id", "shown")


@query(f"select meeting_id, bool_or(coalesce(category, '') <> '') as has_ru, false as has_en from {t.ITEMS} group by 1")
def translation_completeness(spark, sf):
    return translation.completeness(t.items(spark, sf).withColumns({"text_ru": F.col("category"), "text_en": F.lit("")}), ["ru", "en"])


@query()
def merge_items(spark, sf):
    i = t.items(spark, sf).where("kind = 'action'").select("meeting_id", F.col("item_id").alias("pos"), "text", F.array((F.col("weight") % 30).cast("int")).alias("evidence"), (F.col("weight") % 3).cast("int").alias("chunk"), "priority", "owner", F.lit(None).cast("string").alias("deadline"), F.array(F.lit("S1")).alias("speakers"))
    return folds.merged_items(i)
