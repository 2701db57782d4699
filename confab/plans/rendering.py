"""Queries on labels and names in texts, owners, hotwords, error rates of recordings and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions import arrow
from confab.functions import text as T
from confab.operators import context, evaluation as E, learning as L, minutes as M, rebase, segments as S
from confab.streaming import streams

from . import corrections
from . import tables as t
from .registry import query

# --- labels ---------------------------------------------------------------------------

_A, _B = "(o_orderkey % 30 + 1)", "(o_custkey % 9 + 1)"
#: Sentences with two numbers a and b, and the labels (a, b) that are speakers in them.
_SENTENCES = [
    ("S{a} a propus, S{b} nu", "ab"), ("nivel L5-S{b}, S{a}", ""), ("nivel L5-S{b}. S{a} nu", "a"), ("zgomotele S{a}, S{b} și S3", ""), ("We discussed S{a} first, not S{b}", "ab"), ("murmur also S{a}", "a"),
    ("stadiul bolii, S{a} a zis", "a"), ("Speaker {b} și S{a}", "ab"), ("zgomote cardiace S{a}; S{b} spune", "b"), ("galop S{a} de S{b}", ""), ("S{a} zgomotos, S{b} nu", "b"), ("disc de S{a}, apoi S{b}", "b"), ("S{a} disc, S{b}", "b"), ("uneori S{a}", "a"),
]


def _spoken(sentence, wrap):
    parts = sentence.replace("{a}", "\0a\0").replace("{b}", "\0b\0").split("\0")
    return [wrap(p) if p not in ("a", "b") else p for p in parts if p]


_SAID = " ".join(f"when {k} then concat({', '.join({'a': _A, 'b': _B}.get(p, p) for p in _spoken(s, lambda x: chr(39) + x + chr(39)))})" for k, (s, _) in enumerate(_SENTENCES))
_LABELS = " ".join(f"when {k} then list_sort(list_distinct([{', '.join({'a': _A, 'b': _B}[x] for x in who)}]::bigint[]))" for k, (_, who) in enumerate(_SENTENCES))


def _texts(spark, sf):
    """o_orderkey, a, b and a sentence of the order's kind."""
    o = t.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 30 + 1).alias("a"), (F.col("o_custkey") % 9 + 1).alias("b"))
    said = None
    for k, (s, _) in enumerate(_SENTENCES):
        text = F.concat(*[F.col(p).cast("string") if p in ("a", "b") else F.lit(p) for p in _spoken(s, str)])
        hit = F.col("o_orderkey") % len(_SENTENCES) == k
        said = F.when(hit, text) if said is None else said.when(hit, text)
    return arrow.dealt(o.withColumn("text", said))


def _people(n=9):
    return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f"Person {k}").alias("v")) for k in range(1, n + 1)]))


@query(f"select o_orderkey, case o_orderkey % {len(_SENTENCES)} {_SAID} end as text, array_to_string(list_transform(case o_orderkey % {len(_SENTENCES)} {_LABELS} end, lambda n: 'S' || n), ',') as labels from orders")
def speaker_labels(spark, sf):
    return _texts(spark, sf).select("o_orderkey", "text", F.array_join(M.labels_in("text"), ",").alias("labels"))


_TOLD = f"case when {_A} <= 9 then 'Person ' else 'S' end || {_A} || ' told Person ' || {_B} || ' of murmur S1'"


@query(f"select o_orderkey, {_TOLD} as once, {_TOLD} as twice from orders")
def rendered_texts(spark, sf):
    x = _texts(spark, sf).withColumn("stored", F.format_string("S%d told S%d of murmur S1", "a", "b")).withColumn("once", M.rendered("stored", _people()))
    return x.select("o_orderkey", "once", M.rendered("once", _people()).alias("twice"))


@query(f"select o_orderkey, case when o_orderkey % 2 = 0 then 'as it was' else 'S' || {_A} || ' told S' || {_B} || ' of murmur S1, twice' end as stored from orders")
def reversed_edits(spark, sf):
    """Even texts come back as they were shown, odd ones with a word more."""
    x = _texts(spark, sf).withColumn("shown", M.rendered(F.format_string("S%d told S%d of murmur S1", "a", "b"), _people()))
    sent = x.withColumn("sent", F.when(F.col("o_orderkey") % 2 == 0, F.col("shown")).otherwise(F.concat("shown", F.lit(", twice"))))
    return sent.select("o_orderkey", M.edited_form(F.col("sent"), F.col("shown"), F.lit("as it was"), _people()).alias("stored"))


@query(f"select o_orderkey, 'S' || {_B} || ' said' as text, 'S' || {_B} as speakers, {_A} <> {_B} as repaired from orders")
def grounded_label_texts(spark, sf):
    label = F.format_string("S%d", "b")
    g = M.grounded_labels(F.format_string("S%d said", "a"), F.array(F.format_string("S%d", "a"), F.format_string("Speaker %d", "b")), F.array(label), label)
    return _texts(spark, sf).select("o_orderkey", g.alias("g")).select("o_orderkey", "g.text", F.array_join("g.speakers", ",").alias("speakers"), "g.repaired")


@query(f"select meeting_id, segment_id, case when attribution_state = 'confirmed' and printable_name then confirmed_display_name end as confirmed_name, speaker from {t.SEGMENTS}")
def attributed_evidence(spark, sf):
    s = t.segments(spark, sf)
    return M.attributed_evidence(s.select("meeting_id", "segment_id", F.lit("old").alias("speaker")), s).select("meeting_id", "segment_id", "confirmed_name", "speaker")


@query(f"select distinct meeting_id, case when meeting_id % 3 = 0 and meeting_id % 2 = 0 then (select min(speaker) from {t.SEGMENTS} x where x.meeting_id = s.meeting_id) else 'Person ' || meeting_id % 7 end as owner from {t.SEGMENTS} s")
def renamed_owners(spark, sf):
    """Even meetings are relabelled: all of their names go."""
    s = t.segments(spark, sf)
    after = s.withColumn("attribution_state", F.when(F.col("meeting_id") % 2 == 0, "anonymous").otherwise(F.col("attribution_state")))
    actions = s.select("meeting_id", F.concat(F.lit("Person "), (F.col("meeting_id") % 7).cast("string")).alias("owner")).distinct()
    return M.renamed_owners(actions, s, after)


@query(f"select meeting_id, cluster_id, 'label' as action, count(*) as segments from {t.SEGMENTS} where meeting_id % 2 = 0 group by all")
def decision_events(spark, sf):
    s = t.segments(spark, sf)
    d = s.where("meeting_id % 2 = 0").select("meeting_id", "cluster_id").distinct().withColumns({"action": F.lit("label"), "name": F.lit("Ana"), "decided_at": F.lit(1)})
    return M.decision_events(s, d).select("meeting_id", "cluster_id", "action", "segments")


# --- names ----------------------------------------------------------------------------


@query("select o_orderkey as item_id, case o_orderkey % 4 when 0 then 'Dr. Ion Popescu' when 1 then 'Speaker 3' when 2 then 'Zinaida' else 'Unassigned' end as owner, ['roster', 'speaker', 'mention', 'unassigned'][o_orderkey % 4 + 1] as owner_source from orders")
def resolved_owners(spark, sf):
    k = F.col("o_orderkey") % 4
    mention = F.when(k == 0, "doctorul Popesku").when(k == 1, "noi").when(k == 2, "Zinaida")
    a = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("item_id"), mention.alias("mention"), F.when(k == 1, "S3").alias("owner_label"), F.concat(F.lit("va face "), F.coalesce(mention, F.lit("cineva"))).alias("cited_text"))
    who = a.select("meeting_id").distinct().select("meeting_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("Dr. Ion Popescu").alias("name")), F.struct(F.lit(1).alias("pos"), F.lit("Ana Popescu").alias("name")))).alias("x")).select("meeting_id", "x.*")
    return M.resolved_owners(arrow.dealt(a), who).select("item_id", "owner", "owner_source")


@query("select o_orderkey as item_id, unnest(case when o_orderkey % 3 = 1 then ['Maria', 'Rusu'] when o_orderkey % 3 = 2 then ['Zinaida'] else [] end) as token from orders")
def unknown_names(spark, sf):
    """Popeskuu and Ionescu are close to known words; Maria, Rusu and Zinaida are not."""
    k = F.col("o_orderkey") % 3
    p = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(k == 0, "azi vine Ionescuu Popescu").when(k == 1, "azi vine Maria Rusu").otherwise("azi pleaca Zinaida Popescuu").alias("text"))
    return M.unknown_names(p, spark.createDataFrame([("Ionescu",), ("popescu",), ("Marin",)], "word string"))


@query("select o_orderkey, 'vine Persoana 1 si Persoana 2, order ' || o_orderkey as text from orders")
def anonymised_texts(spark, sf):
    names = F.map_from_arrays(F.array(F.lit("Ion"), F.lit("Ion Popescu")), F.array(F.lit("Persoana 2"), F.lit("Persoana 1")))
    return _texts(spark, sf).select("o_orderkey", M.anonymised(F.format_string("vine Ion Popescu si ion, order %d", "o_orderkey"), names).alias("text"))


# --- hotwords -------------------------------------------------------------------------


@query(f"select trim(new_text) as term, case edit_kind when 'click' then 'medication' else 'term' end as category, 1.5::double as weight from (select * from {t.CORRECTIONS} where verification_status = 'verified' order by created_at desc, event_id desc limit 50) where trim(new_text) <> ''")
def verified_terms(spark, sf):
    e = t.corrections(spark, sf).withColumn("edit_kind", F.when(F.col("edit_kind") == "click", "drug").otherwise(F.col("edit_kind")))
    return context.verified_terms(e).select("term", "category", "weight")


@query("""with w as (select c_custkey as meeting_id, 0 as s, 0 as p, 'Term' || c_custkey as term from customer union all select c_custkey, 0, 1, 'beta' from customer union all select c_custkey, 1, 1, 'gamma' from customer union all select c_custkey, 1, 2, 'delta' from customer),
r as (select *, row_number() over (partition by meeting_id order by s, p) as rank from w), u as (select *, sum(greatest(1, floor(length(term) / 3.5e0 + 0.5e0)) + case when rank > 1 then 1 else 0 end) over (partition by meeting_id order by rank) as used from r)
select meeting_id, rank::int as rank, term from u where used <= 7""")
def merged_hotwords(spark, sf):
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("meeting_id"), F.lit("ro").alias("language"), F.posexplode(F.array(F.format_string("Term%d", "c_custkey"), F.lit("beta"))).alias("pos", "term"))
    base = spark.createDataFrame([("ro", 0, "BETA"), ("ro", 1, "gamma"), ("ro", 2, "delta"), ("en", 0, "other")], "language string, pos int, term string")
    return context.merged_hotwords(c, base, max_tokens=7).select("meeting_id", "rank", "term")


@query(f"""with v as (select distinct trim(new_text) as term, 1.5e0 as weight from (select * from {t.CORRECTIONS} where verification_status = 'verified' order by created_at desc, event_id desc limit 50) where trim(new_text) <> ''),
a as (select c_custkey as meeting_id, unnest([{{'term': 'Popov', 'weight': 3e0}}, {{'term': 'Ion Popov', 'weight': 2.5e0}}, {{'term': 'Попов', 'weight': 3e0}}, {{'term': c_mktsegment, 'weight': 2e0}}, {{'term': 'cardiologie', 'weight': 1e0}}]) as x from customer),
e as (select meeting_id, x.term as term, x.weight as weight from a union all select c_custkey, term, weight from customer, v)
select meeting_id, (row_number() over (partition by meeting_id order by weight desc, lower(term)))::int as rank, term, weight from e""")
def built_contexts(spark, sf):
    c = t.table(spark, sf, "customer")
    attendees = c.select(F.col("c_custkey").alias("meeting_id"), F.lit("Dr. Ion Popov").alias("name"), F.lit(None).cast("string").alias("primary_language"))
    meetings = c.select(F.col("c_custkey").alias("meeting_id"), F.col("c_mktsegment").alias("department"), F.lit("Raport cardiologie").alias("title"), F.lit(None).cast("string").alias("agenda"))
    vocabulary = spark.createDataFrame([("nothing like it", "x", "term", 1.0)], "department string, term string, category string, weight double")
    return context.built_context(attendees, meetings, vocabulary, t.corrections(spark, sf)).select("meeting_id", "rank", "term", "weight")


# --- error rates ----------------------------------------------------------------------

_WORDS = "len(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[.,;:!?\"''“”«»()\\[\\]{{}}]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), ' '), lambda w: w <> ''))"
_CHARS = "length(regexp_replace(regexp_replace(lower({x}), '[.,;:!?\"''“”«»()\\[\\]{{}}]', '', 'g'), '[ \\t\\n\\r\\f\\x0b]+', '', 'g'))"
_HEARD = f"(select conv_id, turn, conv_id % 3 as condition, {_WORDS.format(x='text')}::bigint as w, {_CHARS.format(x='text')}::bigint as c, turn % 5 = 0 or conv_id % 20 = 0 as missed from conversations)"


def _gold(spark, sf, step=100_000.0):
    """Conversations as recordings: turns far apart, so that no two overlap."""
    c = t.table(spark, sf, "conversations")
    start = F.col("turn") * step
    return c.select(F.col("conv_id").alias("recording_id"), (F.col("conv_id") % 3).cast("string").alias("acoustic_condition"), F.col("turn").alias("idx"), F.col("turn").cast("string").alias("segment_id"), start.alias("start_s"), (start + 10.0).alias("end_s"), F.element_at(F.array(*map(F.lit, ("ro", "ru", "en"))), (F.col("turn") % 3 + 1).cast("int")).alias("language"), F.col("text").alias("verbatim_text"))


def _heard(gold, all_of_it=False):
    """A recogniser that misses every fifth turn, and every twentieth recording."""
    some = gold if all_of_it else gold.where("idx % 5 <> 0 and recording_id % 20 <> 0")
    return some.select("recording_id", "idx", "start_s", "end_s", F.col("verbatim_text").alias("text"))


@query(f"select conv_id as recording_id, 0::bigint as s, 0::bigint as i, 0::bigint as cs, 0::bigint as ci, coalesce(sum(w) filter (where missed), 0)::bigint as d, sum(w)::bigint as n, coalesce(sum(c) filter (where missed), 0)::bigint as cd, sum(c)::bigint as cn, round(case when sum(w) > 0 then coalesce(sum(w) filter (where missed), 0) / sum(w) else 0 end, 9) as wer from {_HEARD} group by 1")
def recording_error_rates(spark, sf):
    """What is missed is deleted, and no cheaper edit makes one text as much shorter."""
    gold = _gold(spark, sf)
    counts = E.error_counts(E.recording_pairs(gold, _heard(gold)))
    return counts.select("recording_id", "s", "d", "i", "n", "cs", "cd", "ci", "cn", F.round(E.word_error_rate(), 9).alias("wer"))


@query(f"select condition::varchar as condition, coalesce(sum(w) filter (where missed), 0)::bigint as d, sum(w)::bigint as n, count(distinct conv_id) as rows, round(coalesce(sum(w) filter (where missed), 0) / sum(w), 9) as wer, round(coalesce(sum(c) filter (where missed), 0) / sum(c), 9) as cer from {_HEARD} group by rollup (condition)")
def slice_error_rates(spark, sf):
    gold = _gold(spark, sf)
    s = E.error_slices(E.error_counts(E.recording_pairs(gold, _heard(gold))), ["acoustic_condition"])
    return s.select(F.col("acoustic_condition").alias("condition"), "d", "n", "rows", F.round("wer", 9).alias("wer"), F.round("cer", 9).alias("cer"))


@query(f"select ['ro', 'ru', 'en'][turn % 3 + 1] as language, coalesce(sum(w) filter (where missed), 0)::bigint as d, sum(w)::bigint as n, round(coalesce(sum(w) filter (where missed), 0) / sum(w), 9) as wer from {_HEARD} group by 1")
def language_error_rates(spark, sf):
    gold = _gold(spark, sf)
    return E.language_errors(gold, _heard(gold)).select("language", "d", "n", F.round("wer", 9).alias("wer"))


@query(f"with a as (select *, sum(w) over (partition by conv_id) as every from {_HEARD}) select ['ro', 'ru', 'en'][turn % 3 + 1] as language, sum(every - w)::bigint as i, sum(w)::bigint as n from a group by 1")
def language_error_rates_whole(spark, sf):
    """A segment against all that was heard: the rest of the recording is inserted."""
    gold = _gold(spark, sf)
    return E.language_errors(gold, _heard(gold, True), whole_recording=True).where("s = 0 and d = 0").select("language", "i", "n")


@query("""with p as (select o_custkey as m, o_orderkey as k, o_orderkey % 3 <> 0 as hit, case when o_orderkey % 2 = 0 then o_orderkey % 7 end as due from orders)
select round(count(*) filter (where not hit) / count(*), 9) as fabrication, round(count(*) filter (where hit and due is not null and k % 5 <> 0) / count(*) filter (where hit and due is not null), 9) as deadline_recall, round((count(*) + count(*) filter (where k % 4 = 0)) / (2 * count(*)), 9) as evidence_validity from p""")
def extraction_measures(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("pos"))
    due = F.when(F.col("pos") % 2 == 0, (F.col("pos") % 7).cast("string"))
    gold = o.withColumns({"evidence": F.array(F.lit(1)), "deadline": due})
    pred = o.withColumns({"evidence": F.array(F.lit(1), F.when(F.col("pos") % 4 == 0, 1).otherwise(99)), "deadline": F.when(F.col("pos") % 5 == 0, "never").otherwise(due)})
    pairs = o.where("pos % 3 <> 0").select("meeting_id", F.col("pos").alias("gold"), F.col("pos").alias("pred"))
    m = E.extraction_measures(gold, pred, pairs, o.select("meeting_id", F.lit(1).alias("idx")).distinct())
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("select user_id as meeting_id, count(*) as chunks, count(*) filter (where event_id % 5 = 0) as failed, count(*) filter (where event_id % 5 = 0) > 0.2 * count(*) as rejected from events group by 1")
def chunk_outcomes(spark, sf):
    return L.chunk_outcome(t.table(spark, sf, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("chunk"), (F.col("event_id") % 5 == 0).alias("failed")))


@query("select user_id as meeting_id, count(*) as calls, sum(event_id % 100)::bigint as prompt_tokens, sum(event_id % 10)::bigint as completion_tokens, round(case when count(*) filter (where event_id % 3 <> 0) > 0 then count(*) filter (where event_id % 3 <> 0 and event_id % 7 <> 0) / count(*) filter (where event_id % 3 <> 0) end, 9) as first_pass_rate from events group by 1")
def call_totals(spark, sf):
    k = F.col("event_id")
    c = t.table(spark, sf, "events").select(F.col("user_id").alias("meeting_id"), (k % 100).alias("prompt_tokens"), (k % 10).alias("completion_tokens"), F.when(k % 3 == 0, 2).otherwise(1).alias("attempt"), (k % 7 != 0).alias("ok"))
    return L.call_totals(c).withColumn("first_pass_rate", F.round("first_pass_rate", 9))


@query("""select o_orderkey, sha256('{"customer":' || o_custkey || ',"priority":"' || o_orderpriority || '","unknown":null}') as digest from orders""")
def report_hashes(spark, sf):
    o = t.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("unknown"), F.col("o_custkey").alias("customer"))
    return o.select("o_orderkey", L.report_hash("priority", "unknown", "customer").alias("digest"))


# --- small text functions -------------------------------------------------------------


@query("select doc_id, trim(regexp_replace(replace(strip_accents(lower(coalesce(text, ''))), 'ß', 'ss'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) as base, trim(regexp_replace(regexp_replace(replace(strip_accents(lower(coalesce(text, ''))), 'ß', 'ss'), '[^\\p{L}\\p{N}_ \\t\\n\\r\\f\\x0b]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) as bare from documents")
def comparable_texts(spark, sf):
    return arrow.dealt(t.table(spark, sf, "documents")).select("doc_id", arrow.base_text("text").alias("base"), arrow.bare_text("text").alias("bare"))


@query("select p_partkey, p_brand || '@' || substr(md5(p_name), 1, 12) as space, '[RO] ' || p_name as fallback, regexp_full_match(p_brand, '[A-Za-z0-9_-]{1,64}') as opaque, lpad((p_partkey // 60)::varchar, 2, '0') || ':' || lpad((p_partkey % 60)::varchar, 2, '0') || '-' || lpad(((p_partkey + 75) // 60)::varchar, 2, '0') || ':' || lpad(((p_partkey + 75) % 60)::varchar, 2, '0') as interval, greatest(256, least(2300, 4096 - p_size * 50 - 400))::bigint as budget from part")
def text_identifiers(spark, sf):
    p, k = t.table(spark, sf, "part"), F.col("p_partkey")
    return p.select("p_partkey", T.space_id("p_brand", F.md5("p_name")).alias("space"), T.fallback_translation("p_name", "ro").alias("fallback"), T.valid_opaque_id("p_brand").alias("opaque"), T.clock_interval(k + 0.25, k + 75.5).alias("interval"), T.chunk_budgets(F.lit(4096), F.col("p_size") * 50, F.lit(400), F.lit(2300)).cast("long").alias("budget"))


@query("select event_id, case when event_id % 4 = 0 then 'ro' when event_id % 4 = 1 then 'en' when event_id % 4 = 2 then 'en' else 'ru' end as alternative from events")
def alternative_languages(spark, sf):
    """Russian was heard but for every fourth window: the text tells another allowed language, or the next best one is taken."""
    k = F.col("event_id") % 4
    ranked = F.array(*[F.struct(F.lit(x).alias("language"), F.lit(p).alias("p")) for x, p in (("ru", 0.6), ("en", 0.3), ("ro", 0.1))])
    e = t.table(spark, sf, "events").select("event_id", F.when(k == 3, "en").otherwise("ru").alias("acoustic_language"), ranked.alias("ranking"), F.struct(F.when(k == 0, "ro").when(k == 1, "und").when(k == 2, "fr").otherwise("en").alias("language")).alias("text_lid"))
    return e.select("event_id", S.alternative_language(["ro", "en", "ru"]).alias("alternative"))


# --- streams --------------------------------------------------------------------------


_REBASED = """
with o as (select o_orderkey as k, 1 + o_orderkey % 9 as a, 1 + o_custkey % 9 as b from orders),
n as (select *, case when a % 4 = 0 then 'Ana Pop' else 'Dr. N' || a end as name_a, case when b % 4 = 0 then 'Ana Pop' else 'Dr. N' || b end as name_b from o),
d as (select *, case when name_a = name_b and a <> b then name_a else 'S' || a end as tok_a, case when name_a = name_b and a <> b then name_b else 'S' || b end as tok_b from n)
select k as meeting_id, 'decision' as field, case when k % 3 = 0 then 'S' || a || ' propune planul ' || k else tok_a || ' propune planul ' || k || ' și S3 cu ' || tok_b end as text from d
union all select k, 'task', 'Notă: ' || tok_b || ' răspunde lui ' || tok_a || '.' from d
union all select k, 'owner', 'Speaker ' || case when name_a = name_b then a else b end from d
"""


@query(_REBASED)
def rebased_edits(spark, sf):
    """Orders as meetings with two named speakers, which now and then share a name; an owner of the same name is untouched."""
    a, b = F.col("o_orderkey") % 9 + 1, F.col("o_custkey") % 9 + 1
    name = lambda n: F.when(n % 4 == 0, "Ana Pop").otherwise(F.format_string("Dr. N%d", n))
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("meeting_id"), a.alias("a"), b.alias("b"), name(a).alias("x"), name(b).alias("y"))
    plan = F.format_string(" propune planul %d", "meeting_id")
    decision = F.concat("x", plan)
    answer = F.concat("y", F.lit(" răspunde lui "), "x", F.lit("."))
    touched = F.when(F.col("meeting_id") % 3 == 0, decision).otherwise(F.concat(decision, F.lit(" și Vorbitorul 3 cu "), "y"))
    rows = [("decision", "prose", F.concat(F.lit("S"), "a", plan), decision, touched), ("task", "prose", F.concat(F.lit("Speaker "), "b", F.lit(" răspunde lui S"), "a", F.lit(".")), answer, F.concat(F.lit("Notă: "), answer)), ("owner", "speaker", F.concat(F.lit("Speaker "), "a"), F.col("x"), F.col("y"))]
    fields = o.select("meeting_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), s.alias("stored"), F.array(v).alias("shown"), e.alias("edited")) for f, k, s, v, e in rows])).alias("f")).select("meeting_id", "f.*")
    return rebase.rebased(fields).select("meeting_id", "field", "text")


def _streamed(spark, sf, name):
    return spark.readStream.schema(t.table(spark, sf, name).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf}/{name}.parquet")


_ADMITTED = """
with recursive e as (select (user_id % 10)::varchar as queue, (event_id // 11 % 23)::varchar as job, event_id as seq, case when event_id % 11 < 4 then 'submit' when event_id % 11 < 7 then 'claim' when event_id % 11 = 8 then 'delete' when event_id % 110 = 10 then 'restart' else 'finish' end as op, epoch_ms(ts) as now, row_number() over (partition by user_id % 10 order by event_id) as n from events),
q as (
  select queue, 0::bigint as n, []::varchar[] as waiting, null::varchar as run, null::bigint as since, null::bigint as until, []::varchar[] as ended, null::varchar as job, null::bigint as seq, null::varchar as verdict, null::varchar as lost, null::bigint as lost_seq from (select distinct queue from e)
  union all
  select queue, n, case when verdict = 'queued' then list_append(waiting, job) when verdict = 'claimed' then waiting[2:] else waiting end,
    case when verdict = 'claimed' then job when verdict in ('finished', 'interrupted') then null else run end, case when verdict = 'claimed' then seq else since end, case when verdict = 'claimed' then now + 3600000 else until end,
    case when verdict in ('finished', 'interrupted') then list_append(ended, job) when verdict = 'deleted' then list_filter(ended, lambda x: x <> job) else ended end, job, seq, verdict, lost, lost_seq
  from (select queue, n, waiting, run, since, until, ended, now, seq, lost, lost_seq, verdict, case when op = 'claim' then case verdict when 'claimed' then waiting[1] else run end when op = 'restart' then run else job end as job
    from (select *, case op
        when 'submit' then case when list_contains(waiting, job) or coalesce(run = job, false) or list_contains(ended, job) then 'repeated' when len(waiting) + (run is not null)::int >= 10 then 'rejected' else 'queued' end
        when 'claim' then case when run is not null then 'busy' when len(waiting) = 0 then 'idle' else 'claimed' end
        when 'finish' then case when coalesce(run = job, false) then 'finished' else 'unknown' end
        when 'restart' then case when run is not null then 'interrupted' else 'idle' end
        else case when list_contains(waiting, job) or coalesce(run = job, false) then 'refused' when list_contains(ended, job) then 'deleted' else 'unknown' end end as verdict
      from (select e.queue, e.n, e.job, e.seq, e.op, e.now, q.waiting, q.since, q.until, case when coalesce(q.run is not null and q.until <= e.now, false) then null else q.run end as run, case when coalesce(q.run is not null and q.until <= e.now, false) then list_append(q.ended, q.run) else q.ended end as ended,
          case when coalesce(q.run is not null and q.until <= e.now, false) then q.run end as lost, case when coalesce(q.run is not null and q.until <= e.now, false) then q.since end as lost_seq
        from q join e on e.queue = q.queue and e.n = q.n + 1)))
)
select queue, job as job_id, seq, verdict from q where n > 0 union all select queue, lost, lost_seq, 'expired' from q where lost is not null
"""


@query(_ADMITTED)
def admitted_jobs(spark, sf):
    """Events as a stream of a queue's ops: jobs, the lease and what ended are state, verdicts are files."""
    from confab.sources.stores import scratch

    k = F.col("event_id")
    op = F.when(k % 11 < 4, "submit").when(k % 11 < 7, "claim").when(k % 11 == 8, "delete").when(k % 110 == 10, "restart").otherwise("finish")
    jobs = _streamed(spark, sf, "events").select((F.col("user_id") % 10).cast("string").alias("queue"), (F.floor(k / 11) % 23).cast("string").alias("job_id"), k.alias("seq"), op.alias("op"), "ts")
    path, schema = scratch(spark, "queue"), streams.QUEUE
    streams.with_rocksdb(spark)
    # a watermark that passes no lease: only a queue's own ops end them
    found = streams.admitted(jobs, delay="3650 days")
    found.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "queue-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query(f"select * from {corrections._LATEST}")
def catalog_projected(spark, sf):
    """Corrections as a stream: each batch writes the events that it changed, and the last change of each is the catalogue."""
    from confab.operators import learning
    from confab.sources.stores import scratch

    events = t.corrected(_streamed(spark, sf, "events"))
    path = scratch(spark, "catalogue")
    streams.with_rocksdb(spark)
    streams.kept_up(streams.projected(events, kept=learning.KEPT, first=("created_at",)), path, scratch(spark, "catalogue-state")).awaitTermination()
    return streams.current(spark.read.parquet(path)).select("event_id", "seq", "meeting_id", "edit_kind", "created_at", "verification_status", "audio_start", "audio_end", "speaker_cluster", "new_text")
