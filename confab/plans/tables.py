"""The driver's tables as the engine's entities, in Spark and, for the oracles, in SQL.

conversations are segments, orders are meetings, lineitem holds items and deliveries,
customer people, embeddings voices, events corrections and speech regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _same(spark: SparkSession, sf_dir: str, source: str, cells: str) -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*[c.strip() for c in cells.strip().split(";\n")])


def _sql(source: str, cells: str) -> str:
    return f"(select {', '.join(c.strip() for c in cells.strip().split(';' + chr(10)))} from {source})"


# Expressions that mean the same in both dialects.
_SEGMENTS = """
conv_id as meeting_id;
cast(turn as int) as idx;
concat(conv_id, '-', turn) as segment_id;
turn * 6e0 as start_s;
turn * 6e0 + length(text) / 15e0 as end_s;
length(text) / 15e0 as speech_seconds;
case role when 'user' then 'Speaker 1' when 'assistant' then 'Speaker 2' else 'Speaker 3' end as speaker;
case role when 'user' then 'SPEAKER_01' when 'assistant' then 'SPEAKER_02' else 'SPEAKER_03' end as cluster_id;
text;
case conv_id % 4 when 0 then 'ro' when 1 then 'ru' when 2 then 'mixed' else 'und' end as language;
((turn * 37 + conv_id * 11) % 200) / -100e0 as avg_logprob;
1 + ((conv_id * 13 + turn * 7) % 30) / 10e0 as compression_ratio;
((conv_id * 29 + turn * 3) % 100) / 100e0 as no_speech_prob;
case conv_id % 3 when 0 then 'confirmed' when 1 then 'suggested' else 'anonymous' end as attribution_state;
case when conv_id % 3 = 0 then concat('Person ', conv_id % 7) end as confirmed_display_name;
conv_id % 3 = 0 and length(text) / 15e0 >= 2e0 as printable_name
"""
_MEETINGS = """
o_orderkey as meeting_id;
concat(o_orderpriority, ' #', o_orderkey) as title;
lower(o_orderpriority) as meeting_type;
case o_orderstatus when 'F' then 'batch' else 'live' end as mode;
case o_orderstatus when 'O' then 'open' when 'P' then 'pending' else 'approved' end as review_status;
case when o_orderkey % 5 = 0 then null else o_orderdate end as scheduled_at;
o_orderdate as created_at;
cast(o_orderkey % 3 as int) as revision;
o_custkey as chair
"""
_ITEMS = """
l_orderkey as meeting_id;
concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) as item_id;
case l_returnflag when 'A' then 'action' when 'N' then 'decision' else 'risk' end as kind;
case when l_suppkey % 10 = 0 then null else concat(' S', l_suppkey % 20, ' ') end as owner;
case when l_linestatus = 'F' then 'completed' when l_quantity > 25 then 'open' else 'in_progress' end as status;
case l_partkey % 5 when 0 then 'Clinical' when 1 then 'budget' when 2 then 'operations' when 3 then null else 'research' end as category;
case when l_discount >= 0.07e0 then 'high' when l_discount >= 0.03e0 then 'medium' else 'low' end as severity;
case when l_tax >= 0.05e0 then 'high' else 'medium' end as priority;
concat('item ', l_partkey) as text;
l_extendedprice as weight
"""
_DELIVERIES = """
l_orderkey % 2000 as meeting_id;
l_linenumber as revision;
concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey, '/', l_extendedprice) as delivery_id;
case l_returnflag when 'A' then 'dispatched' when 'N' then 'failed' else 'saved' end as status;
case when l_partkey % 9 = 0 then null else l_shipdate end as created_at;
l_shipdate as sent_at
"""
_PEOPLE = """
c_custkey as person_id;
c_name as full_name;
c_mktsegment as department;
concat(lower(c_mktsegment), '.', c_custkey, '@example.org') as email;
c_custkey % 7 <> 0 as is_active;
c_acctbal > 0 as consent_given;
case when c_nationkey = 3 then c_acctbal end as consent_withdrawn_at;
case c_nationkey % 4 when 0 then 'ru' when 1 then 'ro' end as primary_language
"""
_VOICES = """
vec_id;
cast(label as bigint) as label;
embedding as vector;
vec_id % 40 as cluster_id;
1e0 + vec_id % 9 as speech_s
"""
_CORRECTIONS = """
event_id % 3000 as event_id;
event_id as seq;
user_id as meeting_id;
concat(user_id, '-', event_id % 8) as segment_id;
event_type as edit_kind;
ts as created_at;
case event_id % 3 when 0 then 'verified' when 1 then 'unverified' else 'rejected' end as verification_status;
event_id % 2 = 0 as verified_against_audio;
event_id % 5 <> 0 as training_reuse_allowed;
case when event_id % 11 = 0 then null else value end as audio_start;
case when event_id % 13 = 0 then null else value + event_id % 40 end as audio_end;
case when event_id % 4 = 0 then null else concat('SPEAKER_0', event_id % 4) end as speaker_cluster;
case when event_id % 6 = 0 then '' else concat('text ', event_id % 100) end as new_text;
concat('reviewer ', event_id % 5) as reviewer;
case event_id % 3 when 0 then 'ro' when 1 then 'ru' else 'en' end as language
"""


def segments(spark, sf_dir):
    return _same(spark, sf_dir, "conversations", _SEGMENTS)


def meetings(spark, sf_dir):
    return _same(spark, sf_dir, "orders", _MEETINGS)


def items(spark, sf_dir):
    return _same(spark, sf_dir, "lineitem", _ITEMS)


def deliveries(spark, sf_dir):
    return _same(spark, sf_dir, "lineitem", _DELIVERIES)


def people(spark, sf_dir):
    return _same(spark, sf_dir, "customer", _PEOPLE)


def voices(spark, sf_dir):
    return _same(spark, sf_dir, "embeddings", _VOICES)


def corrected(events: DataFrame) -> DataFrame:
    """Rows of events, in a batch or a stream, as corrections."""
    return events.selectExpr(*[c.strip() for c in _CORRECTIONS.strip().split(";\n")])


def corrections(spark, sf_dir):
    return _same(spark, sf_dir, "events", _CORRECTIONS)


def regions(spark, sf_dir):
    """Events as speech of their user's recording, in seconds of the month."""
    e = table(spark, sf_dir, "events")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    return e.select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("region_id"), at.alias("start_s"), (at + F.col("value") * 20.0).alias("end_s"), (F.col("event_id") % 5).alias("label"))


SEGMENTS, MEETINGS, ITEMS = _sql("conversations", _SEGMENTS), _sql("orders", _MEETINGS), _sql("lineitem", _ITEMS)
DELIVERIES, PEOPLE, VOICES, CORRECTIONS = _sql("lineitem", _DELIVERIES), _sql("customer", _PEOPLE), _sql("embeddings", _VOICES), _sql("events", _CORRECTIONS)
REGIONS = "(select user_id as meeting_id, event_id as region_id, (epoch_us(ts) - 1704067200000000) / 1e6 as start_s, (epoch_us(ts) - 1704067200000000) / 1e6 + value * 20e0 as end_s, event_id % 5 as label from events)"
