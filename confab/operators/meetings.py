"""Meetings, their items and dashboards: counts, work lists, searches.

``as_of`` stands in for now, so results repeat. Lists are limited only where the limit is the
feature, and then by an order without ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = ("open", "in_progress")
CATEGORIES = ("clinical", "budget", "operations", "protocol")


def held_at() -> Column:
    return F.coalesce("scheduled_at", "created_at")


def newest_first(meetings: DataFrame) -> DataFrame:
    return meetings.withColumn("held_at", held_at()).orderBy(F.desc("held_at"), F.desc("meeting_id"))


def one_meeting(meetings: DataFrame, meeting_id) -> DataFrame:
    return meetings.where(F.col("meeting_id") == meeting_id)


def people_list(people: DataFrame, include_inactive: bool = False) -> DataFrame:
    return (people if include_inactive else people.where("is_active")).orderBy(F.lower("full_name"), "person_id")


def with_minutes(meetings: DataFrame, minutes: DataFrame) -> DataFrame:
    """Every meeting, with its minutes if there are any."""
    return meetings.join(minutes, "meeting_id", "left")


def catalog(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """Every meeting with its numbers of decisions and actions."""
    n = items.groupBy("meeting_id").agg(F.count_if(F.col("kind") == "decision").alias("decisions"), F.count_if(F.col("kind") == "action").alias("actions"))
    zero = F.lit(0).cast("long")
    return meetings.join(n, "meeting_id", "left").select(*meetings.columns, F.coalesce("decisions", zero).alias("decisions"), F.coalesce("actions", zero).alias("actions"))


def dashboard(meetings: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """One row of totals: meetings (of 7 and 30 days too), decisions (of 7 days too), actions, lagging ones."""
    now = F.lit(as_of).cast("timestamp_ntz")
    at = held_at().cast("timestamp_ntz")
    recent = at >= now - F.expr("interval 7 days")
    a = meetings.agg(F.count("*").alias("meetings"), F.count_if(recent).alias("meetings_7d"), F.count_if(at >= now - F.expr("interval 30 days")).alias("meetings_30d"))
    dated = items.join(meetings.select("meeting_id", recent.alias("recent")), "meeting_id")
    decision, action = F.col("kind") == "decision", F.col("kind") == "action"
    b = dated.agg(F.count_if(decision).alias("decisions"), F.count_if(decision & F.col("recent")).alias("decisions_7d"), F.count_if(action).alias("actions"), F.count_if(action & F.col("status").isin(*OPEN)).alias("lagging"))
    return a.crossJoin(b)  # one row each


def category_counts(items: DataFrame) -> DataFrame:
    """Decisions by category; the known categories are there even at 0."""
    spark = items.sparkSession
    seeds = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    n = items.where("kind = 'decision'").groupBy(F.lower(F.coalesce("category", F.lit("clinical"))).alias("category")).agg(F.count("*").alias("n"))
    return seeds.join(n, "category", "full").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("decisions"))


def owner_workload(items: DataFrame) -> DataFrame:
    owner = F.trim(F.coalesce("owner", F.lit("Unassigned")))
    return items.where("kind = 'action'").groupBy(owner.alias("owner")).agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*OPEN)).alias("open"), F.count_if(F.col("status") == "completed").alias("completed"))


def recent(meetings: DataFrame, n: int = 4) -> DataFrame:
    return newest_first(meetings).limit(n)


def lagging_actions(items: DataFrame, meetings: DataFrame, n: int = 15) -> DataFrame:
    late = items.where((F.col("kind") == "action") & F.col("status").isin(*OPEN))
    return late.join(meetings.select("meeting_id", held_at().alias("held_at")), "meeting_id").orderBy(F.desc("held_at"), F.desc("meeting_id"), "item_id").limit(n)


def high_risks(items: DataFrame, meetings: DataFrame, n: int = 5) -> DataFrame:
    risks = items.where("kind = 'risk' and severity = 'high'")
    return risks.join(meetings.select("meeting_id", held_at().alias("held_at")), "meeting_id").orderBy(F.desc("held_at"), F.desc("meeting_id"), "item_id").limit(n)


def matches(query: str, *columns: str) -> Column:
    """The query stands in any of the columns, whatever the case."""
    out = F.lit(query == "")
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
    return out


def meeting_search(meetings: DataFrame, query: str = "", mode: str | None = None, status: str | None = None) -> DataFrame:
    """By title, type, or an attendee's name or department (attendees: array of structs)."""
    found = meetings.where(F.col("mode") == mode) if mode else meetings
    found = found.where(F.col("review_status") == status) if status else found
    q = F.lit(query.lower())
    here = F.exists("attendees", lambda a: F.contains(F.lower(F.coalesce(a["name"], F.lit(""))), q) | F.contains(F.lower(F.coalesce(a["department"], F.lit(""))), q))
    return found.where(matches(query, "title", "meeting_type") | F.coalesce(here, F.lit(False)))


def item_search(items: DataFrame, kind: str, query: str = "", category: str | None = None, priority: str | None = None, open_only: bool = False) -> DataFrame:
    found = items.where(F.col("kind") == kind)
    found = found.where(F.col("category") == category) if category else found
    found = found.where(F.col("priority") == priority) if priority else found
    found = found.where(F.col("status") != "completed") if open_only else found
    return found.where(matches(query, "text", "owner"))


def audit_marked(items: DataFrame) -> DataFrame:
    """Risks that an audit wrote itself."""
    return items.where((F.col("kind") == "risk") & F.col("text").rlike(r"(?iU)^\s*(?:notă audit|audit note)"))


def people_search(people: DataFrame, query: str = "", department: str | None = None) -> DataFrame:
    found = people.where(F.col("department") == department) if department else people
    return found.where(matches(query, "full_name", "department", "email", "role", "person_id"))


def kpis(meetings: DataFrame, deliveries: DataFrame, people: DataFrame) -> DataFrame:
    a = meetings.agg(F.count_if(F.col("review_status") == "open").alias("pending"))
    b = deliveries.agg(F.count_if(F.col("status") == "dispatched").alias("delivered"))
    c = people.agg(F.count_distinct("department").alias("departments"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def fallback_topic(question) -> Column:
    """What an assistant without a model talks about, by the first keyword that is there."""
    q = F.lower(question)
    out = F.when(q.isNull(), "overview")
    for topic, keys in (("decisions", ("decizi", "decision", "решени")), ("tasks", ("task", "sarcin", "задач", "action")), ("risks", ("risc", "risk", "риск")), ("people", ("cine", "who", "кто"))):
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(q, F.lit(k))
        out = out.when(hit, topic)
    return out.otherwise("overview")


def referenced_meetings(answers: DataFrame, meetings: DataFrame, n: int = 4) -> DataFrame:
    """Per answer (answer_id, text) up to ``n`` meetings whose title it holds, newest first.

    Titles are looked up by their first word, so only answers that hold it meet a title."""
    from pyspark.sql import Window

    first = lambda c: F.regexp_extract(F.lower(c), r"[\p{L}\p{N}#]+", 0)
    tokens = answers.select("answer_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}#]+"), F.lit(0)))).alias("w"))
    both = tokens.join(meetings.select("meeting_id", "title", held_at().alias("held_at"), first("title").alias("w")), "w").where(F.contains(F.lower("text"), F.lower("title")))
    w = Window.partitionBy("answer_id").orderBy(F.desc("held_at"), F.desc("meeting_id"))
    return both.select("answer_id", "meeting_id", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the meetings in ``gone`` (meeting_id)."""
    ids = gone.select("meeting_id").distinct()
    return {name: t.join(ids, "meeting_id", "left_anti") for name, t in tables.items()}


def withdrawn_suggestions(segments: DataFrame, gone: DataFrame) -> DataFrame:
    """Suggestions of people in ``gone`` (person_id) are taken back; decided rows stay as they are."""
    ids = gone.select(F.col("person_id").alias("suggested_id"), F.lit(True).alias("__gone")).distinct()
    hit = F.col("__gone") & (F.col("attribution_state") == "suggested")
    both = segments.join(ids, "suggested_id", "left")
    return both.withColumns({"changed": F.coalesce(hit, F.lit(False)), "attribution_state": F.when(hit, "anonymous").otherwise(F.col("attribution_state"))}).withColumn("suggested_id", F.when(F.col("changed"), F.lit(None)).otherwise(F.col("suggested_id"))).drop("__gone")
