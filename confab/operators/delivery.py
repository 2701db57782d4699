"""Delivery: who receives the minutes, what may be sent, and what a history shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def addresses(emails) -> Column:
    """Trimmed, lower-cased addresses of an array, each once, sorted; what has no @ is dropped."""
    e = F.col(emails) if isinstance(emails, str) else emails
    clean = F.transform(F.coalesce(e, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & F.contains(x, F.lit("@")))))


def recipients(meetings: DataFrame, policies: DataFrame, attendees: DataFrame, policies_on: bool = True) -> DataFrame:
    """(meeting_id, recipients): a meeting's own list if it has one, else its type's policy
    (meeting_type, default_recipients, cc_recipients) and its attendees (meeting_id, email)."""
    came = attendees.groupBy("meeting_id").agg(F.collect_set("email").alias("came"))
    both = meetings.join(policies, "meeting_type", "left").join(came, "meeting_id", "left")
    none = F.array().cast("array<string>")
    ruled = F.concat(F.coalesce("default_recipients", none), F.coalesce("cc_recipients", none)) if policies_on else none
    own = addresses("distribution_list")
    return both.select("meeting_id", F.when(F.size(own) > 0, own).otherwise(addresses(F.concat(ruled, F.coalesce("came", none)))).alias("recipients"))


def to_and_cc(resolved, cc_pool) -> Column:
    """struct(to, cc): copies are what the pool holds; if that leaves nobody, they are recipients."""
    to, cc = F.array_except(resolved, addresses(cc_pool)), F.array_intersect(resolved, addresses(cc_pool))
    none = F.array().cast("array<string>")
    return F.when(F.size(to) > 0, F.struct(to.alias("to"), cc.alias("cc"))).otherwise(F.struct(cc.alias("to"), none.alias("cc")))


def email_languages(attendees: DataFrame, people: DataFrame, default: str = "ro") -> DataFrame:
    """Per meeting its attendees' languages in order: their own, that of their person, or the default."""
    who = people.select("person_id", F.col("primary_language").alias("__theirs"))
    spoken = attendees.join(who, "person_id", "left").select("meeting_id", F.coalesce("primary_language", "__theirs", F.lit(default)).alias("language"))
    return spoken.groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def dispatch_verdict() -> Column:
    """Why minutes may not be sent; null if they may."""
    return F.when(F.col("is_degraded"), "degraded_draft").when(F.col("needs_transcript_review"), "stale_minutes")


def resend_verdict() -> Column:
    """Why a saved delivery may not be sent again, first reason first."""
    return (
        F.when(F.col("processing_status") != "completed", "not_completed")
        .when(F.col("approved_by").isNull(), "not_approved")
        .when(F.col("revision") != F.col("current_revision"), "old_revision")
        .when(~F.col("status").isin("saved", "failed"), "already_sent")
    )


def approval_verdict() -> Column:
    return F.when(F.col("review_status") == "approved", "already_approved").when(F.col("processing_status") != "completed", "not_completed").otherwise(F.coalesce(dispatch_verdict(), F.lit("approve")))


def deliveries_listed(deliveries: DataFrame, meeting_id=None) -> DataFrame:
    found = deliveries if meeting_id is None else deliveries.where(F.col("meeting_id") == meeting_id)
    return found.withColumn("at", F.coalesce("created_at", "sent_at")).orderBy(F.desc("at"), F.desc("delivery_id"))


def collapsed(deliveries: DataFrame) -> DataFrame:
    """What a history shows: of each revision the latest dispatch, else the latest attempt, unless
    a later revision was dispatched. Attempts without a time are the earliest; the higher id is later on ties."""
    sent = F.col("status") == "dispatched"
    top = F.max(F.when(sent, F.col("revision"))).over(Window.partitionBy("meeting_id"))
    order = Window.partitionBy("meeting_id", "revision").orderBy(F.desc(sent), F.desc_nulls_last("created_at"), F.desc("delivery_id"))
    ranked = deliveries.withColumns({"__top": top, "__n": F.row_number().over(order)})
    return ranked.where((F.col("__n") == 1) & (sent | (F.col("revision") >= F.coalesce("__top", F.lit(-1))))).drop("__top", "__n")


def delivery_search(deliveries: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return deliveries.where(F.contains(F.lower("status"), q) | F.contains(F.lower("title"), q) | F.exists("recipients", lambda r: F.contains(F.lower(r), q)))


def subject(prefix, title, day, revision) -> Column:
    return F.format_string("%s %s - %s (Rev.%d)", prefix, title, F.date_format(day, "dd.MM.yyyy"), revision)


def body_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("meeting_id").agg(F.count_if(F.col("kind") == "decision").alias("decisions"), F.count_if(F.col("kind") == "action").alias("actions"), F.count_if(F.col("kind") == "risk").alias("risks"))


def bumped_revisions(minutes: DataFrame, deliveries: DataFrame) -> DataFrame:
    """A revision goes up once if it was signed off or dispatched."""
    sent = deliveries.where("status = 'dispatched'").select("meeting_id", "revision", F.lit(True).alias("__sent")).distinct()
    both = minutes.join(sent, ["meeting_id", "revision"], "left")
    up = F.coalesce("__sent", F.lit(False)) | (F.col("review_status") == "approved")
    return both.select("meeting_id", F.when(up, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"))


def merged_outcomes(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Delivery outcomes (meeting_id, revision, status, at) written to a state (meeting_id,
    revision, status, at), unless the state is of a later revision or time."""
    last = outcomes.groupBy("meeting_id").agg(F.max(F.struct("revision", "at", "status")).alias("o"))
    both = state.join(last, "meeting_id", "full")
    newer = F.col("o").isNotNull() & (F.col("revision").isNull() | (F.struct(F.col("o.revision"), F.col("o.at")) >= F.struct("revision", "at")))
    return both.select("meeting_id", *[F.when(newer, F.col(f"o.{c}")).otherwise(F.col(c)).alias(c) for c in ("revision", "status", "at")])


def protected_names(people: DataFrame, actions: DataFrame, segments: DataFrame) -> DataFrame:
    """Names that must not leave by mail: people, named owners, confirmed speakers."""
    a = people.select(F.col("full_name").alias("name"))
    b = actions.where(F.col("owner_source").isin("roster", "mention", "confirmed_speaker")).select(F.col("owner").alias("name"))
    c = segments.select(F.col("confirmed_display_name").alias("name"))
    return a.unionByName(b).unionByName(c).where(F.length(F.trim("name")) > 0).select(F.trim("name").alias("name")).distinct()
