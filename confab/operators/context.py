"""Context for a recogniser: terms from people, departments, verified edits and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions import text as T
from confab.functions.words import HONORIFICS, SURNAME_ENDINGS


def _term(text, category: str, source: str, weight: float) -> Column:
    return F.struct(text.alias("term"), F.lit(category).alias("category"), F.lit(source).alias("source"), F.lit(weight).alias("weight"))


def attendee_terms(attendees: DataFrame) -> DataFrame:
    """meeting_id, term, category, source, weight from attendees (meeting_id, name, primary_language):
    the family name, the full name, and both spelled in the other script where that helps."""
    raw = F.trim(F.coalesce("name", F.lit("")))
    bare = F.trim(F.regexp_replace(raw, HONORIFICS, ""))
    a = attendees.withColumn("n", F.when(bare != "", bare).otherwise(raw)).where("n <> ''")
    family = F.element_at(F.split("n", r"\s+"), -1)
    several, cyrillic = F.size(F.split("n", r"\s+")) > 1, F.col("n").rlike(T.CYRILLIC)
    russian = (F.col("primary_language") == "ru") | F.lower(family).rlike("(?:" + "|".join(SURNAME_ENDINGS) + ")$")
    latin, latin_full, other = T.cyrillic_to_latin(family), T.cyrillic_to_latin(F.col("n")), T.latin_to_cyrillic(family)
    terms = F.array(
        _term(family, "attendee", "attendee_family_name", 3.0),
        F.when(several, _term(F.col("n"), "attendee", "attendee_full_name", 2.5)),
        F.when(cyrillic & (latin != "") & (latin != family), _term(latin, "attendee", "attendee_family_name_translit", 3.0)),
        F.when(cyrillic & several & (latin_full != F.col("n")), _term(latin_full, "attendee", "attendee_full_name_translit", 2.5)),
        F.when(~cyrillic & F.coalesce(russian, F.lit(False)) & (other != family), _term(other, "attendee", "attendee_family_name_translit", 3.0)),
    )
    return a.select("meeting_id", F.explode(F.array_compact(terms)).alias("t")).select("meeting_id", "t.*")


def _contained(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) where the text a of ``inner`` stands in the text b of ``outer``: joined by a's first three letters."""
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.array(*[F.substr(F.col(b), i, F.lit(n)) for n in (1, 2, 3)]))))
    left = inner.where(F.length(a) > 0).withColumn("__part", F.substring(a, 1, 3))
    return left.join(outer.where(F.length(b) > 0).withColumn("__part", F.explode(parts)), "__part").where(F.contains(b, a)).select(a, b)


def department_terms(meetings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Terms of the vocabulary (department, term, category, weight) whose department holds a
    meeting's or stands in it, and the meeting's department itself. Departments are distinct, so
    they meet once each, however many meetings there are; a name meets only those that have its
    first three letters somewhere, so no pair is compared that shares nothing."""
    own = meetings.where(F.trim(F.coalesce("department", F.lit(""))) != "").select("meeting_id", F.trim("department").alias("d"))
    names = own.select(F.lower("d").alias("k")).distinct()
    keys = vocabulary.select("department").where("department <> ''").distinct()
    pairs = _contained(names, keys, "k", "department").unionByName(_contained(keys, names, "department", "k").select("k", "department")).distinct()
    found = pairs.join(vocabulary, "department").select("k", "term", "category", F.concat(F.lit("department_vocab:"), F.col("department")).alias("source"), F.col("weight").cast("double").alias("weight"))
    a = own.withColumn("k", F.lower("d")).join(found, "k").select("meeting_id", "term", "category", "source", "weight")
    return a.unionByName(own.select("meeting_id", _term(F.col("d"), "department", "meeting_department", 2.0).alias("t")).select("meeting_id", "t.*"))


def verified_terms(events: DataFrame, newest: int = 50, max_words: int = 4) -> DataFrame:
    """Short verified texts of the newest events."""
    text = F.trim(F.coalesce("new_text", F.lit("")))
    some = events.where("verification_status = 'verified'").orderBy(F.desc("created_at"), F.desc("event_id")).limit(newest)
    category = F.when(F.col("edit_kind").isin("medication", "drug"), "medication").when(F.col("edit_kind").isin("procedure", "surgery"), "procedure").otherwise("term")
    return some.where((text != "") & (F.size(F.split(text, r"\s+")) <= max_words)).select(text.alias("term"), category.alias("category"), F.lit("verified_catalog").alias("source"), F.lit(1.5).alias("weight"))


def title_terms(meetings: DataFrame) -> DataFrame:
    words = T.keyword_list(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("agenda", F.lit(""))))
    return meetings.select("meeting_id", F.explode(words).alias("w")).select("meeting_id", _term(F.col("w"), "term", "meeting_title_or_agenda", 1.0).alias("t")).select("meeting_id", "t.*")


def best_terms(terms: DataFrame) -> DataFrame:
    """Each term once whatever its case, with the highest weight (the first spelling on ties), ranked by weight, then name."""
    clean = terms.withColumn("term", F.trim("term")).where("term <> ''")
    one = clean.groupBy("meeting_id", F.lower("term").alias("low")).agg(F.min_by(F.struct("term", "category", "source", "weight"), F.struct(-F.col("weight"), "term", "source")).alias("t"))
    w = Window.partitionBy("meeting_id").orderBy(F.desc("t.weight"), "low")
    return one.select("meeting_id", F.row_number().over(w).alias("rank"), "t.*")


def budgeted(ranked: DataFrame, max_items: int = 40, max_tokens: int = 80) -> DataFrame:
    """Per meeting the first terms as hotwords, and as a seed the longest prefix within the tokens.
    Tokens of a joined list are those of its terms and one for each comma."""
    w = Window.partitionBy("meeting_id").orderBy("rank")
    cost = T.hotword_tokens("term") + F.when(F.col("rank") > 1, 1).otherwise(0)
    run = ranked.withColumn("__used", F.sum(cost).over(w)).withColumn("__seed", F.col("__used") <= max_tokens)
    # costs are not negative, so what fits is a prefix
    listed = F.array_sort(F.collect_list(F.struct("rank", "term", "__seed")))
    got = run.groupBy("meeting_id").agg(listed.alias("all"))
    return got.select("meeting_id", F.transform(F.slice("all", 1, max_items), lambda x: x["term"]).alias("hotwords"), F.array_join(F.transform(F.filter("all", lambda x: x["__seed"]), lambda x: x["term"]), ", ").alias("prompt_seed"))


def merged_hotwords(context: DataFrame, base: DataFrame, max_tokens: int = 80) -> DataFrame:
    """Per meeting and language the context's words, then the language's own (language, pos,
    term), each once, up to the budget of tokens."""
    first = context.select("meeting_id", "language", F.lit(0).alias("source"), "pos", "term")
    both = first.unionByName(context.select("meeting_id", "language").distinct().join(base, "language").select("meeting_id", "language", F.lit(1).alias("source"), "pos", "term"))
    one = both.where(F.trim("term") != "").groupBy("meeting_id", "language", F.lower(F.trim("term")).alias("low")).agg(F.min(F.struct("source", "pos", F.trim("term").alias("term"))).alias("t"))
    w = Window.partitionBy("meeting_id", "language").orderBy("t.source", "t.pos")
    ranked = one.select("meeting_id", "language", "t.term", F.row_number().over(w).alias("rank"))
    cost = T.hotword_tokens("term") + F.when(F.col("rank") > 1, 1).otherwise(0)
    return ranked.withColumn("used", F.sum(cost).over(Window.partitionBy("meeting_id", "language").orderBy("rank"))).where(F.col("used") <= max_tokens).drop("used")


def built_context(attendees: DataFrame, meetings: DataFrame, vocabulary: DataFrame, events: DataFrame) -> DataFrame:
    """Ranked terms of every meeting from all four sources."""
    shared = meetings.where("department is not null").select("meeting_id").crossJoin(verified_terms(events))  # at most 50 terms on the right
    every = attendee_terms(attendees).unionByName(department_terms(meetings, vocabulary)).unionByName(shared).unionByName(title_terms(meetings))
    return best_terms(every)
