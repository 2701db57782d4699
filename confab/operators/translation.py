"""Translation results joined back to their items, and what of the minutes is translated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions import text as T
from confab.operators.minutes import labels_in


def joined_back(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items (meeting_id, item_id, text) with their translation: the result of the same id, or,
    of results without an id, that in the item's place (results: meeting_id, pos, item_id, translated).
    A translation that changes the speaker labels is not taken."""
    placed = items.withColumn("pos", F.row_number().over(Window.partitionBy("meeting_id").orderBy("item_id")) - 1)
    named = results.where("item_id is not null").groupBy("meeting_id", "item_id").agg(F.min_by("translated", "pos").alias("by_id"))
    bare = results.where("item_id is null").select("meeting_id", "pos", F.col("translated").alias("by_place"))
    both = placed.join(named, ["meeting_id", "item_id"], "left").join(bare, ["meeting_id", "pos"], "left")
    got = both.withColumn("t", T.first_filled("by_id", "by_place"))
    return got.select("meeting_id", "item_id", "text", F.when(same_labels("text", "t"), F.col("t")).alias("translated"))


def same_labels(a, b) -> Column:
    return labels_in(a).eqNullSafe(labels_in(b))


def localized(items: DataFrame, language: str) -> DataFrame:
    """Items with ``shown``: their text in the language if there is one, else the original."""
    return items.withColumn("shown", T.first_filled(f"text_{language}", "text"))


def completeness(items: DataFrame, languages: list[str]) -> DataFrame:
    """Per meeting whether any item has a text in each language."""
    return items.groupBy("meeting_id").agg(*[F.bool_or(F.coalesce(F.col(f"text_{x}"), F.lit("")) != "").alias(f"has_{x}") for x in languages])
