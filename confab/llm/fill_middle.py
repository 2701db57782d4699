"""Fill-in-middle transformation by relational units.

A text is cut into units, words with the white space before them. Seeded draws from the document's
id choose two cuts, counted in units, and the form: plain, prefix-suffix-middle or
suffix-prefix-middle. The lengths of the units are exploded with their ordinals, a window sums
them up, the cut requests (unit ordinals) join on, and an aggregation gives each document its two
offsets in code points; the text is then cut by substring and put together with sentinels.

Everything is built-in functions. The units of a document travel as an array of lengths, under
a key of its id and text, and are exploded after that shuffle, which the window, the
join and the aggregation then use as it is; repeated rows are one row there. Plain documents,
whose form shows before any unit is counted, take no part in it, and their texts are not
shuffled. Offsets go back to the texts by key, dealt to parts where a row is repeated very often.

Edge cases: null or empty texts are plain, with no units. Texts that hold a sentinel stay
plain, so every output can be undone. White space at the end of a text is a unit of its own. A null
doc_id draws as an empty number. Repeated rows draw alike and each get their row. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, spread_join

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draw(k: int, seed: int) -> Column:
    """The ``k``-th seeded draw of a document, an unsigned 32-bit number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def plans(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, text and form of each document; ``rate`` and ``spm_rate`` are percentages."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | (draw(3, seed) % 100 >= rate) | held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("form", F.when(plain, "plain").when(draw(4, seed) % 100 < spm_rate, "spm").otherwise("psm"))


def offsets(planned: DataFrame, seed: int = 42) -> DataFrame:
    """Per distinct cut document: key, copies, n units, and the ends of prefix and middle in code points."""
    units = F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))
    lengths = planned.where(F.col("form") != "plain").select(row_key("doc_id", "text").alias("key"), "doc_id", F.transform(units, F.char_length).alias("lengths"))
    # both uses of ``each`` name all of its columns, so that they share one shuffle
    each = lengths.groupBy("key").agg(F.first(F.struct("doc_id", "lengths")).alias("doc"), F.count("*").alias("copies"))
    known = each.select("key", "copies", "doc.doc_id", F.size("doc.lengths").cast("long").alias("n"))
    drawn = [draw(k, seed) % (F.col("n") + 1) for k in (1, 2)]
    asked = known.select("key", "copies", "n", F.least(*drawn).alias("first"), F.greatest(*drawn).alias("second"))
    numbered = each.select("key", "copies", F.posexplode("doc.lengths").alias("pos", "length"))
    upto = Window.partitionBy("key", "copies").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = numbered.select("key", (F.col("pos") + 1).cast("long").alias("unit"), F.sum("length").over(upto).alias("end"))
    # on the key alone, by which both are already dealt: a document asks for two of its units
    met = asked.join(ended, "key").where((F.col("unit") == F.col("first")) | (F.col("unit") == F.col("second")) | (F.col("unit") == 1))
    at = [F.coalesce(F.max(F.when(F.col("unit") == F.col(c), F.col("end"))), F.lit(0)).cast("long").alias(f"{c}_end") for c in ("first", "second")]
    return met.groupBy("key").agg(F.first("copies").alias("copies"), F.first("n").alias("n"), *at)


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """Per document: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output."""
    planned = plans(docs, rate, spm_rate, seed)
    none = F.lit(None).cast("long")
    whole = planned.where(F.col("form") == "plain").select("doc_id", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    rows = planned.where(F.col("form") != "plain").withColumn("key", row_key("doc_id", "text")).withColumn("__deal", F.monotonically_increasing_id())
    facts = materialize(offsets(planned, seed), "fim-offsets")
    cut = spread_join(rows, facts, ["key"], "copies", "__deal", "inner")
    a, b = F.col("first_end").cast("int"), F.col("second_end").cast("int")
    before, middle, after = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.char_length("text") - b)
    psm = F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).otherwise(spm)
    return whole.unionByName(cut.select("doc_id", "n", "form", F.col("first_end").alias("prefix_chars"), (F.col("second_end") - F.col("first_end")).alias("middle_chars"), output.alias("output")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Sentinels stand in it in a known order, and
    the parts hold none, so the first of each kind is the mark."""
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    at, end = F.position(second, output), F.position(F.lit(MIDDLE), output)
    one, two = F.substring(output, F.lit(4), at - 4), F.substring(output, at + 3, end - at - 3)
    last = F.substring(output, end + 3, F.char_length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, last, two)).otherwise(F.concat(two, last, one))


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` (form, output and others) with the text that each was made from."""
    return rows.withColumn("text", restored(F.col("output"), F.col("form")))


def digest(docs: DataFrame, **settings) -> DataFrame:
    """As ``transform``, with the SHA-256 of output and of the text rebuilt from it."""
    done = restore(transform(docs, **settings))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
