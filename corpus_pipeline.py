"""The corpus pipeline: five operators, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; stages but the last return the
columns of ``docs``. Between stages the rows are written as Parquet and read again, so a
lost executor costs no earlier stage.

Nulls in any column, empty texts, repeated rows and empty tables pass every stage by the rules of its
operator: a text without words, a null one too, is rejected by the quality rules; repeated rows are near copies, of which
one row stays; ties go to the least doc_id. Other columns go along as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from confab.llm import decontaminate, mixing, quality, simhash, token_binary
from confab.llm.common import documents, materialize, new_path, remove, scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are boilerplate of their host."""
    return quality.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each near-duplicate group.

    Shingles of four words, links at 4 differing bits or fewer, as in the operator's query.
    """
    return simhash.keep_one(docs, width=4, distance=4)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of weight."""
    return decontaminate.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each whole time that a document is taken, and one for each part of it."""
    return mixing.apply_mix(docs)


def as_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, and per document where its ids are in them."""
    return token_binary.token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("near_copies", without_near_copies), ("decontaminate", without_benchmarks), ("mix", mixed), ("tokens", as_token_files)]

#: Token ids have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own tables go when its rows are written, and its rows when
    the next stage's are, so the shared folder holds two stages at most, and the token files."""
    docs, held = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark, f"pipeline-{name}-scratch"):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if held:
            remove(spark, held)
        held = path
    # the last stage has written its files when it returns
    tokens = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, held)
    return tokens
