"""Corpus pipeline: language identification, line dedup, near-duplicate documents, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillbar.llm import jaccard, language, lines, packing
from quillbar.llm.common import materialize, table
from quillbar.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without text or letters go. Where nothing is labelled,
    nothing is learned, and letters alone decide."""
    ship(spark)
    model = language.fit(docs, language.held_out())
    if not model["labels"]:
        return docs.where(language.has_letters("text"))
    found = language.predicted(docs, model)
    return found.where(found["lang_pred"] != language.UNKNOWN).select("whole.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; those that lose all their lines go."""
    return lines.without_removed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return jaccard.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the remaining documents and their places in training sequences."""
    ship(spark)
    return packing.packed_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("pack", pack)]
#: Language identification fits a model, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
