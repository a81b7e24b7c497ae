"""The corpus pipeline: documents to a training mixture, in five stages.

Each stage takes all that the one before it kept and returns the columns of
documents; the last adds ``copies``.  ``run`` writes each stage's result as
Parquet in the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontaminate, jaccard, language, mixing, toxicity
from threadloom.llm.common import drop_table, table, write_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the classifier is fitted on the declared languages of ``docs``.

    Null, empty and letterless texts go; where no row has a declared language all rows stay.
    Repeated rows share their fate; a NULL doc_id is no reason to go; texts of any length are read whole.
    """
    return language.keep_known(docs, language.fit_on(docs))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; the classifier is fitted on those of ``labels`` that are in ``docs``.

    Texts without words stay, and all rows where ``labels`` is empty or lacks texts of either class.
    Repeated rows share their fate; a NULL doc_id is no reason to go; texts of any length are read whole.
    """
    return toxicity.keep_clean(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies.

    Rows with a NULL doc_id or without words stay; a repeated doc_id is one document, all of whose rows stay or go.
    """
    return jaccard.keep_one(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows with a NULL doc_id or text stay, and all rows where ``benchmark`` is empty; ties of tiles don't change the verdict.
    """
    return decontaminate.keep_unleaked(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources, with the number of copies of each document.

    A NULL source is a source of its own; rows with a NULL doc_id go; ties go to the smaller doc_id; of repeated rows of
    one doc_id each has the document's copies.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_copies),
    ("decontamination", remove_leaks),
    ("source_mixing", mix_sources),
]

#: The classifiers of the first two stages can't be put in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. Of the tables written between stages only the last, which the result reads, is left."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_table(stage(spark, docs, sf_dir), name)
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
