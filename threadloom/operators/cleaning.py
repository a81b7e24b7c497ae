"""Structural cleaning: rows are tagged with the first rule that removes them, so one pass gives both the rows and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of moderators and automatic accounts; "bot" matches within words.
AUTOMATIC_AUTHOR = r"(?iu)(?<![a-z])mod(?![a-z])|automoderator|visualmod|bot"
#: Words that stand for a missing value in the inputs' contract.
_NO_KEY = ("", "<na>", "nan", "none", "null")
RULES = ("missing_submission_id", "duplicate_id", "bot_mod", "composite_duplicate")


def key_is_missing(c: Column) -> Column:
    """NULL, blank, or one of the words that stand for a missing value."""
    return c.isNull() | F.lower(F.trim(c)).isin(*_NO_KEY)


def is_automatic(author: Column, pattern: str = AUTOMATIC_AUTHOR) -> Column:
    return F.coalesce(author.rlike(pattern), F.lit(False))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, in ``order``, of each combination of ``keys``; NULLs are equal."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def tag_removals(df: DataFrame, order: list[str], key: str = "id", thread: str = "submission_id", author: str = "author", time: str = "created_utc", body: str = "body_text", composite: bool = True) -> DataFrame:
    """``df`` with ``removed_by``: the first rule that removes a row, or NULL.

    The rules apply one after the other: a row that an earlier rule removed can't
    make a later row a duplicate. ``order`` is the order of arrival; it has to be total.
    """
    out = df.withColumn("removed_by", F.when(key_is_missing(F.col(thread)), RULES[0]))

    def duplicates(out: DataFrame, keys: list[str], rule: str) -> DataFrame:
        alive = F.col("removed_by").isNull()
        w = W.partitionBy(*keys, alive).orderBy(*order)
        return out.withColumn("_n", F.row_number().over(w)).withColumn("removed_by", F.when(alive & (F.col("_n") > 1), rule).otherwise(F.col("removed_by"))).drop("_n")

    out = duplicates(out, [key], RULES[1])
    out = out.withColumn("removed_by", F.coalesce("removed_by", F.when(is_automatic(F.col(author)), RULES[2])))
    return duplicates(out, [thread, time, body], RULES[3]) if composite else out


def standardized(df: DataFrame) -> DataFrame:
    """Trimmed ids and authors, numeric times, no NULL author or body."""
    return df.withColumns({
        "id": F.trim("id"), "submission_id": F.trim("submission_id"), "author": F.trim(F.coalesce("author", F.lit(""))),
        "created_utc": F.col("created_utc").try_cast("bigint"), "body_text": F.coalesce("body_text", F.lit("")),
    })


def with_thread_position(df: DataFrame, thread: str = "submission_id", time: str = "created_utc", key: str = "id", name: str = "thread_position") -> DataFrame:
    """1-based position in the thread by time, then id; rows without a time come last."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(thread).orderBy(F.col(time).asc_nulls_last(), key)))


def clean(df: DataFrame, order: list[str], composite: bool = True) -> DataFrame:
    """The rows that all rules leave, with ``thread_position``."""
    kept = tag_removals(standardized(df), order, composite=composite).where("removed_by is null").drop("removed_by")
    return with_thread_position(kept)


def report(tagged: DataFrame, thread: str = "submission_id", key: str = "id") -> DataFrame:
    """One row: rows in and out, removals by rule, distinct threads and ids left."""
    left = F.col("removed_by").isNull()
    by_rule = [F.count_if(F.col("removed_by") == r).alias(f"removed_{r}") for r in RULES]
    return tagged.agg(F.count("*").alias("input_rows"), F.count_if(left).alias("output_rows"), F.count_if(~left).alias("rows_removed_total"), *by_rule, F.count_distinct(F.when(left, F.col(thread))).alias("unique_threads"), F.count_distinct(F.when(left, F.col(key))).alias("unique_ids"))


def required_threads(df: DataFrame, thread: str = "submission_id") -> DataFrame:
    """Distinct thread keys that aren't blank, in order."""
    return df.select(F.trim(thread).alias(thread)).where(F.col(thread) != "").distinct().orderBy(thread)
