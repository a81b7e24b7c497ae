"""Relevance labels: pre-filters, a pluggable scorer, and the label rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as tx

MIN_WORDS = 5
BOT_COMMAND = r"(?iU)^\s*!(?:ban|banbet|bet|remind|remindme)\b"
AT_LEAST_RELEVANT, AT_LEAST_NOT = 0.75, 0.5


def is_bot_command(c: Column) -> Column:
    return F.coalesce(c.rlike(BOT_COMMAND), F.lit(False))


def is_skipped(message: Column, min_words: int = MIN_WORDS) -> Column:
    """Too short to judge, or a command."""
    return (tx.word_count(message) < min_words) | is_bot_command(message)


def label(relevant: Column, not_relevant: Column) -> Column:
    """1, -1, or 0 for the uncertain."""
    return F.when((relevant >= AT_LEAST_RELEVANT) & (relevant >= not_relevant), 1).when(not_relevant >= AT_LEAST_NOT, -1).otherwise(0)


def confidence(relevant: Column, not_relevant: Column) -> Column:
    """The score that the label rests on, the greater one of uncertain rows."""
    lab = label(relevant, not_relevant)
    return F.when(lab == 1, relevant).when(lab == -1, not_relevant).otherwise(F.greatest(relevant, not_relevant))


def relevant(df: DataFrame, label: str = "predicted_relevance") -> DataFrame:
    """The rows that are predicted relevant."""
    return df.where(F.col(label) == 1)


def lexical_scorer(finance_words: list[str]) -> Callable[[Column], Column]:
    """A deterministic stand-in for a model: the relevant score grows with the share of words that are in the list."""
    listed = F.array(*[F.lit(w) for w in sorted(finance_words)])

    def score(text: Column) -> Column:
        w = tx.words(F.lower(text))
        hits = F.size(F.filter(w, lambda x: F.array_contains(listed, x)))
        return F.when(F.size(w) == 0, 0.0).otherwise(F.least(F.lit(1.0), hits.cast("double") * 10 / F.size(w)))

    return score


def model_scorer(load: Callable[[], Callable[[list[str]], list[float]]]) -> Callable[[Column], Column]:
    """A scorer from a model: ``load`` runs once a worker, its result takes texts in batches."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.tolist()), dtype="float64")

    return score


def predict(df: DataFrame, scorer: Callable[[Column], Column], message: str = "message_text", summary: str = "LLM_summary", post: str = "submission_text") -> DataFrame:
    """``df`` with predicted_relevance and relevance_confidence; skipped rows get -1 and 0.0 and never reach the scorer."""
    rows = df.withColumn("_skip", is_skipped(F.col(message)))
    text = tx.context_input(F.col(message), F.col(summary), F.col(post))
    judged = rows.where(~F.col("_skip")).withColumn("_r", scorer(text)).withColumn("_n", 1 - F.col("_r"))
    judged = judged.withColumns({"predicted_relevance": label(F.col("_r"), F.col("_n")), "relevance_confidence": F.round(confidence(F.col("_r"), F.col("_n")), 4)}).drop("_r", "_n")
    skipped = rows.where("_skip").withColumns({"predicted_relevance": F.lit(-1), "relevance_confidence": F.lit(0.0)})
    return judged.unionByName(skipped).drop("_skip")
