"""Stage schemas as DDL strings, and the contract check between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MATCHED = (
    "id string, created_utc bigint, date_utc string, source_type string, subreddit string, author string, score bigint, title string, body_text string, raw_text string, "
    "permalink string, link_id string, parent_id string, submission_id string, matched_tickers string, matched_terms string, match_sources string, match_count int, "
    "is_multi_match int, match_confidence string, needs_context_filter int"
)

SCHEMAS = {
    "raw_comment": "id string, link_id string, parent_id string, created_utc bigint, subreddit string, author string, body string, score bigint, permalink string",
    "raw_submission": "id string, created_utc bigint, subreddit string, author string, title string, selftext string, score bigint, permalink string",
    "matched": _MATCHED,
    "clean": f"{_MATCHED}, thread_position int",
    "merged": "id string, submission_id string, thread_position int, created_utc bigint, author string, score bigint, message_text string, submission_text string, matched_tickers string, match_count int, needs_context_filter int",
    "thread_chunk": "submission_id string, chunk_id int, n_messages_in_chunk int, submission_text string, chunk_comments string",
    "chunk_summary": "submission_id string, chunk_id int, n_messages_in_chunk int, main_stock_or_company string, LLM_summary string",
    "topic_chunk": "chunk_id int, stock string, date_start string, date_end string, n_messages int, chunk_text string",
    "topic_words": "topic_id int, rank int, word string, probability double",
    "bars": "symbol string, date date, open double, close double",
    "label": "id string, Relevance int",
}


class MissingColumns(ValueError):
    """A stage's input lacks columns that the stage needs."""


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def require(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """``df`` itself; raises :class:`MissingColumns` that names all that lack. ``columns`` may be a schema name."""
    wanted = struct(columns).names if isinstance(columns, str) else columns
    lacking = [c for c in wanted if c not in df.columns]
    if lacking:
        raise MissingColumns(f"missing columns: {', '.join(lacking)}")
    return df


def whole_number(c: Column, name: str) -> Column:
    """An integer; where it is NULL or can't be read as one, an error that names the column."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"{name} has a missing value")).cast("int")).otherwise(c.cast("int"))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of ``columns`` that exist, in that order."""
    return df.select(*[c for c in columns if c in df.columns])
