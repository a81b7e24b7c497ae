"""Threads: joins with their posts, chunks of messages, and folds along a thread."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators.cleaning import first_of

CHUNK_MESSAGES = 100


def join_posts(comments: DataFrame, posts: DataFrame, order: list[str]) -> DataFrame:
    """Comments with their post's ``submission_text`` (NULL without one); of posts with the same id the first counts."""
    context = first_of(posts, ["id"], order).select(F.col("id").alias("submission_id"), tx.submission_context(F.col("title"), F.col("body_text")).alias("submission_text"))
    return comments.join(context, "submission_id", "left")


def coverage(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, missing (NULL in ``column``) and the share that is there."""
    missing = F.count_if(F.col(column).isNull())
    return df.agg(F.count("*").alias("n_rows"), missing.alias("missing"), F.try_divide(F.count("*") - missing, F.count("*")).alias("coverage"))


def only_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Left semi join; Spark broadcasts ``keys`` where statistics say that they are small."""
    return df.join(keys.select(*on), on, "left_semi")


def not_done(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Left anti join: what remains to do."""
    return df.join(done.select(*on), on, "left_anti")


def with_chunk(df: DataFrame, position: str = "thread_position", size: int = CHUNK_MESSAGES, name: str = "chunk_id") -> DataFrame:
    """0-based chunk of each message, ``size`` successive positions each."""
    return df.withColumn(name, F.expr(f"cast(({position} - 1) div {size} as int)"))


def thread_chunks(df: DataFrame, thread: str, position: str, message: str, size: int = CHUNK_MESSAGES, context: str | None = None) -> DataFrame:
    """One row a chunk: its messages in order, each under a [MSG i] line, i from 1 in each chunk."""
    numbered = F.concat(F.lit("[MSG "), (F.expr(f"({position} - 1) % {size}") + 1).cast("string"), F.lit("]\n"), F.coalesce(F.col(message), F.lit("")))
    rows = with_chunk(df, position, size).withColumn("_line", F.struct(F.col(position).alias("p"), numbered.alias("t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["t"]), "\n\n")
    extra = [F.min_by(context, position).alias(context)] if context else []
    return rows.groupBy(thread, "chunk_id").agg(F.count("*").alias("n_messages_in_chunk"), joined.alias("chunk_comments"), *extra)


def multi_chunk(chunks: DataFrame, thread: str = "submission_id") -> DataFrame:
    """The chunks of threads that have more than one."""
    many = chunks.groupBy(thread).count().where("count > 1").select(thread)
    return chunks.join(many, thread, "left_semi")


def fold_threads(chunks: DataFrame, step: Callable[[str | None, pd.Series], str], thread: str = "submission_id", order: str = "chunk_id", name: str = "state") -> DataFrame:
    """Fold ``step`` (previous state, chunk row) -> state along each thread's chunks, for steps that only Python can take (models).

    A thread is one group: its chunks are taken in order, other threads in parallel.
    """
    schema = f"{chunks.select(thread, order)._jdf.schema().toDDL()}, `{name}` string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for _, row in rows.sort_values(order).iterrows():
            state = step(state, row)
            out.append((row[thread], row[order], state))
        return pd.DataFrame(out, columns=[thread, order, name])

    return chunks.groupBy(thread).applyInPandas(run, schema)


def summarize(chunks: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Chunk summaries by ``model`` (prompt -> answer), each told the summary before it; answers without a JSON object become "unclear" throughout."""
    def step(previous: str | None, row: pd.Series) -> str:
        before = f"\nSo far: {previous}" if previous else ""
        prompt = f"{tx.PROMPT}\nPost: {row.get('submission_text') or ''}{before}\nMessages:\n{row.get('chunk_comments') or ''}"
        return tx.last_json_object(model(prompt)) or "{}"

    folded = fold_threads(chunks, step)
    fields = {n: F.get_json_object("state", f"$.{n}") for n in tx.SUMMARY_FIELDS}
    s = folded.withColumn("_s", tx.normalized_summary(fields))
    s = s.select("submission_id", "chunk_id", F.col("_s.main_stock_or_company").alias("main_stock_or_company"), tx.summary_text(F.col("_s")).alias("LLM_summary"))
    return chunks.select("submission_id", "chunk_id", "n_messages_in_chunk").join(s, ["submission_id", "chunk_id"])
