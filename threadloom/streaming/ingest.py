"""Structured Streaming: the batch expressions over new archive files, exactly-once ids, and summaries carried across batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.functions.lexicon import Lexicon
from threadloom.operators.matching import extract_rows
from threadloom.schemas import struct


def new_objects(spark: SparkSession, folder: str, kind: str = "comment", files_at_once: int = 1) -> DataFrame:
    """Raw objects of the files that appear in ``folder``; malformed lines are dropped."""
    return spark.readStream.schema(struct(f"raw_{kind}")).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_at_once).json(folder)


def extract_stream(raw: DataFrame, kind: str, lexicon: Lexicon, community: str, start: str, end: str) -> DataFrame:
    """The batch extraction, unchanged: it keeps no state."""
    return extract_rows(raw, kind, lexicon, community, start, end)


def once_by_id(rows: DataFrame, delay: str = "1 day", key: str = "id", epoch: str = "created_utc") -> DataFrame:
    """The first row of each id within a watermark of ``delay``."""
    return rows.withColumn("event_time", F.timestamp_seconds(epoch)).withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def daily_counts(rows: DataFrame, delay: str = "1 day", epoch: str = "created_utc") -> DataFrame:
    """Rows by day and matched entities, late rows up to ``delay``."""
    return rows.withColumn("event_time", F.timestamp_seconds(epoch)).withWatermark("event_time", delay).groupBy(F.window("event_time", "1 day"), "matched_tickers").agg(F.count("*").alias("n"))


def fold_stream(chunks: DataFrame, step: Callable[[str | None, pd.Series], str], thread: str = "submission_id", order: str = "chunk_id") -> DataFrame:
    """Fold ``step`` along each thread across batches; the state of a thread is its last result."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for _, row in rows.iterrows():
            last = step(last, row)
            out.append((key[0], int(row[order]), last))
        state.update((last,))
        yield pd.DataFrame(out, columns=[thread, order, "state"])

    return chunks.groupBy(thread).applyInPandasWithState(run, f"{thread} string, {order} int, state string", "state string", "append", GroupStateTimeout.NoTimeout)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet, each input once; ``once`` takes what is there and stops."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
