"""Pseudo-documents: successive messages in chunks of a target size, in closed form over window functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TARGET, LEAST, SEPARATOR = 30, 15, " [SEP] "


def absorbed(position: Column, n: Column, target: int = TARGET, least: int = LEAST) -> Column:
    """0-based chunk of the 0-based ``position`` among ``n``: a tail of fewer than ``least`` joins the chunk before it."""
    t = F.lit(target)
    whole = F.floor(n / t).cast("int")
    k = F.greatest(whole + (n % t >= least).cast("int"), F.lit(1))
    return F.least(F.floor(position / t).cast("int"), k - 1)


def assign(df: DataFrame, groups: list[str], order: list[str], target: int = TARGET, least: int = LEAST, name: str = "seq") -> DataFrame:
    """Tail-absorbing chunks within each group."""
    w = W.partitionBy(*groups)
    pos, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return df.withColumns({"_pos": pos, "_n": n}).withColumn(name, absorbed(F.col("_pos"), F.col("_n"), target, least)).drop("_pos", "_n")


def assign_pool(df: DataFrame, order: list[str], parts: str, target: int = TARGET, name: str = "seq") -> DataFrame:
    """Chunks over one global order, without absorption.

    The order isn't made in one task: ``parts`` is a column whose values follow
    the order (a day, say); rows are numbered within each part and the parts'
    offsets, one row a part, are added.
    """
    size = df.groupBy(parts).agg(F.count("*").alias("_c"))
    off = size.select(F.col(parts).alias("_part"), (F.sum("_c").over(W.orderBy(parts)) - F.col("_c")).alias("_off"))
    rows = df.withColumn("_pos", F.row_number().over(W.partitionBy(parts).orderBy(*order)) - 1)
    return rows.join(off, rows[parts].eqNullSafe(F.col("_part"))).withColumn(name, F.floor((F.col("_pos") + F.col("_off")) / target).cast("int")).drop("_pos", "_off", "_part")


def dominant(tickers: Column, targets: list[str]) -> Column:
    """The one target among a group's tickers (an aggregate over arrays), else MIXED."""
    found = F.array_intersect(F.flatten(F.collect_set(tickers)), F.array(*map(F.lit, targets)))
    return F.when(F.size(found) == 1, found[0]).otherwise("MIXED")


def build(df: DataFrame, keys: list[str], order: list[str], day: str, message: str, extra: list[Column] | None = None) -> DataFrame:
    """One row a chunk: first and last day, number of messages, and the messages in order."""
    text = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(message), F.lit("")).alias("_t")))), lambda x: x["_t"])
    return df.groupBy(*keys).agg(F.min(day).alias("date_start"), F.max(day).alias("date_end"), F.count("*").alias("n_messages"), F.array_join(text, SEPARATOR).alias("chunk_text"), *(extra or []))


def number(chunks: DataFrame, order: list[str], parts: list[Column], name: str = "chunk_id") -> DataFrame:
    """0-based numbers over chunk rows in ``order``, whose columns identify a row.

    ``parts`` are expressions that follow the order (a day, say).  Only the key
    columns are numbered, within each part; the parts' offsets are added, and the
    numbers joined back, so no task sees all keys, and none sorts texts.
    """
    keys = chunks.select(*[F.col(c).alias(f"_{c}") for c in order], F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).alias("_part"))
    size = keys.groupBy("_part").agg(F.count("*").alias("_c"))
    off = size.select(F.col("_part").alias("_of"), (F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).alias("_off"))
    keys = keys.withColumn("_pos", F.row_number().over(W.partitionBy("_part").orderBy(*[f"_{c}" for c in order])) - 1)
    keys = keys.join(off, F.col("_part").eqNullSafe(F.col("_of"))).withColumn(name, (F.col("_pos") + F.col("_off")).cast("int"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order])
    return chunks.join(keys.select(*[f"_{c}" for c in order], name), same).drop(*[f"_{c}" for c in order])


def training_chunks(df: DataFrame, thread: str, time: str, position: str, day: str, message: str, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """Long threads in chunks of their own, by the time they start; then the messages of short threads pooled by time, a tail below ``least`` dropped."""
    sized = df.withColumn("_size", F.count("*").over(W.partitionBy(thread)))
    long_rows = assign(sized.where(F.col("_size") >= least), [thread], [position], target, least)
    start = F.min(time).alias("_start")
    own = build(long_rows, [thread, "seq"], [position], day, message).join(long_rows.groupBy(thread).agg(start), thread).withColumn("_pool", F.lit(0))
    pool_rows = assign_pool(sized.where(F.col("_size") < least), [time, thread, position], day, target)
    pool = build(pool_rows, ["seq"], [time, thread, position], day, message).where(F.col("n_messages") >= least)
    pool = pool.select(F.lit(None).cast(df.schema[thread].dataType).alias(thread), *pool.columns, F.lit(None).cast(df.schema[time].dataType).alias("_start"), F.lit(1).alias("_pool"))
    # Pooled chunks have no start; their numbers follow the pool's order.
    parts = [F.col("_pool"), F.floor(F.col("_start").cast("bigint") / 86400), F.when(F.col("_pool") == 1, F.floor(F.col("seq") / 100_000))]
    return number(own.unionByName(pool), ["_pool", "_start", thread, "seq"], parts).select("chunk_id", "date_start", "date_end", "n_messages", "chunk_text")


def daily_chunks(df: DataFrame, stock: str, time: str, key: str, day: str, message: str, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """Chunks of each stock and day, none spanning two days and none dropped."""
    rows = assign(df, [stock, day], [time, key], target, least)
    out = build(rows, [stock, day, "seq"], [time, key], day, message)
    return number(out, [stock, day, "seq"], [F.col(stock), F.col(day)]).select("chunk_id", F.col(stock).alias("stock"), "date_start", "date_end", "n_messages", "chunk_text")


def spanning_days(chunks: DataFrame) -> DataFrame:
    """One row: chunks, and how many of them span days."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("date_start") != F.col("date_end")).alias("cross_day"))
