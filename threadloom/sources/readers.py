"""Sources: compressed object archives, delimited files, labels, bars, configuration."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.schemas import require, struct


def arrival(name: str = "_ord"):
    """The place of a row in its input, to be taken right at the scan: file, start of the piece of it, and place in that. Sorts as the files' lines stand."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place")).alias(name)


def _spread(df: DataFrame, parts: int | None) -> DataFrame:
    """Rows over ``parts`` partitions (the session's parallelism) where the scan has fewer."""
    parts = parts or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def read_objects(spark: SparkSession, path: str, kind: str, spread: int | None = None, order: str | None = None) -> DataFrame:
    """Newline-delimited JSON, compressed or not, malformed lines dropped.

    A compressed archive can't be split: where there are fewer pieces than
    ``spread`` (the session's parallelism) rows are spread right after the scan.
    ``order`` names a column with the place of each row in the input.
    """
    raw = spark.read.schema(struct(f"raw_{kind}")).option("mode", "DROPMALFORMED").json(path)
    return _spread(raw.select("*", arrival(order)) if order else raw, spread)


def read_long_window(spark: SparkSession, path: str, kind: str, spread: int | None = None, window: int = 1 << 31, strict: bool = False, order: str | None = None) -> DataFrame:
    """As :func:`read_objects` for zstd frames whose window the built-in codec refuses.

    Only the paths are listed by Spark.  Each file is read from its file system as
    a stream, a file a task, so its size doesn't matter; the lines are parsed by
    Spark.  Bytes that aren't UTF-8 are replaced, or raise an error if ``strict``.
    """
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", unquote(file)) if ":" in file else f"file://{file}")
                with fs.open_input_stream(at, compression=None) as source:
                    stream = zstandard.ZstdDecompressor(max_window_size=window).stream_reader(source, read_across_frames=True)
                    held, places, size = [], [], 0
                    for place, line in enumerate(io.TextIOWrapper(stream, encoding="utf-8", errors="strict" if strict else "replace", newline="\n")):
                        if line.strip():
                            held.append(line)
                            places.append(place)
                            size += len(line)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(places, pa.int64()), pa.array([file] * len(held))], names=["line", "place", "file"])
                            held, places, size = [], [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(places, pa.int64()), pa.array([file] * len(held))], names=["line", "place", "file"])

    paths = spark.read.format("binaryFile").load(path).select("path")
    files = [r["path"] for r in paths.collect()]
    each = spark.createDataFrame([(f,) for f in sorted(files)], "path string").repartition(max(1, len(files)), "path")
    text = _spread(each.mapInArrow(lines, "line string, place bigint, file string"), spread)
    parsed = text.select(F.from_json("line", T.StructType([*struct(f"raw_{kind}").fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("o"), F.struct("file", F.lit(0).cast("bigint").alias("start"), "place").alias("at"))
    parsed = parsed.where("o is not null and o._bad is null")
    return parsed.select("o.*", F.col("at").alias(order)).drop("_bad") if order else parsed.select("o.*").drop("_bad")


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None, skip_bad: bool = False, rows: int | None = None, line_breaks: bool = True) -> DataFrame:
    """CSV with a header, by a declared schema; ``rows`` takes the first ones as they stand in the files.

    Quoted values may hold line breaks, which keeps a file in one task; without
    ``line_breaks`` files are split.
    """
    s = struct(schema) if isinstance(schema, str) and schema.isidentifier() else schema
    df = spark.read.schema(s).option("header", True).option("multiLine", line_breaks).option("escape", '"').option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE").csv(path)
    if rows:
        df = df.select("*", arrival()).orderBy("_ord").limit(rows).drop("_ord")
    return df.select(*columns) if columns else df


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels made by people, from CSV or Parquet (spreadsheets have to be exported)."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_delimited(spark, path, "label")
    return require(df, ["id", "Relevance"]).where("id is not null")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars (symbol, date, open, close) from CSV or Parquet."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_delimited(spark, path, "bars")
    return require(df, "bars").select("symbol", "date", "open", "close")


def read_config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
