"""Sinks: tables, resumable appends, and small JSON reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from threadloom.operators.threads import not_done
from threadloom.schemas import project


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, by: list[str] | None = None) -> None:
    """Overwrite a Parquet table with the given columns in order, laid out by the columns ``by``."""
    out = project(df, columns) if columns else df
    w = out.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_delimited(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Overwrite a folder of CSV files with a header."""
    (project(df, columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_remaining(todo: DataFrame, path: str, keys: list[str], make) -> DataFrame:
    """Append ``make`` of the rows of ``todo`` whose keys aren't in the table at ``path`` yet; the whole table.

    Running it again after a failure does only what is left.
    """
    spark = todo.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        todo = not_done(todo, spark.read.parquet(path), keys)
    make(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_report(row: DataFrame | dict, path: str) -> dict:
    """A one-row table, or a dict, as a JSON file; the dict."""
    data = row if isinstance(row, dict) else (row.first() or {}) and row.first().asDict(recursive=True)
    Path(path).write_text(json.dumps(data, indent=2, default=str), encoding="utf-8")
    return data


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
