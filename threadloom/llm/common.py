"""Session helpers of the operators: tables, checked broadcasts, shared checkpoints."""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textcore as tc

#: Most bytes that any operator broadcasts; a larger side is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of a batch of rows that goes to a Python worker (a longer row is a batch by itself).
BATCH_BYTES = 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Keep batches to Python workers near ``BATCH_BYTES`` unless the session has set a bound of its own."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(columns: list[str], name: str) -> int:
    """Where ``name`` stands: the first column spelled so, else the first that differs in case only."""
    if name in columns:
        return columns.index(name)
    low = [c.lower() for c in columns]
    if name.lower() in low:
        return low.index(name.lower())
    raise ValueError(f"no column {name!r} among {columns}")


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """``df`` with columns renamed by place, and a function from an old name to the new column: no other column's name can clash, in any case."""
    old = df.columns
    return df.toDF(*(f"__loom_{i}" for i in range(len(old)))), lambda name: F.col(f"__loom_{_place(old, name)}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, also where others have names that differ in case only."""
    plain, col = numbered(df)
    return plain.select(*(col(n).alias(n) for n in names))


def keep(df: DataFrame, condition: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """The rows of ``df``, all columns, that meet a condition on columns taken by name."""
    plain, col = numbered(df)
    return plain.where(condition(col)).toDF(*df.columns)


def without(df: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df``, all columns, whose ``name`` isn't in the only column of ``gone``."""
    plain, col = numbered(df)
    return plain.join(gone.toDF("__loom_gone"), col(name) == F.col("__loom_gone"), "left_anti").toDF(*df.columns)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where none is named, local mode gets a temporary folder; on a cluster it is
    an error, since only the cluster knows which folder its machines share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        if not named and not alone:
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="threadloom-"))
    return sc.getCheckpointDir()


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared checkpoint folder; the table read again, and its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Delete what :func:`write_table` wrote, once it is consumed."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast when ``rows`` (counted when not given) stay under :data:`BROADCAST_BYTES`."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def fit_in_task(sample: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """``fit`` of the rows of ``sample`` (a bounded sample, brought together in one task) in an executor; what it returns is pickled back.

    The driver holds neither the texts nor the features, and a lost executor costs a retry.
    """
    bound_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(tc.releasing(run), "model binary").first()
    return pickle.loads(got["model"]) if got else fit([])


def run_size(least: int, total: int) -> int:
    """Entries that a run collects before it sends them to buckets: ``least``, or as many as leave 64 of them for each bucket of that size where there are ``total``.

    Rows of fewer would cost more in overhead than in content.  So a task's memory
    grows with the root of the input: 32 million entries for the 16 trillion words
    of 100 TB.
    """
    return max(least, math.isqrt(64 * total))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
