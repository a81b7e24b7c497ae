"""Quality classifier: learned hashed word, word bigram and character n-gram vectors, averaged per document, softmax output.

All features share one space of buckets.  The hash of a word bigram is that of
the difference of its words' hashes: bigrams of different words are told apart
and ordered, and those of one word twice all share a bucket, so that what is
learned of one repeated word holds for others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textcore as tc
from threadloom.llm.common import cut, fit_in_task, pick, table
from threadloom.llm.subword import BagModel, gram_buckets, padded, sigmoid, tokens

BITS, DIM, ORDERS = 18, 16, (3, 4)
#: Most labelled rows that are fetched to fit the model.
TRAIN_ROWS = 4000
EPOCHS, RATE, SEED = 4, 0.05, 7
_U = np.uint64


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """_id, _t (text) and _y (label) of at most ``rows`` labelled documents, half of them of the rarer class if it has as many, picked by a hash of the id among those of ``docs`` whose text isn't blank.

    An id with several labels has the greatest; one with several texts the least.
    """
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where(F.col("_t").rlike(r"\S"))
    lab = pick(labels, "doc_id", label).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    lab = cut(lab.join(texts.select("_id"), "_id", "left_semi"))
    some = lambda y, n: lab.where(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(n)
    chosen = some(0, rows // 2).unionByName(some(1, rows // 2))
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))


def training_rows(rows: list[dict]) -> list[tuple[str, int]]:
    """(text, label) in the order of the ids."""
    return [(r["_t"], r["_y"]) for r in sorted(rows, key=lambda r: r["_id"])]


def _features(arr: pa.Array):
    """Bucket arrays and their ranges per document: a pair for the words, one for their bigrams, one for each n-gram order."""
    b, seps = padded(arr, lower=False, words_only=False)
    s, e = tokens(b)
    word, first = tc.span_hashes(b, s, e), np.searchsorted(s, seps)
    yield (word >> _U(64 - BITS)).astype(np.int64), first
    second = np.ones(len(word), dtype=bool)
    second[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(second)
    yield (tc.mix(word[at] - word[at - 1]) >> _U(64 - BITS)).astype(np.int64), np.searchsorted(at, first)
    for pos, bucket in gram_buckets(b, ORDERS, BITS):
        yield bucket, np.searchsorted(pos, seps)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their shares, for each text (empty arrays without features)."""
    out = []
    for _, piece in tc.pieces(tc.as_text(pa.array(texts, type=pa.large_string()))):
        feats = list(_features(piece))
        for i in range(len(piece)):
            idx, n = np.unique(np.concatenate([f[r[i] : r[i + 1]] for f, r in feats]), return_counts=True)
            out.append((idx.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


class QualityModel:
    """``weights`` is None where there were no labelled rows of both classes."""

    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, arr: pa.Array) -> np.ndarray:
        """Probability of class 1; NaN for texts that are null or have no features, and without a model."""
        arr = tc.as_text(arr)
        out = np.full(len(arr), np.nan)
        if self.weights is None:
            return out
        for at, piece in tc.pieces(arr):
            total = np.zeros(len(piece))
            count = np.zeros(len(piece))
            for bucket, first in _features(piece):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket], dtype=np.float64)])
                total += sums[first[1:]] - sums[first[:-1]]
                count += np.diff(first)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[at : at + len(piece)] = np.where(count > 0, sigmoid(total / count + self.bias), np.nan)
        return out


def fit(rows: list[tuple[str, int]]) -> QualityModel:
    """Fit by stochastic gradient descent over shuffled rows; the classes have equal weight since each epoch repeats the rarer one. Without rows with features of both classes there is no model."""
    data = [(idx, x, y) for (idx, x), (_, y) in zip(bags([t for t, _ in rows]), rows) if len(idx)]
    if len({d[2] for d in data}) < 2:
        return QualityModel(None, 0.0)
    y = np.array([d[2] for d in data])
    rng = np.random.default_rng(SEED)
    model = BagModel(BITS, DIM, SEED)
    rare = int(y.mean() < 0.5)
    extra = np.flatnonzero(y == rare)
    short = len(y) - 2 * len(extra)
    steps = EPOCHS * max(len(y), 1)
    at = 0
    for _ in range(EPOCHS):
        order = rng.permutation(np.concatenate([np.arange(len(y)), rng.choice(extra, size=max(0, short))]) if len(extra) else np.arange(len(y)))
        for i in order:
            model.step(*data[i], RATE * max(0.05, 1 - at / (2 * steps)))
            at += 1
    return QualityModel(*model.folded())


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, quality_score (probability of good quality) and quality (1 if it is 0.5 or more) for every row of ``docs``.

    Null and blank texts, and every text where there was nothing to learn from (no
    labelled text of either class that isn't blank), get NULL in both columns.  A
    text of any length is read whole.  Repeated rows are scored alike; a null
    doc_id passes through; an empty table gives an empty one; other columns are
    ignored whatever their names, in any case.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array(shared.value.scores(text), from_pandas=True)
        tc.release()

    scored = pick(docs, "doc_id", "text").select("doc_id", score("text").alias("quality_score"))
    return scored.select("doc_id", "quality_score", F.when(F.col("quality_score") >= 0.5, 1).when(F.col("quality_score") < 0.5, 0).alias("quality"))


def fit_on(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return fit_in_task(labelled_sample(docs, labels, "quality", TRAIN_ROWS, SEED), lambda rows: fit(training_rows(rows)))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by a model fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_on(docs, table(spark, sf_dir, "labels")))
