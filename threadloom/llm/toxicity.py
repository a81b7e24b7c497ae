"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (with its two
boundaries) and of the whole word, so a misspelling shares most of its vectors
with the word it stands for.  A bag of words is the average of its words, and a
linear softmax of the average is its verdict; vectors and softmax are learned
together by stochastic gradient descent.

With ``window`` 0 the bag is the document.  The average of a long document
drowns a few words in it, so by default a bag is a window of ``WINDOW``
successive words, and a document is as toxic as its most toxic window.  Training
then alternates between choosing each labelled document's highest window under
the present model and gradient steps on the windows chosen, some of them
misspelt at random with their label kept.  The README compares the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textcore as tc
from threadloom.llm.common import fit_in_task, keep, pick, table
from threadloom.llm.quality import labelled_sample, training_rows
from threadloom.llm.subword import BagModel, gram_buckets, padded, sigmoid, tokens

BITS, DIM, ORDERS, WINDOW = 18, 16, (3, 4, 5), 2
#: Most labelled rows that are fetched to fit the model, half of them toxic.
TRAIN_ROWS = 4000
ROUNDS, RATE, SEED, HELD_OUT = 8, 0.2, 11, 5
#: Share of the chosen windows that are also learned in a form with one letter of each word dropped, doubled, changed or swapped.
MISSPELT = 0.2


def word_features(arr: pa.Array):
    """Each document's range of words; for each feature kind, buckets and each word's range of them."""
    b, seps = padded(arr, lower=True, words_only=True)
    s, e = tokens(b)
    kinds = [((tc.span_hashes(b, s, e) >> np.uint64(64 - BITS)).astype(np.int64), np.arange(len(s) + 1))]
    edges = np.append(s - 1, len(b))
    kinds += [(bucket, np.searchsorted(pos, edges)) for pos, bucket in gram_buckets(b, ORDERS, BITS)]
    return np.searchsorted(s, seps), kinds


def word_scores(kinds, weights: np.ndarray) -> np.ndarray:
    n = len(kinds[0][1]) - 1
    total, count = np.zeros(n), np.zeros(n)
    for bucket, first in kinds:
        sums = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
        total += sums[first[1:]] - sums[first[:-1]]
        count += np.diff(first)
    return total / np.maximum(count, 1)


def window_means(score: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """For each word the mean over it and the words after it in the same document, ``window`` in all (0: as many as the document has, from its start on); a window may be shorter at the end."""
    n = len(score)
    size = np.diff(first)
    at = np.arange(n) if window else np.repeat(first[:-1], size)
    stop = np.repeat(first[1:], size)
    if window:
        stop = np.minimum(at + window, stop)
    sums = np.concatenate([[0.0], np.cumsum(score)])
    return (sums[stop] - sums[at]) / np.maximum(1, stop - at)


class ToxicityModel:
    """``weights`` is None where there were no labelled rows of both classes."""

    def __init__(self, weights: np.ndarray | None, bias: float, threshold: float, window: int = WINDOW):
        self.weights, self.bias, self.threshold, self.window = weights, bias, threshold, window

    def scores(self, arr: pa.Array) -> np.ndarray:
        """Probability of the most toxic window; NaN for texts without words and without a model."""
        arr = tc.as_text(arr)
        out = np.full(len(arr), np.nan)
        if self.weights is None:
            return out
        for at, piece in tc.pieces(arr):
            first, kinds = word_features(piece)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                means = window_means(word_scores(kinds, self.weights), first, self.window)
                out[at + full] = sigmoid(np.maximum.reduceat(means, first[full]) + self.bias)
        return out


class _Words:
    """The features of each word of a training document."""

    def __init__(self, text: str):
        arr = tc.as_text(pa.array([text], type=pa.large_string()))
        self.first, kinds = word_features(arr)
        self.kinds = [(bucket.astype(np.int32), first.astype(np.int32)) for bucket, first in kinds]
        self.n = int(self.first[-1])
        b, _ = padded(arr, lower=True, words_only=True)
        self.bytes, self.spans = b.tobytes(), tokens(b)

    def misspelt(self, at: int, stop: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """The bag of a window with one change in each word of four letters or more."""
        out = []
        for s, e in zip(*(x[at:stop] for x in self.spans)):
            w = self.bytes[s:e].decode(errors="ignore")
            if len(w) > 3:
                i = int(rng.integers(len(w) - 1))
                w = (w[:i] + w[i + 1 :], w[: i + 1] + w[i:], w[:i] + chr(97 + int(rng.integers(26))) + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :])[int(rng.integers(4))]
            out.append(w)
        new = _Words(" ".join(out))
        return new.bag(0, new.n)

    def bag(self, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        idx, x = [], []
        for w in range(at, min(stop, self.n)):
            own = np.concatenate([f[r[w] : r[w + 1]] for f, r in self.kinds])
            idx.append(own)
            x.append(np.full(len(own), 1 / len(own)))
        keys, back = np.unique(np.concatenate(idx), return_inverse=True)
        share = np.bincount(back, weights=np.concatenate(x))
        return keys, (share / share.sum()).astype(np.float32)


def fit(rows: list[tuple[str, int]], window: int = WINDOW) -> ToxicityModel:
    """Fit on four rows of five; the threshold is the one that separates the fifth best (F1; the middle of the gap where there is one).

    Without rows with words of both classes there is no model.
    """
    docs = [(_Words(t), y) for t, y in rows]
    docs = [d for d in docs if d[0].n]
    if len({y for _, y in docs}) < 2:
        return ToxicityModel(None, 0.0, 0.5, window)
    held = [d for i, d in enumerate(docs) if i % HELD_OUT == 0]
    used = [d for i, d in enumerate(docs) if i % HELD_OUT]
    if len({y for _, y in used}) < 2:
        held, used = docs, docs
    model, rng = BagModel(BITS, DIM, SEED), np.random.default_rng(SEED)
    if not window:
        for r in range(ROUNDS):
            for k in rng.permutation(len(used)):
                w, label = used[k]
                model.step(*w.bag(0, w.n), label, RATE * (1 - 0.8 * r / ROUNDS))
        weights, bias = model.folded()
        best = [(float(window_means(word_scores(w.kinds, weights), w.first, 0)[0]) + bias, label) for w, label in held]
        return ToxicityModel(weights, bias, float(sigmoid(_cut(best))), window)
    # Start from the words whose document frequency differs most between the classes, so that the first windows chosen are telling ones.
    y = np.array([d[1] for d in used])
    start = np.zeros(1 << BITS)
    for w, label in used:
        seen = np.unique(np.concatenate([k[0] for k in w.kinds]))
        start[seen] += 1 / max(1, (y == 1).sum()) if label else -1 / max(1, (y == 0).sum())
    weights, bias = start, 0.0
    for r in range(ROUNDS):
        chosen = []
        for w, label in used:
            means = window_means(word_scores(w.kinds, weights), w.first, window)
            at = int(means.argmax())
            chosen.append((w, at, label))
            if not label:
                chosen.append((w, int(rng.integers(w.n)), 0))
        for k in rng.permutation(len(chosen)):
            w, at, label = chosen[k]
            rate = RATE * (1 - 0.8 * r / ROUNDS)
            model.step(*w.bag(at, at + window), label, rate)
            if rng.random() < MISSPELT:
                model.step(*w.misspelt(at, at + window, rng), label, rate)
        weights, bias = model.folded()
    best = [(float(window_means(word_scores(w.kinds, weights), w.first, window).max()) + bias, label) for w, label in held]
    return ToxicityModel(weights, bias, float(sigmoid(_cut(best))), window)


def _cut(scored: list[tuple[float, int]]) -> float:
    """The logit between two neighbouring scores at which F1 is highest (the widest gap among equals)."""
    scored = sorted(scored)
    z, y = np.array([s for s, _ in scored]), np.array([v for _, v in scored])
    if not y.any():
        return 0.0
    hit = y[::-1].cumsum()[::-1]
    f1 = 2 * hit / (np.arange(len(y), 0, -1) + y.sum())
    gap = np.diff(z, prepend=z[0] - 1)
    k = max(range(len(y)), key=lambda i: (f1[i], gap[i]))
    return float(z[k] - gap[k] / 2)


def _verdicts(model: ToxicityModel, docs: DataFrame):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array(shared.value.scores(text), from_pandas=True)
        tc.release()

    return score


def classify(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, toxicity (probability of the most toxic window) and toxic (1 from the fitted threshold on) for every row of ``docs``.

    Null texts, texts without words, and every text where there was nothing to
    learn from (no labelled text with words of either class), get NULL in both
    columns.  A text of any length is read whole.  Repeated rows are scored alike;
    a null doc_id passes through; an empty table gives an empty one; other columns
    are ignored whatever their names, in any case.
    """
    scored = pick(docs, "doc_id", "text").select("doc_id", _verdicts(model, docs)("text").alias("toxicity"))
    return scored.select("doc_id", "toxicity", F.when(F.col("toxicity") >= model.threshold, 1).when(F.col("toxicity") < model.threshold, 0).alias("toxic"))


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't find toxic; a text without a verdict stays, and all rows where there was nothing to learn from."""
    if model.weights is None:
        return docs
    return keep(docs, lambda col: F.coalesce(_verdicts(model, docs)(col("text")), F.lit(-1.0)) < model.threshold)


def fit_on(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit_in_task(labelled_sample(docs, labels, "toxic", TRAIN_ROWS, SEED), lambda rows: fit(training_rows(rows)))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by a model fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_on(docs, table(spark, sf_dir, "labels")))
