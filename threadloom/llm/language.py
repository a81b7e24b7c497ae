"""Language ID by error-correcting output codes.

Each language has a codeword of bits; one binary logistic classifier over hashed
byte n-grams predicts each bit; loss-weighted decoding adds up, for each
codeword, the logistic losses of its bits, and the codeword with the least loss
is the answer.  A text whose two nearest codewords are too close, or that has no
letters, is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textcore as tc
from threadloom.llm.common import fit_in_task, keep, pick, table
from threadloom.llm.subword import gram_buckets, padded

BITS, ORDERS = 12, (2, 3)
#: Most rows with a declared language that are fetched to fit the bit classifiers, for each language.
TRAIN_ROWS_EACH = 800
#: The ambiguity margin is a quarter of this quantile of the margins of correctly decoded held-out rows.
AMBIGUOUS_SHARE = 0.002
STEPS, RATE, DECAY, SEED = 150, 0.05, 1e-5, 5
_DOCS_AT_ONCE = 512


def codewords(k: int) -> np.ndarray:
    """k codewords of +1/-1: all distinct splits up to 7 languages (exhaustive code), else the best spread of 64 seeded random codes of 10 log2(k) bits."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        bits = [b for b in itertools.product((1, -1), repeat=k) if b[0] == 1 and -1 in b]
        return np.array(bits).T.astype(float)
    rng = np.random.default_rng(SEED)
    tries = [rng.choice([-1.0, 1.0], size=(k, int(np.ceil(10 * np.log2(k))))) for _ in range(64)]
    near = lambda m: (m @ m.T - 1e9 * np.eye(k)).max()
    return min(tries, key=near)


def profiles(arr: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, matrix of documents by n-gram buckets, rows of length 1; 0 where a text has no n-grams)."""
    for at, piece in tc.pieces(arr):
        for lo in range(0, len(piece), _DOCS_AT_ONCE):
            part = piece.slice(lo, _DOCS_AT_ONCE)
            b, seps = padded(part, lower=True, words_only=True)
            flat = np.zeros(len(part) << BITS)
            for pos, bucket in gram_buckets(b, ORDERS, BITS):
                doc = np.searchsorted(seps, pos, side="right") - 1
                flat += np.bincount((np.maximum(doc, 0) << BITS) + bucket, minlength=len(flat))
            x = np.sqrt(flat.reshape(len(part), -1).astype(np.float32))
            yield at + lo, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class LanguageModel:
    """``names`` is empty where no row had a declared language."""

    def __init__(self, names: list[str], codes: np.ndarray, W: np.ndarray, c: np.ndarray, margin: float = 0.0):
        self.names, self.codes, self.W, self.c, self.margin = names, codes, W, c, margin

    def decode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword (-1: no n-grams), its mean bit loss, and how much farther the next codeword is."""
        arr = tc.as_text(arr)
        best, loss, gap = np.full(len(arr), -1), np.full(len(arr), np.nan), np.full(len(arr), np.nan)
        if not self.names:
            return best, loss, gap
        for at, x in profiles(arr):
            f = x @ self.W + self.c
            each = np.logaddexp(0, -f[:, None, :] * self.codes[None]).mean(axis=2)
            some = np.flatnonzero(x.any(axis=1))
            order = np.argsort(each[some], axis=1, kind="stable")
            best[at + some] = order[:, 0]
            loss[at + some] = each[some, order[:, 0]]
            gap[at + some] = each[some, order[:, 1]] - each[some, order[:, 0]] if len(self.names) > 1 else np.inf
        return best, loss, gap


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """Fit all bit classifiers together on four rows of five by full-batch gradient steps; the fifth sets the ambiguity margin."""
    names = sorted({lang for _, lang in rows})
    codes = codewords(len(names))
    if not names:
        return LanguageModel([], codes, np.zeros((1 << BITS, 1)), np.zeros(1))
    arr = tc.as_text(pa.array([t for t, _ in rows], type=pa.large_string()))
    x = np.concatenate([m for _, m in profiles(arr)])
    y = np.array([names.index(lang) for _, lang in rows])
    held = np.arange(len(y)) % 5 == 4
    if held.all() or not held.any():
        held[:] = False
    X, Y = x[~held], codes[y[~held]].astype(np.float32)
    W, c = np.zeros((x.shape[1], codes.shape[1]), dtype=np.float32), np.zeros(codes.shape[1], dtype=np.float32)
    m, v = np.zeros_like(W), np.zeros_like(W)
    for t in range(1, STEPS + 1):
        f = X @ W + c
        g = -Y / (1 + np.exp(Y * f))
        dW = X.T @ g / len(X) + DECAY * W
        m, v = 0.9 * m + 0.1 * dW, 0.999 * v + 0.001 * dW * dW
        W -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        c -= RATE * g.mean(axis=0)
    model = LanguageModel(names, codes, W, c)
    test = held if held.any() else ~held
    best, _, gap = model.decode(arr.filter(pa.array(test)))
    right = gap[(best == y[test]) & np.isfinite(gap)]
    model.margin = float(np.quantile(right, AMBIGUOUS_SHARE) / 4) if len(right) else 0.0
    return model


def fit_on(docs: DataFrame) -> LanguageModel:
    """Fit on at most ``TRAIN_ROWS_EACH`` rows of each declared language, those with the least hashes of their id; an id with several texts or languages has the least.

    One scan counts the rows of each language; one more takes those whose hash is
    under a bound at which some more than are needed are expected, whatever the
    number of languages.
    """
    rows = pick(docs, "doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    hashed = F.xxhash64("doc_id", F.lit(SEED))
    share = {lang: min(1.0, (1.2 * TRAIN_ROWS_EACH + 100) / n) for lang, n in counts.items()}
    bounds = docs.sparkSession.createDataFrame([(lang, min((1 << 63) - 1, int(x * (1 << 64)) - (1 << 63))) for lang, x in sorted(share.items())], "lang string, bound bigint")
    sample = rows.join(F.broadcast(bounds), "lang").where(hashed <= F.col("bound")).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("s"), F.first(hashed).alias("h")).select("doc_id", "h", "s.text", "s.lang")
    return fit_in_task(sample, _fit_sample)


def _fit_sample(rows: list[dict]) -> LanguageModel:
    """Fit on the rows with the least hashes of each language, in the order of their ids."""
    by_lang: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"])):
        by_lang.setdefault(r["lang"], []).append(r)
    chosen = sorted((r for own in by_lang.values() for r in own[:TRAIN_ROWS_EACH]), key=lambda r: r["doc_id"])
    return fit([(r["text"], r["lang"]) for r in chosen])


def _verdict(docs: DataFrame, model: LanguageModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<language string, loss double, margin double, ambiguous boolean>"

    @F.arrow_udf(kind)
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for text in batches:
            best, loss, gap = m.decode(text)
            lang = pa.array([m.names[i] if i >= 0 else None for i in best], type=pa.string())
            unsure = (best < 0) | (gap < m.margin)
            yield pa.StructArray.from_arrays([lang, pa.array(loss, from_pandas=True), pa.array(gap, from_pandas=True), pa.array(unsure)], names=["language", "loss", "margin", "ambiguous"])
        tc.release()

    return decide


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, language (nearest codeword), loss, margin to the next codeword, and ambiguous, for every row of ``docs``.

    Null texts and texts without letters or digits get a NULL language, loss and
    margin and are ambiguous; so is every text if no row had a declared language.
    A text of any length is read whole.  Repeated rows are decided alike; ties go
    to the first language by name, with margin 0; a null doc_id passes through; an
    empty table gives an empty one; other columns are ignored whatever their
    names, in any case.
    """
    return pick(docs, "doc_id", "text").select("doc_id", _verdict(docs, model)("text").alias("v")).select("doc_id", "v.language", "v.loss", "v.margin", "v.ambiguous")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not ambiguous: not those with a null, empty or letterless text. All rows stay where there was nothing to learn from."""
    if not model.names:
        return docs
    return keep(docs, lambda col: ~_verdict(docs, model)(col("text"))["ambiguous"])


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by a model fitted on the declared languages of a bounded sample."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_on(docs))
