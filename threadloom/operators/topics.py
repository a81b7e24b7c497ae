"""Vocabulary, phrases, topic models and their coherence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IDF, CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector, SparseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NO_BELOW, NO_ABOVE, PASSES, SEED = 5, 0.35, 15, 42
BIGRAMS, TRIGRAMS = (30, 20.0), (20, 15.0)


def tokens(c: Column, stop: set[str] | None = None, least: int = 3) -> Column:
    """Alphabetic words of at least ``least`` letters in lower case, chunk separators and stop words left out."""
    # What isn't a letter separates words, so these are the runs of letters: one pattern over the text, once.
    run = r"\p{L}" * max(least, 1) + "+"
    found = F.regexp_extract_all(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("[SEP]"), F.lit(" "))), F.lit(run), F.lit(0))
    drop = sorted(set(StopWordsRemover.loadDefaultStopWords("english")) | (stop or set())) if stop is not None else []
    return F.filter(found, lambda w: ~w.isin(*drop)) if drop else found


def model_tokens(load: Callable[[], Callable[[list[str]], list[list[str]]]]) -> Callable[[Column], Column]:
    """A tokenizer from a model (lemmas, parts of speech): ``load`` runs once a worker, its result takes texts in batches."""
    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").str.replace("[SEP]", " ", regex=False).tolist()))

    return split


def document_frequency(docs: DataFrame, column: str = "tokens") -> DataFrame:
    """token and df."""
    return docs.select(F.explode(F.array_distinct(column)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def threshold_sweep(df: DataFrame, n_docs: int, no_below: list[int], no_above: float) -> DataFrame:
    """For each lower bound: tokens kept, dropped as too rare, dropped as too frequent. ``df`` has token and df."""
    high = F.col("df") > no_above * n_docs
    one = df.agg(*[x for k in no_below for x in (F.count_if((F.col("df") >= k) & ~high).alias(f"k{k}"), F.count_if(F.col("df") < k).alias(f"l{k}"), F.count_if((F.col("df") >= k) & high).alias(f"h{k}"))])
    rows = F.array(*[F.struct(F.lit(k).alias("no_below"), F.col(f"k{k}").alias("kept"), F.col(f"l{k}").alias("dropped_low"), F.col(f"h{k}").alias("dropped_high")) for k in no_below])
    return one.select(F.inline(rows))


#: Tokens that are counted together before anything is shuffled.
RUN = 1 << 22


def _bigram_runs(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Worker function: token lists to a row for each run and bucket of first words (by hash).

    ``words`` are those that the row's numbers stand for, ``pairs`` three int32 arrays (first word, second
    word, occurrences), ``own`` two (word of the bucket, occurrences).
    """

    def counted(lists: list[pa.Array]) -> pa.RecordBatch:
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode(null_encoding="encode")
        found, ids = coded.dictionary, coded.indices.to_numpy()
        home = (pd.util.hash_array(found.fill_null("").to_numpy(zero_copy_only=False), categorize=False) % buckets).astype(np.int64)
        order = np.argsort(home, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, size = place[ids], len(order)
        times = np.bincount(ids, minlength=size)
        lens = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists])
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(lens)[lens > 0] - 1] = False
        at = np.flatnonzero(inside)
        keys = ids[at] * size + ids[at + 1]
        keys.sort()
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.diff(starts, append=len(keys)).astype(np.int32)
        first, second = np.divmod(keys[starts], size)
        edges = np.searchsorted(home[order], np.arange(buckets + 1))
        cuts = np.searchsorted(first, edges)
        held, used, pairs, own = [], [], [], []
        for k in np.flatnonzero(np.diff(edges)):
            (i, j), (f, t) = edges[k : k + 2], cuts[k : k + 2]
            names, local = np.unique(np.concatenate([np.arange(i, j), second[f:t]]), return_inverse=True)
            local = local.astype(np.int32)
            held.append(k)
            used.append(names)
            pairs.append(local[first[f:t] - i].tobytes() + local[j - i :].tobytes() + n[f:t].tobytes())
            own.append(local[: j - i].tobytes() + times[i:j].astype(np.int32).tobytes())
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in used])]).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(offsets), found.take(pa.array(order[np.concatenate(used)])))
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), words, pa.array(pairs, pa.binary()), pa.array(own, pa.binary())], names=["bucket", "words", "pairs", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, n = [], 0
        for batch in batches:
            lists.append(batch.column(0))
            n += len(batch.column(0).flatten())
            if n >= RUN:
                yield counted(lists)
                lists, n = [], 0
        if n:
            yield counted(lists)

    return run


def _bucket(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and by their numbers: first and second of each distinct bigram, its occurrences; each word's own (0 of another bucket's)."""
    lists = rows.column("words").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    ids, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    before = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    keys, counts, times = [], [], np.zeros(size, np.int64)
    for at, pairs, own in zip(before, rows.column("pairs"), rows.column("own")):
        first, second, n = np.frombuffer(pairs.as_buffer(), np.int32).reshape(3, -1)
        keys.append(ids[at + first] * size + ids[at + second])
        counts.append(n)
        word, n = np.frombuffer(own.as_buffer(), np.int32).reshape(2, -1)
        times[ids[at + word]] += n
    keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    n = np.add.reduceat(counts[order], starts) if len(starts) else counts
    first, second = np.divmod(keys[starts], size)
    return coded.dictionary, first, second, n, times


def _bigram_buckets(docs: DataFrame, column: str):
    """Rows of runs, by bucket: bigrams are counted in numpy, so that what is shuffled is a row a run and bucket instead of one a bigram."""
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(column).mapInArrow(_bigram_runs(buckets), "bucket int, words array<string>, pairs binary, own binary").groupBy("bucket")


def bigram_counts(docs: DataFrame, column: str = "tokens", least: int = 1) -> DataFrame:
    """a, b and n over all documents, of bigrams seen at least ``least`` times."""

    def add(rows: pa.Table) -> pa.Table:
        words, first, second, n, _ = _bucket(rows)
        keep = n >= least
        return pa.table({"a": words.take(pa.array(first[keep])), "b": words.take(pa.array(second[keep])), "n": pa.array(n[keep])})

    return _bigram_buckets(docs, column).applyInArrow(add, "a string, b string, n bigint")


def phrase_scores(docs: DataFrame, min_count: int, column: str = "tokens") -> DataFrame:
    """a, b, n and score (n - min_count) * V / (n_a * n_b) of bigrams seen at least ``min_count`` times.

    Words (with no b) and bigrams are counted in one scan and one shuffle, which
    the number of words reuses; a bigram is counted where its first word is, and the
    second word's count reaches it by a window.
    """

    def add(rows: pa.Table) -> pa.Table:
        words, first, second, n, times = _bucket(rows)
        keep, own = n >= min_count, np.flatnonzero(times)
        if words.null_count:
            none = words.is_null().to_numpy(zero_copy_only=False)
            keep, own = keep & ~none[first] & ~none[second], own[~none[own]]
        first, second, n = first[keep], second[keep], n[keep]
        b = pa.concat_arrays([words.take(pa.array(second)), pa.nulls(len(own), pa.string())])
        return pa.table({"a": words.take(pa.array(np.concatenate([first, own]))), "b": b, "n": pa.array(np.concatenate([n, times[own]])), "ca": pa.array(np.concatenate([times[first], times[own]]))})

    counts = _bigram_buckets(docs, column).applyInArrow(add, "a string, b string, n bigint, ca bigint")
    size = counts.agg(F.count_if(F.col("b").isNull()).alias("v"))
    word = F.max(F.when(F.col("b").isNull(), F.col("n")))
    kept = counts.withColumn("_w", F.coalesce("b", "a")).withColumn("cb", word.over(W.partitionBy("_w"))).where("b is not null")
    return kept.crossJoin(F.broadcast(size)).select("a", "b", "n", ((F.col("n") - min_count).cast("double") * F.col("v") / F.col("ca") / F.col("cb")).alias("score"))


def bigram_sweep(docs: DataFrame, least: list[int], column: str = "tokens") -> DataFrame:
    """min_count, bigrams seen at least that often, and their occurrences, for each bound."""

    def add(rows: pa.Table) -> pa.Table:
        n = _bucket(rows)[3]
        return pa.table({"at": pa.array(range(len(least)), pa.int32()), "d": pa.array([int((n >= k).sum()) for k in least], pa.int64()), "o": pa.array([int(n[n >= k].sum()) for k in least], pa.int64())})

    got = _bigram_buckets(docs, column).applyInArrow(add, "at int, d bigint, o bigint")
    sums = lambda c, i: F.coalesce(F.sum(F.when(F.col("at") == i, F.col(c))), F.lit(0).cast("bigint"))
    one = got.agg(*[x for i in range(len(least)) for x in (sums("d", i).alias(f"d{i}"), sums("o", i).alias(f"o{i}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("min_count"), F.col(f"d{i}").alias("bigrams"), F.col(f"o{i}").alias("occurrences")) for i, k in enumerate(least)])))


def phrases(docs: DataFrame, min_count: int, threshold: float, column: str = "tokens") -> list[str]:
    """Joined pairs whose score is above ``threshold``; few, since each has to be seen often."""
    got = phrase_scores(docs, min_count, column).where(F.col("score") > threshold).select(F.concat_ws(" ", "a", "b").alias("p")).collect()
    return sorted(r["p"] for r in got)


def join_phrases(docs: DataFrame, found: list[str], column: str = "tokens") -> DataFrame:
    """Join the pairs in ``found`` by an underscore, greedily from the left.

    A walk along the tokens in Arrow batches, linear in them; the phrases are
    broadcast once.
    """
    if not found:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(found))

    def walk(words: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(words):
            if i + 1 < len(words) and f"{words[i]} {words[i + 1]}" in shared.value:
                out.append(f"{words[i]}_{words[i + 1]}")
                i += 2
            else:
                out.append(words[i])
                i += 1
        return out

    @F.arrow_udf("array<string>")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([None if x is None else walk(x) for x in lists.to_pylist()], pa.list_(pa.string()))

    return docs.withColumn(column, joined(column))


def with_phrases(docs: DataFrame, column: str = "tokens") -> DataFrame:
    """Bigrams, then trigrams."""
    two = join_phrases(docs, phrases(docs, *BIGRAMS, column), column)
    return join_phrases(two, phrases(two, *TRIGRAMS, column), column)


def vocabulary(docs: DataFrame, column: str = "tokens", no_below: int = NO_BELOW, no_above: float = NO_ABOVE) -> CountVectorizerModel:
    """All tokens in ``no_below`` documents or more and in no more than the share ``no_above`` of them, the most widespread first."""
    df = document_frequency(docs, column).where(F.col("df") >= no_below)
    if no_above < 1:
        df = df.where(F.col("df") <= no_above * docs.count())
    found = df.orderBy(F.desc("df"), "token").select("token").toArrow().column(0).to_pylist()
    if not found:
        raise ValueError(f"no token is in {no_below} documents or more and in no more than the share {no_above} of them")
    return CountVectorizerModel.from_vocabulary(found, inputCol=column, outputCol="bow")


def save_corpus(bow: DataFrame, vocab: CountVectorizerModel, path: str) -> None:
    """Counts and vocabulary under one folder."""
    vocab.write().overwrite().save(f"{path}/vocabulary")
    bow.write.mode("overwrite").parquet(f"{path}/bow")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, CountVectorizerModel]:
    """What :func:`save_corpus` wrote; an error if any of it is missing."""
    return spark.read.parquet(f"{path}/bow"), CountVectorizerModel.load(f"{path}/vocabulary")


def expand_bow(bow: DataFrame, words: list[str], column: str = "bow") -> DataFrame:
    """Tokens back from counts, in vocabulary order; only the terms that a row has are spelled out."""
    shared = bow.sparkSession.sparkContext.broadcast(list(words))

    @F.udf("array<string>")
    def spell(v):
        if v is None:
            return None
        counts = zip(v.indices, v.values) if isinstance(v, SparseVector) else enumerate(v)
        return [w for i, n in counts for w in [shared.value[i]] * int(n)]

    return bow.withColumn("tokens", spell(column))


def tfidf(bow: DataFrame, column: str = "bow") -> DataFrame:
    return IDF(inputCol=column, outputCol="tfidf").fit(bow).transform(bow)


def asymmetric_prior(k: int) -> list[float]:
    """Proportional to 1 / (i + sqrt(k)), adding up to 1."""
    raw = [1 / (i + math.sqrt(k)) for i in range(k)]
    return [x / sum(raw) for x in raw]


def _digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: six steps of the recurrence, then the asymptotic series."""
    x = np.array(x, dtype=np.float64)
    low = np.zeros_like(x)
    for _ in range(6):
        low += 1 / x
        x += 1
    f = 1 / (x * x)
    return np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132))))) - low


def _trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, dtype=np.float64)
    low = np.zeros_like(x)
    for _ in range(6):
        low += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * (5 / 66))))) + low


def _expected_log(x: np.ndarray) -> np.ndarray:
    """Expected logarithms under Dirichlet distributions, one a row."""
    return _digamma(x) - _digamma(x.sum(axis=1))[:, None]


#: Rounds after which steps aren't lengthened, so that no document can go round in circles.
_LENGTHENED = 200


def _infer(weights: list[np.ndarray], counts: np.ndarray, lens: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> None:
    """Each document's topic distribution, in place, until a step changes it by 0.001 or less on average; those that are done leave.

    ``weights`` has an array a topic, of its terms' weights in the order of the documents' terms. The steps alone
    converge in a thousand rounds and more, so of two each round goes on along the way that they lead
    (squared extrapolation, in logarithms of what terms add to the prior); the last step is a plain one.
    """
    here, rounds = np.arange(len(lens)), 0
    while len(here):
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])

        def step(g: np.ndarray) -> np.ndarray:
            theta = np.exp(_expected_log(g))
            ratio = _ratio(weights, counts, lens, theta)
            return np.stack([np.add.reduceat(w * ratio, starts) for w in weights], axis=1) * theta + alpha

        before = gamma[here]
        one = step(before)
        two = step(one)
        going = np.abs(two - one).mean(axis=1) > 1e-3
        gamma[here], rounds = two, rounds + 1
        if rounds < _LENGTHENED and going.any():
            x, y, z = (np.log(np.maximum(g - alpha, 1e-30)) for g in (before, one, two))
            r = y - x
            v = z - y - r
            a = np.maximum(1, np.sqrt((r * r).sum(axis=1) / np.maximum((v * v).sum(axis=1), 1e-300)))[:, None]
            far = np.exp(z + np.clip(x + 2 * a * r + a * a * v - z, -3, 3)) + alpha
            gamma[here[going]] = far[going]
        if going.sum() <= 0.8 * len(here):
            terms = np.repeat(going, lens)
            weights, counts, lens, here = [w[terms] for w in weights], counts[terms], lens[going], here[going]


def _ratio(weights: list[np.ndarray], counts: np.ndarray, lens: np.ndarray, theta: np.ndarray) -> np.ndarray:
    total = np.full(len(counts), 1e-100)
    for k, w in enumerate(weights):
        total += w * np.repeat(theta[:, k], lens)
    return counts / total


#: Terms that are worked on at once, so that what an iteration reads stays in the processor's cache.
_TERMS = 1 << 17


def _expectation(word_weights: np.ndarray, alpha: np.ndarray, seed: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Worker function: documents' terms and counts to sums, a row for each ``block`` of terms and, numbered -1, one of the documents.

    ``word_weights`` (broadcast) has a row a topic, of all terms' weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = word_weights.value
        k, size = beta.shape
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums, logs, n = np.zeros((k, size)), np.zeros(k), 0
        for batch in batches:
            ids, counts, lens = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), np.diff(batch.column(0).offsets.to_numpy()).astype(np.int64)
            if not len(lens):
                continue
            ends, shares, first, at = np.cumsum(lens), np.empty((k, len(ids))), 0, 0
            while first < len(lens):
                last = max(first + 1, int(np.searchsorted(ends, at + _TERMS, "right")))
                to = int(ends[last - 1])
                some, c = [np.ascontiguousarray(b[ids[at:to]]) for b in beta], counts[at:to]
                gamma = rng.gamma(100, 1 / 100, (last - first, k))
                _infer(some, c, lens[first:last], alpha, gamma)
                log = _expected_log(gamma)
                logs += log.sum(axis=0)
                theta = np.exp(log)
                ratio = _ratio(some, c, lens[first:last], theta)
                for i in range(k):
                    shares[i, at:to] = np.repeat(theta[:, i], lens[first:last]) * ratio
                first, at = last, to
            for i in range(k):
                sums[i] += np.bincount(ids, shares[i], size)
            n += len(lens)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.append(logs, n).tobytes()], pa.binary())], names=["block", "sums"])
            for i in range(0, size, block):
                yield pa.RecordBatch.from_arrays([pa.array([i // block], pa.int32()), pa.array([sums[:, i : i + block].tobytes()], pa.binary())], names=["block", "sums"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in rows.column("sums"))
    return pa.table({"block": rows.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _moved(alpha: np.ndarray, logs: np.ndarray, n: float, rate: float) -> np.ndarray:
    """The documents' prior after a Newton step; as it was where that would leave the positive numbers. ``logs``: mean expected logarithms."""
    gradient = n * (logs - _digamma(alpha) + _digamma(alpha.sum()))
    c, q = n * _trigamma(alpha.sum()), -n * _trigamma(alpha)
    step = (gradient - (gradient / q).sum() / (1 / c + (1 / q).sum())) / -q
    return alpha + rate * step if (alpha + rate * step > 0).all() else alpha


def train(bow: DataFrame, k: int, passes: int = PASSES, seed: int = SEED, column: str = "bow") -> LDAModel:
    """Online variational Bayes as MLlib has it (its priors, rates and tolerance), with each document once in each pass.

    Documents are inferred many at a time in Arrow batches instead of one by one, and sums over terms
    come back by blocks of terms, from few tasks. The rows are read once a pass, so keep them persisted.
    """
    spark, sc = bow.sparkSession, bow.sparkSession.sparkContext
    v = F.unwrap_udt(column)
    docs = bow.select(v.alias("v")).where(F.size("v.values") > 0).select(F.coalesce("v.indices", F.sequence(F.lit(0), F.size("v.values") - 1)).alias("ids"), F.col("v.values").alias("counts")).coalesce(3 * sc.defaultParallelism)
    first = bow.where(F.col(column).isNotNull()).select(v["size"].alias("n"), F.size(v["values"]).alias("m")).first()
    if first is None:
        raise ValueError("no documents to train on")
    size, block = first["n"] if first["n"] is not None else first["m"], max(1, (1 << 16) // k)
    alpha, eta, rng = np.array(asymmetric_prior(k)), 1 / k, np.random.default_rng(seed)
    topics_ = rng.gamma(100, 1 / 100, (k, size))
    for done in range(1, passes + 1):
        weights = np.exp(_expected_log(topics_))
        shared = sc.broadcast(weights)
        rows = docs.mapInArrow(_expectation(shared, alpha, seed * 1000 + done, block), "block int, sums binary").groupBy("block").applyInArrow(_added, "block int, sums binary").toArrow()
        shared.destroy()
        found = dict(zip(rows.column("block").to_pylist(), map(np.frombuffer, rows.column("sums").to_pylist())))
        if not found:
            continue
        *logs, n = found.pop(-1)
        rate = (1024 + done) ** -0.51
        stats = np.concatenate([found[i].reshape(k, -1) for i in sorted(found)], axis=1) * weights
        topics_ = (1 - rate) * topics_ + rate * (stats + eta)
        alpha = _moved(alpha, np.array(logs) / n, n, rate)
    jvm = sc._jvm
    matrix = jvm.org.apache.spark.mllib.linalg.Matrices.fromML(_py2java(sc, DenseMatrix(size, k, topics_.ravel())))
    prior = jvm.org.apache.spark.mllib.linalg.Vectors.fromML(_py2java(sc, DenseVector(alpha)))
    local = jvm.org.apache.spark.mllib.clustering.LocalLDAModel(matrix, prior, float(eta), 100.0)
    lda = LDA(k=k, maxIter=passes, optimizer="online", seed=seed, featuresCol=column, docConcentration=asymmetric_prior(k), subsamplingRate=1.0)
    model = lda._copyValues(LocalLDAModel(jvm.org.apache.spark.ml.clustering.LocalLDAModel(lda.uid, size, local, spark._jsparkSession)))
    model._transfer_params_to_java()
    return model


def topic_words(model: LDAModel, words: list[str], top: int = 20) -> DataFrame:
    """topic_id, rank (from 1), word and probability."""
    rows = [(r["topic"], n, words[i], w) for r in model.describeTopics(top).collect() for n, (i, w) in enumerate(zip(r["termIndices"], r["termWeights"]), 1)]
    t = SparkSession.getActiveSession().createDataFrame(rows, "topic_id int, rank int, word string, probability double")
    return t.withColumn("probability", F.round("probability", 6))


def topic_panel(model: LDAModel, bow: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and topic_0 .. topic_(K-1), to 6 decimals."""
    theta = model.transform(bow).withColumn("_a", vector_to_array("topicDistribution"))
    return theta.select(*keep, *[F.round(F.col("_a")[i], 6).alias(f"topic_{i}") for i in range(model.getK())])


def perplexity(model: LDAModel, bow: DataFrame) -> tuple[float, float]:
    """Log perplexity (lower is better) and its exponential."""
    p = model.logPerplexity(bow)
    return p, math.exp(p)


def diversity(words: DataFrame, top: int) -> DataFrame:
    """One row: distinct words among the topics' ``top`` first, over their number, to 4 decimals. ``words`` has topic_id, rank, word."""
    t = words.where(F.col("rank") <= top)
    return t.agg(F.round(F.count_distinct("word") / (F.count_distinct("topic_id") * top), 4).alias("diversity"))


def overlapping(words: DataFrame, top: int) -> DataFrame:
    """word and topics, for words among the ``top`` first of several topics."""
    return words.where(F.col("rank") <= top).groupBy("word").agg(F.count_distinct("topic_id").alias("topics")).where("topics > 1")


def _occurrence(docs: DataFrame, words: DataFrame, column: str) -> DataFrame:
    """ws: each document's words of interest, distinct and sorted. Topics' words are few, so they go into the plan and nothing is shuffled."""
    wanted = F.array(*[F.lit(r["word"]) for r in words.select("word").distinct().orderBy("word").collect()])
    return docs.select(F.array_sort(F.array_intersect(column, wanted)).alias("ws")).where(F.size("ws") > 0)


def co_documents(docs: DataFrame, words: DataFrame, column: str = "tokens") -> DataFrame:
    """a <= b and n (documents that hold both; a = b: that hold it), for the words of topics."""
    occ = _occurrence(docs, words, column)
    pairs = occ.select(F.explode("ws").alias("a"), "ws").select("a", F.explode("ws").alias("b")).where("a <= b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def _topic_pairs(words: DataFrame, co: DataFrame, top: int) -> DataFrame:
    """For each topic and i > j: n_j, n_i and n_ij."""
    t = words.where(F.col("rank") <= top)
    i, j = t.select("topic_id", F.col("rank").alias("i"), F.col("word").alias("wi")), t.select("topic_id", F.col("rank").alias("j"), F.col("word").alias("wj"))
    p = i.join(j, "topic_id").where("i > j").withColumns({"a": F.least("wi", "wj"), "b": F.greatest("wi", "wj")})
    single = co.where("a = b")
    p = p.join(F.broadcast(co), ["a", "b"], "left")
    p = p.join(F.broadcast(single.select(F.col("a").alias("wi"), F.col("n").alias("ni"))), "wi", "left").join(F.broadcast(single.select(F.col("a").alias("wj"), F.col("n").alias("nj"))), "wj", "left")
    return p.select("topic_id", "i", "j", "wi", "wj", F.coalesce("n", F.lit(0)).alias("nij"), F.coalesce("ni", F.lit(0)).alias("ni"), F.coalesce("nj", F.lit(0)).alias("nj"))


def umass(docs: DataFrame, words: DataFrame, top: int = 20, column: str = "tokens") -> DataFrame:
    """topic_id and coherence: mean over pairs of ln((D(wi, wj) + 1) / D(wj)), wj ranking first."""
    p = _topic_pairs(words, co_documents(docs, words, column), top).where("nj > 0")
    return p.groupBy("topic_id").agg(F.avg(F.log((F.col("nij") + 1) / F.col("nj"))).alias("coherence"))


def windows(docs: DataFrame, size: int, column: str = "tokens") -> DataFrame:
    """One row a sliding window of ``size`` tokens (a shorter document is one window)."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(column) - size + 1))
    return docs.where(F.size(column) > 0).select(F.explode(F.transform(starts, lambda s: F.slice(column, s, size))).alias("tokens"))


def window_counts(docs: DataFrame, words: DataFrame, size: int, column: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(a <= b and n: sliding windows that hold both words of topics; one row with the number of all windows).

    Windows aren't made: a word at place p is in those that start at p - size + 1
    to p. Between the ends of such stretches the words held stay the same, so flags
    over the stretches, with their lengths, give the counts, many documents at a
    time. One pass gives counts and total, which are few and returned as local rows.
    """
    spark = docs.sparkSession
    names = [r["word"] for r in words.select("word").distinct().orderBy("word").collect()]
    most = min(max((1 << 15) // max(len(names), 1), 128), 8192)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sums, total = pa.array(names, pa.string()), np.zeros((len(names), len(names)), dtype=np.int64), 0
        for batch in batches:
            lists = batch.column(0)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            starts = np.where(lens > 0, np.maximum(1, lens - size + 1), 0)
            total += int(starts.sum())
            ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=wanted), -1).to_numpy()
            at = np.flatnonzero(ids >= 0)
            ids, doc = ids[at], np.searchsorted(np.cumsum(lens), at, "right")
            place, before = at - (np.cumsum(lens) - lens)[doc], (np.cumsum(starts) - starts)[doc]
            low, high = before + np.maximum(place - size + 1, 0), before + np.minimum(place + 1, starts[doc])
            i = 0
            while i < len(ids):
                to = int(np.searchsorted(doc, doc[min(i + most, len(ids)) - 1], "right"))
                here, word = np.unique(ids[i:to], return_inverse=True)
                points, end = np.unique(np.concatenate([low[i:to], high[i:to]]), return_inverse=True)
                edges = np.zeros((len(here), len(points)), dtype=np.int32)
                np.add.at(edges, (word, end[: to - i]), 1)
                np.add.at(edges, (word, end[to - i :]), -1)
                held = (np.cumsum(edges, axis=1)[:, :-1] > 0).astype(np.float64)
                sums[np.ix_(here, here)] += np.rint((held * np.diff(points)) @ held.T).astype(np.int64)
                i = to
        i, j = np.nonzero(np.triu(sums))
        yield pa.RecordBatch.from_arrays([pa.array([*(names[k] for k in i), None], pa.string()), pa.array([*(names[k] for k in j), None], pa.string()), pa.array(np.append(sums[i, j], total))], names=["a", "b", "n"])

    rows = docs.select(column).mapInArrow(count, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    counts = spark.createDataFrame([r for r in rows if r["a"] is not None], "a string, b string, n bigint")
    return counts, spark.createDataFrame([(sum(r["n"] for r in rows if r["a"] is None),)], "n_win bigint")


def npmi_pairs(docs: DataFrame, words: DataFrame, top: int = 20, size: int = 10, column: str = "tokens", eps: float = 1e-12) -> DataFrame:
    """For each topic and pair of its words: normalised pointwise mutual information over sliding windows."""
    co, total = window_counts(docs, words, size, column)
    p = _topic_pairs(words, co, top).crossJoin(F.broadcast(total))
    pij = F.col("nij") / F.col("n_win") + eps
    pmi = F.log(pij / ((F.col("ni") / F.col("n_win")) * (F.col("nj") / F.col("n_win"))))
    return p.where("ni > 0 and nj > 0").select("topic_id", "i", "j", "wi", "wj", (pmi / -F.log(pij)).alias("npmi"))


def npmi(docs: DataFrame, words: DataFrame, top: int = 20, size: int = 10) -> DataFrame:
    return npmi_pairs(docs, words, top, size).groupBy("topic_id").agg(F.avg("npmi").alias("coherence"))


def c_v(docs: DataFrame, words: DataFrame, top: int = 20, size: int = 110) -> DataFrame:
    """topic_id and coherence: mean cosine between each word's vector of NPMI with the topic's words and the sum of all such vectors."""
    half = npmi_pairs(docs, words, top, size)
    full = half.select("topic_id", F.col("wi").alias("w"), F.col("wj").alias("x"), "npmi").unionByName(half.select("topic_id", F.col("wj").alias("w"), F.col("wi").alias("x"), "npmi"))
    own = full.select("topic_id", "w").distinct().select("topic_id", "w", F.col("w").alias("x"), F.lit(1.0).alias("npmi"))
    full = full.unionByName(own)
    total = full.groupBy("topic_id", "x").agg(F.sum("npmi").alias("s"))
    each = full.join(total, ["topic_id", "x"]).groupBy("topic_id", "w").agg(F.sum(F.col("npmi") * F.col("s")).alias("dot"), F.sqrt(F.sum(F.col("npmi") ** 2)).alias("a"), F.sqrt(F.sum(F.col("s") ** 2)).alias("b"))
    return each.groupBy("topic_id").agg(F.avg(F.try_divide("dot", F.col("a") * F.col("b"))).alias("coherence"))


def search_k(bow: DataFrame, docs: DataFrame, vocab: list[str], ks: list[int], passes: int = 5, top: int = 20) -> list[dict]:
    """A row of scores for each number of topics; ``bow`` should be cached by the caller."""
    out = []
    for k in ks:
        words = topic_words(train(bow, k, passes), vocab, top).persist()
        mean = lambda d: d.agg(F.avg("coherence")).first()[0]
        out.append({"K": k, "coherence_umass": mean(umass(docs, words, top)), "coherence_cv": mean(c_v(docs, words, top)), "coherence_npmi": mean(npmi(docs, words, top)), "topic_diversity": diversity(words, top).first()[0]})
        words.unpersist()
    return out


def best_k(rows: DataFrame, score: str = "coherence_cv") -> DataFrame:
    return rows.agg(F.max_by("K", score).alias("K"))


def ranked(df: DataFrame, group: str, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order``, with their rank from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(name) <= k)


def by_stock(panel: DataFrame, k: int, stock: str = "stock") -> DataFrame:
    """Mean and sample deviation of each topic's share, by stock."""
    return panel.groupBy(stock).agg(*[x for i in range(k) for x in (F.avg(f"topic_{i}").alias(f"mean_{i}"), F.stddev_samp(f"topic_{i}").alias(f"std_{i}"))])


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """bin (1 to ``bins``; 0 and bins + 1 outside) and n."""
    return df.groupBy(F.expr(f"width_bucket(cast({column} as double), {low}, {high}, {bins})").alias("bin")).agg(F.count("*").alias("n"))


def dominant_topic(panel: DataFrame, k: int) -> DataFrame:
    """``panel`` with dominant_topic, the first of the greatest."""
    a = F.array(*[F.col(f"topic_{i}") for i in range(k)])
    return panel.withColumn("dominant_topic", (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def dominant_by_stock(panel: DataFrame, k: int, stock: str = "stock") -> DataFrame:
    """How many chunks of each stock have each topic as their greatest."""
    return dominant_topic(panel, k).groupBy(stock, "dominant_topic").agg(F.count("*").alias("n"))


def of_stock(panel: DataFrame, name: str, stock: str = "stock") -> DataFrame:
    """The rows of one stock."""
    return panel.where(F.col(stock) == name)


def label_template(words: DataFrame, top: int = 10) -> DataFrame:
    """One row with a JSON text: for each topic an empty name and its first words, for people to fill in."""
    one = words.where(F.col("rank") <= top).groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("w"))
    entry = F.struct(F.lit("").alias("name"), F.col("w").alias("top_words"))
    return one.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("topic_"), "topic_id").alias("k"), entry.alias("v")))))).alias("template"))


def named(df: DataFrame, names: DataFrame, topic: str = "topic_id") -> DataFrame:
    """``df`` with topic_name: "name - topic N" from ``names`` (topic_id, name), else topic_N."""
    n = names.select(F.col("topic_id").alias("_t"), F.nullif(F.trim("name"), F.lit("")).alias("_name"))
    label = F.coalesce(F.concat("_name", F.lit(" - topic "), F.col(topic).cast("string")), F.concat(F.lit("topic_"), F.col(topic).cast("string")))
    return df.join(n, F.col(topic) == F.col("_t"), "left").withColumn("topic_name", label).drop("_t", "_name")


def name_second(df: DataFrame, name: str = "topic_name") -> DataFrame:
    """``df`` with the column ``name`` in second place."""
    first, *rest = [c for c in df.columns if c != name]
    return df.select(first, name, *rest)
