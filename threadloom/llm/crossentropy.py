"""Language-model scoring by cross-entropy difference.

Two bigram models, one of the target documents (good quality, not toxic, by
``labels``) and one of the background (all documents), are matched: they share
one vocabulary, all words of the corpus and the boundary of a document, and one
smoothing, a Dirichlet prior on an add-one unigram model:

    P(w | v) = (n(v, w) + PRIOR * P(w)) / (n(v) + PRIOR)
    P(w)     = (n(w) + 1) / (N + V)

A document is scored by the counts of all *other* rows: its own are taken off
both models (off the target model if it is a target), since a model that has
read a document knows its rare words by heart.  The score is the mean over its
words and its end of loss(target) - loss(background): lower is more like the
target.

Words are never brought together on one machine.  The corpus is coded once, in
*runs* of about ``RUN_WORDS`` words: a run has its distinct words and their
sequence.  Each run sends the distinct words and bigrams that it has, with their
counts, to buckets by hash; a bucket adds up what all runs sent and returns the
totals in the order in which each run sent its keys, so that no key travels
back.  Then each run is joined with its totals and scored.  There are as many
buckets as keep each about as large as a run, and a frequent word or bigram is one
entry of each run, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textcore as tc
from threadloom.llm.common import broadcast_if_small, cut, drop_table, partitions, pick, run_size, table, write_table

#: What the unigram model weighs, in occurrences of a context.
PRIOR = 2.0
#: Words that are coded together, and words of the corpus for each bucket, at least (:func:`run_size`).
RUN_WORDS, BUCKET_WORDS = 1 << 20, 1 << 22
#: The hash of the boundary of a document.
BOUNDARY = 0
_U = np.uint64
_CODED = "run bigint, ids binary, known binary, target binary, sizes binary, words binary, places binary, n bigint, nt bigint"


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, without those that are zero throughout."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(x), width], dtype=np.int64).tobytes() + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, width = (int(v) for v in np.frombuffer(blob, dtype=np.int64, count=2))
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(blob[16:], n * width, asbytes=True), dtype=np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, whose upper bytes are mostly zero."""
    return np.diff(sorted_keys, prepend=_U(0))


def _coded(batches: Iterator[pa.RecordBatch], run_words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, target flag) rows to coded runs of about ``run_words`` words."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    ids, known, flags, sizes, hashes, held = [], [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        i, k, t, n = (np.concatenate(c) for c in (ids, known, flags, sizes))
        some = n > 0
        # The boundary before each document, and one after the last, make each document's end its successor's start.
        seq = np.insert(np.concatenate(hashes), np.append(np.cumsum(n[some]) - n[some], n.sum()), _U(BOUNDARY)) if some.any() else np.zeros(0, dtype=np.uint64)
        words, places = np.unique(seq, return_inverse=True)
        total, targets = int((n[some] + 1).sum()), int((n[some & t] + 1).sum())
        row = (part << 32 | made, i.tobytes(), k.tobytes(), t.tobytes(), pack(n), pack(_steps(words)), pack(places), total, targets)
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, [pa.int64()] + [pa.binary()] * 6 + [pa.int64()] * 2)], names=["run", "ids", "known", "target", "sizes", "words", "places", "n", "nt"])

    for batch in batches:
        doc_id = batch.column(0)
        there = doc_id.is_valid().to_numpy(zero_copy_only=False)
        doc_id = doc_id.fill_null(0).to_numpy()
        flag = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for at, piece in tc.pieces(tc.as_text(batch.column(1))):
            w = tc.Words(piece)
            here = slice(at, at + len(piece))
            ids.append(doc_id[here])
            known.append(there[here])
            flags.append(flag[here])
            sizes.append(np.diff(w.first))
            hashes.append(np.maximum(w.hashes, _U(1)))
            held += len(w.hashes) + len(piece)
            if held >= run_words:
                yield flush()
                made += 1
                ids, known, flags, sizes, hashes, held = [], [], [], [], [], 0
    if held:
        yield flush()


class Run:
    """A coded run: ``words`` (sorted), ``places`` (the sequence in them), ``doc`` (of each bigram), ``keys`` and ``gram`` (its distinct bigrams, sorted, and the place of each in them)."""

    def __init__(self, sizes: bytes, words: bytes, places: bytes, target: bytes):
        self.sizes = unpack(sizes).astype(np.int64)
        self.target = np.frombuffer(target, dtype=bool)
        self.words = np.cumsum(unpack(words), dtype=np.uint64)
        self.places = unpack(places).astype(np.int64)
        full = np.flatnonzero(self.sizes)
        self.full = full
        self.doc = np.repeat(np.arange(len(full)), self.sizes[full] + 1)
        h = self.words[self.places]
        self.keys, self.gram = np.unique(tc.mix(h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:]), return_inverse=True) if len(full) else (h, self.places)

    def counts(self, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each of ``n`` keys occurs in the run, and in its target documents."""
        return np.bincount(places, minlength=n), np.bincount(places[self.target[self.full][self.doc]], minlength=n)

    def own(self, places: np.ndarray, *asked: np.ndarray) -> list[np.ndarray]:
        """How often each of the ``asked`` keys occurs in its own document; ``places`` are the keys there."""
        code = (self.doc.astype(np.uint64) << _U(32)) | places.astype(np.uint64)
        keys, n = np.unique(code, return_counts=True)
        return [n[np.searchsorted(keys, (self.doc.astype(np.uint64) << _U(32)) | a.astype(np.uint64))] for a in asked]


def _sender(buckets: int):
    """Worker function: coded runs to a row for each bucket with any of the run's words or bigrams: these, with their counts in all and in target documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
        for batch in batches:
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ("run", "sizes", "words", "places", "target"))):
                r = Run(*row)
                if not len(r.full):
                    continue
                cuts = [np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]) for keys in (r.words, r.keys)]
                some = np.flatnonzero(np.diff(cuts[0]) + np.diff(cuts[1])).tolist()
                kinds = []
                for keys, places, at in ((r.words, r.places[:-1], cuts[0]), (r.keys, r.gram, cuts[1])):
                    both = r.counts(places, len(keys))
                    kinds.append([tuple(pack(x[at[b] : at[b + 1]] if k else _steps(x[at[b] : at[b + 1]])) for k, x in enumerate((keys, *both))) for b in some])
                rows = [(b, name, *w, *g) for b, w, g in zip(some, *kinds)]
                for lo in range(0, len(rows), 256):
                    cols = zip(*rows[lo : lo + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, [pa.int32(), pa.int64()] + [pa.binary()] * 6)], names=["bucket", "run", "wk", "wn", "wt", "gk", "gn", "gt"])

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the runs sent to a bucket to the totals, in the order in which each run sent its keys; ``kinds`` is the bucket's number of distinct words, in its first row."""
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in range(8)))]
    if not rows:
        return
    found, distinct = [], 0
    for first in (5, 2):  # bigrams, then words
        keys = [np.cumsum(unpack(r[first]), dtype=np.uint64) for r in rows]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        by = np.argsort(keys)
        new = np.flatnonzero(np.concatenate([[True], np.diff(keys[by]) != 0])) if len(keys) else np.zeros(0, dtype=np.int64)
        each = np.diff(np.append(new, len(keys)))
        distinct = len(new)
        del keys
        kinds = []
        for c in (first + 1, first + 2):
            n = np.concatenate([unpack(r[c]) for r in rows])[by]
            out = np.empty(len(n), dtype=np.uint64)
            out[by] = np.repeat(np.add.reduceat(n, new), each) if len(n) else n
            kinds.append([pack(x) for x in np.split(out, ends[:-1])])
        found.append(kinds)
    (gn, gt), (wn, wt) = found
    for i, r in enumerate(rows):
        cols = (r[0], r[1], wn[i], wt[i], gn[i], gt[i], 0 if i else distinct)
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(cols, [pa.int32(), pa.int64()] + [pa.binary()] * 4 + [pa.int64()])], names=["bucket", "run", "wn", "wt", "gn", "gt", "kinds"])


def _scorer(total: int, total_t: int, kinds: int):
    """Worker function: coded runs with their totals to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("sizes", "words", "places", "target", "ids", "known", "sent")
            for sizes, words, places, target, ids, known, sent in zip(*(batch.column(c).to_pylist() for c in names)):
                r = Run(sizes, words, places, target)
                ids, known = np.frombuffer(ids, dtype=np.int64), np.frombuffer(known, dtype=bool)
                mean = np.full(len(ids), np.nan)
                if total_t and len(r.full):
                    joined = {c: np.concatenate([unpack(s[c]) for s in sent]).astype(np.int64) for c in ("wn", "wt", "gn", "gt")}
                    v, w = r.places[:-1], r.places[1:]
                    own_v, own_w = r.own(v, v, w)
                    (own_g,) = r.own(r.gram, r.gram)
                    size, flag = (r.sizes[r.full] + 1)[r.doc], r.target[r.full][r.doc]

                    def log_p(g: np.ndarray, u: np.ndarray, n: int, mine) -> np.ndarray:
                        low = (u[w] - mine * own_w + 1) / (n - mine * size + kinds)
                        return np.log((g[r.gram] - mine * own_g + PRIOR * low) / (u[v] - mine * own_v + PRIOR))

                    diff = log_p(joined["gn"], joined["wn"], total, 1) - log_p(joined["gt"], joined["wt"], total_t, flag)
                    starts = np.cumsum(r.sizes[r.full] + 1) - r.sizes[r.full] - 1
                    mean[r.full] = np.add.reduceat(diff, starts) / (r.sizes[r.full] + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[known]), pa.array(r.sizes[known]), pa.array(mean[known], from_pandas=True)], names=["doc_id", "n_words", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words and score (mean loss difference; lower is more like the target) of every row with a doc_id.

    Null texts and texts without words have n_words 0 and a NULL score; without a
    target document every score is NULL.  Rows with a NULL doc_id are left out
    (their words are in the background counts).  A document is a target if any of
    its labels rows has quality 1 and none has toxic 1.  Repeated rows count as
    often as they occur: each is scored by the others, and all alike.  A text of
    any length is scored whole.  Empty tables give an empty result.  Other
    columns are ignored whatever their names, in any case.
    """
    spark = docs.sparkSession
    good = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"), F.max(F.coalesce("toxic", F.lit(0))).alias("_x")).where("_q = 1 and _x = 0")
    good = broadcast_if_small(cut(good.select("_id", F.lit(True).alias("_t"))), 24)
    flagged = pick(docs, "doc_id", "text").join(good, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.coalesce("_t", F.lit(False)).alias("target"))
    chars = flagged.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    run_words = run_size(RUN_WORDS, chars // 5)
    coded, coded_at = write_table(flagged.mapInArrow(tc.releasing(lambda batches: _coded(batches, run_words)), _CODED), "coded")
    sums = coded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("nt"), F.lit(0)).alias("nt")).first()
    buckets = max(partitions(spark), -(-sums["n"] // run_size(BUCKET_WORDS, sums["n"])))
    blobs = ", ".join(f"{c} binary" for c in ("wk", "wn", "wt", "gk", "gn", "gt"))
    sent = coded.select("run", "sizes", "words", "places", "target").mapInArrow(tc.releasing(_sender(buckets)), f"bucket int, run bigint, {blobs}")
    added = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(tc.releasing(_adder), "bucket int, run bigint, wn binary, wt binary, gn binary, gt binary, kinds bigint")
    totals, totals_at = write_table(added, "totals")
    kinds = totals.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("k")).first()["k"]
    by_run = totals.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("bucket", "wn", "wt", "gn", "gt"))).alias("sent"))
    scored = coded.join(by_run, "run", "left").select("sizes", "words", "places", "target", "ids", "known", F.coalesce("sent", F.array()).alias("sent"))
    result, _ = write_table(scored.mapInArrow(tc.releasing(_scorer(sums["n"], sums["nt"], kinds)), "doc_id bigint, n_words bigint, score double"), "scores")
    drop_table(spark, coded_at, totals_at)
    return result


def scoring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored against the good documents of ``labels``."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
