"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``MIN_MATCH`` words that a document shares with a benchmark
item.  For each document and item with a seed in common, the longest common run
of words that isn't marked yet is found by running Karp-Rabin (rolling hashes of
all runs of one length, the greatest length with a match found by bisection,
since a match of a length implies one of each smaller length), marked as a tile,
and so on until no run of ``MIN_MATCH`` words is left.  Tiles don't overlap and
may stand in any order, so reordered passages are caught.  A document is
contaminated by an item if the tiles cover at least ``COVERAGE`` of its words.
An item of fewer than ``MIN_MATCH`` words has no seed; it contaminates a document
that consists of just its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm import textcore as tc
from threadloom.llm.common import BROADCAST_BYTES, broadcast_if_small, cut, pick, table, without

MIN_MATCH, COVERAGE = 4, 0.5
_U = np.uint64
_SCHEMA = "doc_id bigint, item_id bigint, matched int, item_words int, coverage double"


def _runs(tokens: np.ndarray, marked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes of the runs of ``k`` unmarked tokens."""
    if len(tokens) < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = tc._power_tables(len(tokens) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(tokens * up[: len(tokens)])])
    marks = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(marks[k:] == marks[:-k])
    return at, (sums[at + k] - sums[at]) * down[at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (position in item, position in doc, length), longest first; ties by position in the item, then in the document."""
    in_doc, in_item = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    found: list[tuple[int, int, int]] = []

    def matches(k: int):
        i, hi = _runs(item, in_item, k)
        j, hj = _runs(doc, in_doc, k)
        both = np.intersect1d(hi, hj)
        if not len(both):
            return None
        a, b = np.isin(hi, both), np.isin(hj, both)
        return i[a], hi[a], j[b], hj[b]

    most = min(len(doc), len(item))
    while most >= least and matches(least) is not None:
        low, high = least, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if matches(mid) is not None else (low, mid - 1)
        i, hi, j, hj = matches(low)
        where: dict[int, list[int]] = {}
        for pos, h in zip(j.tolist(), hj.tolist()):
            where.setdefault(h, []).append(pos)
        progress = False
        for pos, h in zip(i.tolist(), hi.tolist()):
            if in_item[pos : pos + low].any():
                continue
            for at in where[h]:
                if not in_doc[at : at + low].any() and np.array_equal(item[pos : pos + low], doc[at : at + low]):
                    in_item[pos : pos + low] = in_doc[at : at + low] = True
                    found.append((pos, at, low))
                    progress = True
                    break
        most = low if progress else low - 1
    return found


class Benchmark:
    """Items' words, and which seed hashes stand in which items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.items = [], []
        for _, piece in tc.pieces(tc.as_text(pa.array(texts, type=pa.large_string()))):
            w = tc.Words(piece)
            self.items += [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.ids = list(ids)
        seeds = [np.unique(tc.shingle_hashes(t, MIN_MATCH)) for t in self.items]
        h = np.concatenate(seeds) if seeds else np.zeros(0, dtype=np.uint64)
        at = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]).astype(np.int64)
        by = np.argsort(h, kind="stable")
        self.seeds, self.seed_item = h[by], at[by]
        self.seen = bitmap(self.seeds)


def bitmap(seeds: np.ndarray) -> np.ndarray:
    """Flags by the top bits of the seeds, about 64 a seed, 2**26 at most."""
    bits = min(26, max(16, int(np.ceil(np.log2(len(seeds) * 64 + 1)))))
    seen = np.zeros(1 << bits, dtype=bool)
    seen[seeds >> _U(64 - bits)] = True
    return seen


def _doc_seeds(piece: pa.Array, seen: np.ndarray):
    """Words of a piece and (document, position in it, seed) of the runs that may be seeds."""
    w = tc.Words(piece)
    h = tc.shingle_hashes(w.hashes, MIN_MATCH) if len(w.hashes) >= MIN_MATCH else w.hashes[:0]
    bits = int(np.log2(len(seen)))
    at = np.flatnonzero(seen[h >> _U(64 - bits)])
    doc = np.searchsorted(w.first, at, side="right") - 1
    inside = at + MIN_MATCH <= w.first[doc + 1]
    at, doc, h = at[inside], doc[inside], h[at[inside]]
    # A document of fewer words has one seed, all its words, as an item of fewer has.
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < MIN_MATCH))
    if len(short):
        whole = np.array([tc.shingle_hashes(w.hashes[w.first[d] : w.first[d + 1]], MIN_MATCH)[0] for d in short], dtype=np.uint64)
        hit = seen[whole >> _U(64 - bits)]
        doc, at, h = np.concatenate([doc, short[hit]]), np.concatenate([at, w.first[short[hit]]]), np.concatenate([h, whole[hit]])
    return w, doc, at - w.first[doc], h


def _reduced(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Only the words of ``words`` that the seeds at ``at`` cover; a word that occurs nowhere parts what wasn't adjacent. No tile is lost."""
    if len(words) < MIN_MATCH:
        return words
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + MIN_MATCH, -1)
    keep = np.cumsum(covered[:-1]) > 0
    gap = np.flatnonzero(~keep & np.concatenate([[False], keep[:-1]]))
    out = words.copy()
    out[gap] = tc.mix(gap.astype(np.uint64) + _U(0x5DEECE66D))
    keep[gap] = True
    return out[keep]


def _judge(doc_ids: list, item_ids: list, docs: list[np.ndarray], items: list[np.ndarray]) -> pa.RecordBatch | None:
    rows = []
    for d, i, x, y in zip(doc_ids, item_ids, docs, items):
        n = sum(t[2] for t in tiles(x, y)) if len(y) >= MIN_MATCH else len(y) * int(np.array_equal(x, y))
        if len(y) and n >= COVERAGE * len(y):
            rows.append((d, i, n, len(y), n / len(y)))
    if not rows:
        return None
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())], names=["doc_id", "item_id", "matched", "item_words", "coverage"])


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, matched (words in tiles), item_words and coverage, for each pair with coverage of at least ``COVERAGE``.

    A benchmark of at most ``broadcast_bytes`` is broadcast; of a larger one only
    a bitmap of bounded size, and seeds are joined by a shuffle.

    Null and empty texts are in no pair; an item of fewer than ``MIN_MATCH`` words
    is in one with documents of the same words and no others.  Rows with a NULL
    doc_id or item_id take no part.  Texts of any length are read whole.  Repeated
    rows count once; if an id has several texts, the one with the greatest coverage
    counts (then the most matched words, the fewest words).  Ties between tiles are
    resolved by position.  Empty tables give no pairs.  Other columns are ignored
    whatever their names, in any case.
    """
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    b = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct()
    held = b.agg(F.coalesce(F.sum(F.length("text") * 4 + 100), F.lit(0)).alias("n")).first()["n"]
    if held <= broadcast_bytes:
        rows = b.orderBy("item_id", "text").toArrow()
        shared = spark.sparkContext.broadcast(Benchmark(rows["item_id"].to_pylist(), rows["text"].to_pylist()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench: Benchmark = shared.value
            for batch in batches:
                ids = batch.column(0)
                for start, piece in tc.pieces(tc.as_text(batch.column(1))):
                    w, doc, at, h = _doc_seeds(piece, bench.seen)
                    lo, hi = np.searchsorted(bench.seeds, h), np.searchsorted(bench.seeds, h, side="right")
                    n = hi - lo
                    doc, at = np.repeat(doc, n), np.repeat(at, n)
                    item = bench.seed_item[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    by = np.lexsort((at, item, doc))
                    doc, at, item = doc[by], at[by], item[by]
                    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else []
                    ends = np.append(new[1:], len(doc)) if len(doc) else []
                    pairs = [(ids[start + int(doc[s])].as_py(), int(item[s]), _reduced(w.hashes[w.first[doc[s]] : w.first[doc[s] + 1]], at[s:e])) for s, e in zip(new, ends)]
                    if pairs:
                        found = _judge([p[0] for p in pairs], [bench.ids[p[1]] for p in pairs], [p[2] for p in pairs], [bench.items[p[1]] for p in pairs])
                        if found is not None:
                            yield found

        found = d.mapInArrow(tc.releasing(scan), _SCHEMA)
    else:
        found = _leaks_joined(d, b)
    best = F.max(F.struct("coverage", "matched", (-F.col("item_words")).alias("w")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", F.col("x.matched").alias("matched"), (-F.col("x.w")).alias("item_words"), F.col("x.coverage").alias("coverage"))


def _leaks_joined(d: DataFrame, b: DataFrame) -> DataFrame:
    """:func:`leaks` for a benchmark of any size: seeds that pass a bitmap are joined by hash, the texts of pairs by id.

    Coverage takes ``COVERAGE`` of an item's n words in tiles of ``MIN_MATCH`` or
    more, hence at least an eighth of n of its seeds.  So the seeds of an item that
    the most documents have can be left out, as long as there are fewer of them: a
    pair then meets on a rarer one.
    """
    spark = d.sparkSession

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """item, text (a hash of it: an item may have several), seed, times it stands there, and times that may be left out."""
        for batch in batches:
            for item, text in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                words = tc.Words(tc.as_text(pa.array([text]))).hashes
                if not len(words):
                    continue
                seed, n = np.unique(tc.shingle_hashes(words, MIN_MATCH), return_counts=True)
                need = int(np.ceil(COVERAGE * len(words) / MIN_MATCH))
                full = lambda v: pa.array(np.full(len(seed), v, dtype=np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([full(item), full(tc.shingle_hashes(words, len(words)).view(np.int64)[0]), pa.array(seed.view(np.int64)), pa.array(n.astype(np.int64)), full(need - 1)], names=["item_id", "version", "seed", "n", "spare"])

    every = cut(b.mapInArrow(item_seeds, "item_id bigint, version bigint, seed bigint, n bigint, spare bigint").distinct())
    top = 26

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bitmap of a partition's seeds, in pieces of 64 kB of those that aren't empty."""
        flags = np.zeros(1 << top, dtype=bool)
        for batch in batches:
            flags[batch.column(0).to_numpy().view(np.uint64) >> _U(64 - top)] = True
        parts = np.packbits(flags).reshape(-1, 1 << 16)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["at", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[at] = found.get(at, np.zeros(1 << 16, dtype=np.uint8)) | np.frombuffer(part, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([p.tobytes() for p in found.values()], pa.binary())], names=["at", "part"])

    packed = np.zeros(1 << (top - 3), dtype=np.uint8).reshape(-1, 1 << 16)
    for r in every.select("seed").mapInArrow(fold, "at int, part binary").repartition("at").mapInArrow(merge, "at int, part binary").toLocalIterator():
        packed[r["at"]] = np.frombuffer(r["part"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(packed.ravel())

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, piece in tc.pieces(tc.as_text(batch.column(1))):
                _, doc, _, h = _doc_seeds(piece, seen)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[start + doc]), pa.array(h.view(np.int64))], names=["doc_id", "seed"])

    met = cut(d.mapInArrow(tc.releasing(doc_seeds), "doc_id bigint, seed bigint").distinct())
    often = met.groupBy("seed").agg(F.count("*").alias("often"))
    by_rank = Window.partitionBy("item_id", "version").orderBy(F.desc("often"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seeds = every.join(often, "seed").withColumn("dropped", F.sum("n").over(by_rank)).where("dropped > spare").select("item_id", "seed").distinct()
    pairs = met.join(seeds, "seed").select("doc_id", "item_id").distinct()
    full = pairs.join(d, "doc_id").join(b.select("item_id", F.col("text").alias("item")), "item_id").select("doc_id", "item_id", "text", "item")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def words(col):
            out = []
            for _, piece in tc.pieces(tc.as_text(col)):
                w = tc.Words(piece)
                out += [w.hashes[x:y] for x, y in zip(w.first[:-1], w.first[1:])]
            return out

        for batch in batches:
            found = _judge(batch.column(0).to_pylist(), batch.column(1).to_pylist(), words(batch.column(2)), words(batch.column(3)))
            if found is not None:
                yield found

    return full.mapInArrow(judge, _SCHEMA)


def keep_unleaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark item contaminates; rows with a NULL doc_id or text stay, and all where the benchmark is empty."""
    bad = cut(leaks(docs, benchmark).select("doc_id").distinct())
    return without(docs, "doc_id", broadcast_if_small(bad, 16))


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contaminated pairs of documents and benchmark items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
