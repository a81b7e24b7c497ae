"""Embedding near-duplicates by collision-counting projections.

Equal directions are one node of the join.  Vectors of length 1 are projected on
``PROJECTIONS`` random directions.  On a projection, the query-centred window of
a vector is everything within ``WINDOW`` times the near-duplicate distance; a
pair collides there if each is in the other's window.  Over Gaussian directions a
pair at the threshold distance collides with known probability p on each
projection, so the number of collisions asked of a pair is calibrated: the
greatest count that such a pair reaches with probability ``COUNT_RECALL``.  Pairs
with that count are verified by their exact cosine.

A window of one projection holds a third of all vectors at the usual threshold,
however many there are, so counting all of its collisions would be quadratic.
Therefore each sort is of a part of the vectors: a table sorts by the signs of
some further random directions first and by a projection of its own second.
A vector's window is then the run of rows around it in that order, and a pair
whose windows meet there is counted over all projections.  The number of signs
follows the number of vectors, so that about ``CELL_ROWS`` share their signs; the
number of tables is the one by which a pair at the threshold meets in at least one
with probability ``MEET_RECALL``.  It grows with about the sixth root of the
number of vectors (cosine 0.95), and a vector has one row a table.

A dense cluster has as many pairs as the square of its vectors, so no pair leaves
the cell in which it is found.  A pair belongs to the first table in which it
meets, which its rows tell: they have the vector's cells and places of all tables.
A first pass only gives the rows that have such a pair; they alone get their
vectors, come together again in the same cells, and there pairs are verified and
links counted.  Of the pairs a cell returns a spanning forest.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import cut, partitions, pick, table
from threadloom.llm.pairs import best_of_each, classes_of, pairs_within, roots

MIN_COSINE, PROJECTIONS, WINDOW, SEED = 0.95, 48, 1.5, 17
COUNT_RECALL, MEET_RECALL, CELL_ROWS = 0.995, 0.99, 512
#: Projections are rounded to this part of a window, which widens windows by as much.
_GRID = 256
#: Pairs that are counted at once, and projections after which those that can't reach the count are dropped.
_AT_ONCE, _STEP = 1 << 19, 8
#: Numbers of the vectors whose cosines are taken at once.
_NUMBERS = 1 << 21
_POST = "cell int, t int, place int, node bigint, keys binary"


class Plan:
    """Everything that follows from the threshold, the dimension and the number of vectors."""

    def __init__(self, dim: int, rows: int, min_cosine: float = MIN_COSINE):
        self.dim, self.min_cosine = dim, min_cosine
        near = math.sqrt(max(1e-6, 2 - 2 * min_cosine))
        self.width = WINDOW * near
        self.p = math.erf(WINDOW / math.sqrt(2))
        self.count = max(k for k in range(PROJECTIONS + 1) if self._at_least(k) >= COUNT_RECALL)
        self.signs = max(0, math.ceil(math.log2(max(1, rows / CELL_ROWS))))
        #: A pair at the threshold meets in a table if all signs agree and it collides on the table's own projection.
        meet = (1 - math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi) ** self.signs * self.p
        self.tables = math.ceil(math.log(1 - MEET_RECALL) / math.log(1 - meet))
        rng = np.random.default_rng(SEED)
        self.directions = rng.standard_normal((dim, PROJECTIONS)).astype(np.float32)
        self.planes = rng.standard_normal((self.tables, dim, self.signs)).astype(np.float32)

    def _at_least(self, k: int) -> float:
        n, p = PROJECTIONS, self.p
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _units(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, v: vector of length 1) of the usable rows of one dimension; ``vectors`` has id and v."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            x = (x[ok] / norm[ok, None]).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), flat], names=["id", "v"])

    return vectors.where(F.size("v") == dim).mapInArrow(scale, "id bigint, v array<float>")


def _posts(plan):
    """Worker function: nodes to one row a table: its cell (by its signs), its place on the table's projection, and all projections and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        weights = np.random.default_rng(SEED + 1).integers(1, 1 << 62, size=p.signs, dtype=np.int64) | 1
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                v = _matrix(batch.column(1), p.dim)
                proj = np.clip(np.rint(v @ p.directions * (_GRID / p.width)), -32000, 32000).astype(np.int16)
                with np.errstate(over="ignore"):
                    cells = np.stack([(((v @ planes > 0) * weights).sum(axis=1, dtype=np.int64) >> 32).astype(np.int32) for planes in p.planes], axis=1)
                keys = pa.array([r.tobytes() for r in np.concatenate([proj, np.ascontiguousarray(cells).view(np.int16)], axis=1)], type=pa.binary())
                for t in range(p.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(cells[:, t]), pa.array(np.full(len(v), t, dtype=np.int32)), pa.array(proj[:, t % PROJECTIONS].astype(np.int32)), batch.column(0), keys], names=["cell", "t", "place", "node", "keys"])

    return run


def _window_pairs(place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, in the order of one sorted projection, that are in each other's window."""
    ends = np.searchsorted(place, place + _GRID, side="right")
    n = ends - np.arange(len(place)) - 1
    upto = np.cumsum(n)
    at = 0
    while at < len(place):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _AT_ONCE)))
        some = n[at:stop]
        i = np.repeat(np.arange(at, stop), some)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        at = stop


def _collided(x: np.ndarray, i: np.ndarray, j: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that collide on at least ``count`` projections."""
    missed = np.zeros(len(i), dtype=np.int16)
    for d in range(0, PROJECTIONS, _STEP):
        part = x[:, d : d + _STEP]
        missed += (np.abs(part[i] - part[j]) > _GRID).sum(axis=1, dtype=np.int16)
        left = missed <= PROJECTIONS - count
        i, j, missed = i[left], j[left], missed[left]
    return i, j


def _first_met(x: np.ndarray, cells: np.ndarray, t: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that meet in no table before ``t``."""
    for s in range(t):
        place = x[:, s % PROJECTIONS].astype(np.int32)
        new = (cells[i, s] != cells[j, s]) | (np.abs(place[i] - place[j]) > _GRID)
        i, j = i[new], j[new]
    return i, j


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell of each table, of several; ``batches`` are sorted by both, and by place."""
    now, held = None, []

    def close():
        if sum(len(b) for b in held) > 1:
            yield pa.Table.from_batches(held)

    for batch in batches:
        cell, t = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]) | (t[1:] != t[:-1])) + 1, [len(cell)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if lo == hi:
                continue
            if now is not None and (cell[lo], t[lo]) != now:
                yield from close()
                held = []
            now = (cell[lo], t[lo])
            held.append(batch.slice(lo, hi - lo))
    yield from close()


def _met(rows: pa.Table, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell with enough collisions that meet in its table first."""
    keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), dtype=np.int16).reshape(len(rows), -1)
    x, cells = keys[:, :PROJECTIONS], np.ascontiguousarray(keys[:, PROJECTIONS:]).view(np.int32)
    t = rows["t"][0].as_py()
    for i, j in _window_pairs(rows["place"].to_numpy()):
        i, j = _first_met(x, cells, t, *_collided(x, i, j, count))
        if len(i):
            yield i, j


def _candidates(plan):
    """Worker function: posts sorted by cell and place to those that have a pair there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            some = np.zeros(len(rows), dtype=bool)
            for i, j in _met(rows, plan.value.count):
                some[i] = some[j] = True
            if some.any():
                yield from rows.filter(pa.array(some)).to_batches()

    return run


def _verify(plan, expand: bool):
    """Worker function: posts sorted by cell and place, with their vectors, to near pairs of nodes (a, b, cosine), or to links.

    ``one`` and ``several`` are numbers of a node's ids: those of that node only, and the
    others.  Links are what :func:`classes_of` takes.
    """

    def near(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        p: Plan = plan.value
        v, step = _matrix(rows["v"].combine_chunks(), p.dim), max(1, _NUMBERS // p.dim)
        for x, y in _met(rows, p.count):
            for lo in range(0, len(x), step):
                i, j = x[lo : lo + step], y[lo : lo + step]
                cosine = np.minimum(1.0, np.einsum("ij,ij->i", v[i].astype(np.float64), v[j].astype(np.float64)))
                ok = cosine >= p.min_cosine
                if ok.any():
                    yield i[ok], j[ok], cosine[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            node, one, several = (rows[c].to_numpy() for c in ("node", "one", "several"))
            count, some, root = np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=bool), np.arange(len(node))
            for i, j, cosine in near(rows):
                if expand:
                    yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(cosine)], names=["a", "b", "cosine"])
                    continue
                np.add.at(count, i, one[j])
                np.add.at(count, j, one[i])
                some[i] = some[j] = True
                root = roots(len(node), np.concatenate([i, np.arange(len(node))]), np.concatenate([j, root]))
                told = (several[i] > 0) | (several[j] > 0)
                if told.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[i[told]]), pa.array(node[j[told]]), pa.nulls(int(told.sum()), pa.int64())], names=["a", "b", "links"])
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(count[some])], names=["a", "b", "links"])

    return run


def _nodes(vectors: DataFrame) -> DataFrame:
    """(node, v: vector of length 1, ids: sorted) of the usable rows of ``vectors``, in any dimension."""
    v = pick(vectors, "vec_id", "embedding").where(F.expr("not exists(embedding, x -> x is null)")).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    # A dimension of one row has no pair.
    dims = [r["d"] for r in v.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()]
    units = functools.reduce(DataFrame.unionByName, [_units(v, d) for d in dims] or [vectors.sparkSession.createDataFrame([], "id bigint, v array<float>")])
    return cut(units.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.monotonically_increasing_id().alias("node"), "v", "ids"))


def _found(nodes: DataFrame, min_cosine: float, expand: bool) -> DataFrame:
    """What :func:`_verify` makes of the vectors of each dimension; ``nodes`` has node, v, one and several."""
    spark = nodes.sparkSession
    schema = f"a bigint, b bigint, {'cosine double' if expand else 'links bigint'}"
    found = [spark.createDataFrame([], schema)]
    for dim, rows in nodes.groupBy(F.size("v")).count().where("count > 1").collect():
        of = nodes.where(F.size("v") == dim)
        plan = spark.sparkContext.broadcast(Plan(dim, rows, min_cosine))
        together = lambda df: df.repartition(partitions(spark), "cell", "t").sortWithinPartitions("cell", "t", "place")
        some = together(of.select("node", "v").mapInArrow(_posts(plan), _POST)).mapInArrow(_candidates(plan), _POST)
        full = some.join(of, "node").select("cell", "t", "place", "node", "keys", "v", "one", "several")
        found.append(together(full).mapInArrow(_verify(plan, expand), schema))
    return functools.reduce(DataFrame.unionByName, found)


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """vec_a < vec_b and cosine, for pairs with a cosine of at least ``min_cosine`` (approximate search, exact verification).

    Vectors are compared with those of the same dimension, for each dimension that
    occurs.  Left out are rows with a NULL vec_id or embedding, with a NULL, NaN or
    infinite element, and of length 0.  Repeated rows count once, and vectors that
    are equal up to their length have cosine 1; an id with several vectors takes
    part with each, never with itself, and a pair then has its greatest cosine.
    Empty tables give no pairs.  Other columns are ignored whatever their names, in
    any case.
    """
    nodes = _nodes(vectors)
    found = _found(nodes.select("node", "v", F.lit(0).alias("one"), F.lit(0).alias("several")), min_cosine, expand=True)
    side = lambda node, ids: nodes.select(F.col("node").alias(node), F.col("ids").alias(ids))
    near = found.join(side("a", "ids_a"), "a").join(side("b", "ids_b"), "b").select(F.explode("ids_a").alias("p"), "ids_b", "cosine").select("p", F.explode("ids_b").alias("q"), "cosine")
    across = near.where("p <> q").select(F.least("p", "q").alias("vec_a"), F.greatest("p", "q").alias("vec_b"), "cosine")
    return best_of_each(across.unionByName(pairs_within(nodes.select("ids"), "vec_a", "vec_b", "cosine")), nodes.select(F.explode("ids").alias("id"), "node"), "vec_a", "vec_b", "cosine")


def classes(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row an id (vec_id that isn't NULL): class_id, the least vec_id that it is connected with by near pairs, and links, the number of ids near it.

    The pairs are those of :func:`near_duplicates`, and none is left out of links; they
    are counted where they are found and not spelled out.  An id without any has its
    own class and 0 links.
    """
    nodes = _nodes(vectors)
    members = nodes.select(F.explode("ids").alias("id"), "node")
    own = members.groupBy("id").agg(F.collect_set("node").alias("nodes")).select(F.explode("nodes").alias("node"), (F.size("nodes") == 1).alias("alone"))
    counts = cut(own.groupBy("node").agg(F.count_if("alone").alias("one"), F.count_if(~F.col("alone")).alias("several")))
    found = cut(_found(nodes.select("node", "v").join(counts, "node"), min_cosine, expand=False))
    return classes_of(pick(vectors, "vec_id").select(F.col("vec_id").alias("id")), members, counts.select("node", F.array("one", "several").alias("ids")), found).withColumnRenamed("id", "vec_id")


def neardup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of each embedding, and the number of its links."""
    return classes(table(spark, sf_dir, "embeddings"))


#: All pairs by brute force, which the search finds but for the recall that it is calibrated to; what each id reaches by them, and how many it has.
NEARDUP_SQL = f"""
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
pairs AS (SELECT DISTINCT a.vec_id AS vec_a, b.vec_id AS vec_b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
WHERE list_cosine_similarity(a.v, b.v) >= {MIN_COSINE}),
e AS (SELECT vec_a AS x, vec_b AS y FROM pairs UNION ALL SELECT vec_b, vec_a FROM pairs),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
l AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT vec_id, coalesce(least(vec_id, c.y), vec_id) AS class_id, coalesce(links, 0) AS links
FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) LEFT JOIN c ON c.x = vec_id LEFT JOIN l ON l.x = vec_id"""
