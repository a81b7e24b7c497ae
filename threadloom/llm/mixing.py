"""Mixing sources to target weights by Pareto order sampling.

A source with target weight w gets n = round(w x total) places.  A document's
expected number of copies is n times its share of its source's size measure.
Its whole copies are certain; what remains, p, is an inclusion probability, and
the places left in the source go to the documents with the smallest odds ratio
(u / (1 - u)) / (p / (1 - p)), where u is a uniform number made from the id
alone: a sample of fixed size with unequal probabilities.

No source is sorted as a whole: ratios are counted in 2**16 bins a source, and
only the bin in which the last place falls is ranked exactly, so one source that
holds most of the corpus is no bottleneck.  Text isn't read to decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import broadcast_if_small, cut, numbered, pick, table

#: Share of the corpus's documents that the mixture holds.
TOTAL_SHARE = 0.5
#: Target weights are proportional to documents ** TEMPERATURE: below 1 small sources gain.
TEMPERATURE = 0.5
SEED = 13
_BINS = 1 << 16


def _uniform(doc_id: Column) -> Column:
    """(52 hash bits + 1/2) / 2**52, from the id and the seed alone."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{SEED}"))), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def _measure(n_chars: Column) -> Column:
    size = F.greatest(F.lit(0), F.coalesce(n_chars, F.lit(0))).cast("double")
    return F.greatest(F.lit(1), F.floor(F.sqrt(size))).cast("bigint")


def _ids(docs: DataFrame) -> DataFrame:
    """doc_id, source and m, a row a document."""
    ids = pick(docs, "doc_id", "source", "n_chars").select("doc_id", "source", _measure(F.col("n_chars")).alias("m")).where("doc_id is not null")
    return cut(ids.groupBy("doc_id").agg(F.max(F.struct("m", "source")).alias("s")).select("doc_id", "s.source", "s.m"))


def _quotas(ids: DataFrame, weights: DataFrame | None, total_share: float) -> DataFrame:
    """_s (source), _sum (its measure) and _n (its places)."""
    per = ids.groupBy("source").agg(F.count("*").alias("docs"), F.sum("m").alias("_sum"))
    every = per.agg(F.sum("docs").alias("all_docs"))
    if weights is None:
        size = F.col("docs").cast("double")
        per = per.withColumn("w", F.sqrt(size) if TEMPERATURE == 0.5 else F.pow(size, F.lit(TEMPERATURE)))
    else:
        w = pick(weights, "source", "weight").select(F.col("source").alias("_w"), F.col("weight").cast("double").alias("w")).where("w > 0")
        per = per.join(w, per["source"].eqNullSafe(F.col("_w"))).drop("_w")
    # Weights are made integers, so that their sum doesn't depend on the order of addition.
    per = per.withColumn("w", F.round(F.col("w") * 1000000).cast("bigint"))
    sums = per.agg(F.sum("w").alias("all_w")).crossJoin(every)
    share = F.col("all_docs").cast("double") * F.lit(total_share) * F.col("w").cast("double") / F.col("all_w").cast("double")
    return cut(per.crossJoin(F.broadcast(sums)).select(F.col("source").alias("_s"), "_sum", F.floor(share + F.lit(0.5)).cast("bigint").alias("_n")))


def _expected(n: Column, m: Column, total: Column, doc_id: Column) -> Column:
    """Struct of the whole copies, the odds ratio q of the rest (NULL without a rest) and its bin."""
    p = ((n * m) % total).cast("double") / total.cast("double")
    u = _uniform(doc_id)
    q = F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    return F.struct(F.floor((n * m - (n * m) % total) / total).cast("bigint").alias("whole"), q.alias("q"), F.floor(q / (1 + q) * _BINS).cast("int").alias("bin"))


def _last_places(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_t (source) and _last, the bin in which its last place falls; _won, the ids of that bin that get one)."""
    bins = each.groupBy("source", "x.bin").agg(F.count("*").alias("c"), F.sum("x.whole").alias("w"), F.max("_n").alias("n"))
    by = W.partitionBy("source")
    left = F.max("n").over(by) - F.sum("w").over(by)
    before = F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("c"))).over(by.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = bins.select(F.col("source").alias("_t"), F.col("bin").alias("_last"), "c", left.alias("left"), before.alias("before")).where("_last is not null and before < left and before + c >= left")
    last = cut(last.select("_t", "_last", (F.col("left") - F.col("before")).alias("_places")))
    edge = each.join(broadcast_if_small(last, 200), each["source"].eqNullSafe(F.col("_t")) & (F.col("x.bin") == F.col("_last")))
    won = edge.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("x.q", "doc_id"))).where(F.col("r") <= F.col("_places")).select(F.col("doc_id").alias("_won"))
    return last.select("_t", "_last"), cut(won)


def _copies(rows: DataFrame, doc_id: Column, source: Column, m: Column, quotas: DataFrame, last: DataFrame, won: DataFrame) -> DataFrame:
    """``rows`` with _copies; the tables joined are a row a source, and the few ids of the sources' last bins."""
    out = rows.join(broadcast_if_small(quotas, 200), source.eqNullSafe(F.col("_s"))).withColumn("_x", _expected(F.col("_n"), m, F.col("_sum"), doc_id))
    out = out.join(broadcast_if_small(last, 200), source.eqNullSafe(F.col("_t")), "left").join(broadcast_if_small(won, 16), doc_id == F.col("_won"), "left")
    inside = F.coalesce(F.col("_x.bin") < F.col("_last"), F.lit(False)) | F.col("_won").isNotNull()
    return out.withColumn("_copies", F.col("_x.whole") + inside.cast("bigint")).where("_copies > 0")


def _tables(ids: DataFrame, weights: DataFrame | None, total_share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    quotas = _quotas(ids, weights, total_share)
    each = ids.join(broadcast_if_small(quotas, 200), ids["source"].eqNullSafe(F.col("_s")))
    each = each.select("doc_id", "source", "_n", _expected(F.col("_n"), F.col("m"), F.col("_sum"), F.col("doc_id")).alias("x"))
    return (quotas, *_last_places(each))


def decide(docs: DataFrame, weights: DataFrame | None = None, total_share: float = TOTAL_SHARE) -> DataFrame:
    """doc_id, source and copies (1 or more) of each document in the mixture.

    ``weights`` has source and weight (any positive scale; sources without a
    weight get none); without it weights follow ``TEMPERATURE``.  The size
    measure is floor(sqrt(n_chars)), at least 1, also where n_chars is NULL.  A
    NULL source is a source of its own, in ``docs`` and in ``weights``.  Repeated
    rows of one doc_id count once, with the largest measure; rows with a NULL
    doc_id take no part.  Ties of the ratio go to the smaller doc_id.  An empty
    table gives an empty mixture.  Other columns are ignored whatever their names,
    in any case.
    """
    ids = _ids(docs)
    out = _copies(ids, F.col("doc_id"), F.col("source"), F.col("m"), *_tables(ids, weights, total_share))
    return out.select("doc_id", "source", F.col("_copies").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are in the mixture, with their number of copies in ``copies`` (``copies_`` and so on if there is such a column).

    Texts are never shuffled: each row is decided where it is, from tables of a
    row a source.  Only where a doc_id has several rows are decisions joined by id.
    """
    name = "copies"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    ids = _ids(docs)
    tables = _tables(ids, None, TOTAL_SHARE)
    plain, col = numbered(docs)
    there = plain.where(col("doc_id").isNotNull())
    if there.count() == ids.count():
        out = _copies(there.withColumn("_m", _measure(col("n_chars"))), col("doc_id"), col("source"), F.col("_m"), *tables)
        return out.select(*plain.columns, "_copies").toDF(*docs.columns, name)
    chosen = _copies(ids, F.col("doc_id"), F.col("source"), F.col("m"), *tables).select(F.col("doc_id").alias("__loom_id"), F.col("_copies").alias("__loom_copies"))
    chosen = broadcast_if_small(cut(chosen), 32)
    return plain.join(chosen, col("doc_id") == F.col("__loom_id")).select(*plain.columns, "__loom_copies").toDF(*docs.columns, name)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the whole corpus: doc_id, source, copies."""
    return decide(table(spark, sf_dir, "documents"))


def decide_sql(docs: str, total_share: float = TOTAL_SHARE) -> str:
    """DuckDB SQL of :func:`decide` over the relation ``docs``, by sorting each source as a whole."""
    return f"""
WITH ids AS (
  SELECT doc_id, (max({{'m': m, 'source': source}})).source AS source, max(m) AS m FROM (
    SELECT doc_id, source, greatest(1, floor(sqrt(greatest(0, coalesce(n_chars, 0))::DOUBLE)))::BIGINT AS m FROM {docs} WHERE doc_id IS NOT NULL) GROUP BY doc_id),
per AS (SELECT source, count(*) AS docs, sum(m)::BIGINT AS sum_m, round(sqrt(count(*)::DOUBLE) * 1000000)::BIGINT AS w FROM ids GROUP BY source),
quota AS (SELECT source, sum_m, floor((SELECT sum(docs) FROM per)::DOUBLE * {total_share}::DOUBLE * w::DOUBLE / (SELECT sum(w) FROM per)::DOUBLE + 0.5::DOUBLE)::BIGINT AS n FROM per),
each AS (
  SELECT doc_id, i.source, n, (n * m) // sum_m AS whole, ((n * m) % sum_m)::DOUBLE / sum_m::DOUBLE AS p,
         (('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM ids i JOIN quota q ON i.source IS NOT DISTINCT FROM q.source),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id) AS r,
         n - sum(whole) OVER (PARTITION BY source) AS places
  FROM each)
SELECT doc_id, source, (whole + CASE WHEN r <= places AND p > 0 THEN 1 ELSE 0 END)::BIGINT AS copies FROM ranked
WHERE whole + CASE WHEN r <= places AND p > 0 THEN 1 ELSE 0 END > 0"""
