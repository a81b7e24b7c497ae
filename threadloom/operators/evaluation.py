"""Agreement of predictions with labels: everything follows from one aggregate of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = 1, -1
_RANGES = 1024


def strict(pred: Column) -> Column:
    """Uncertain predictions count as not relevant."""
    return F.when(pred == 0, NEGATIVE).otherwise(pred)


def liberal(pred: Column) -> Column:
    """Uncertain predictions count as relevant."""
    return F.when(pred == 0, POSITIVE).otherwise(pred)


def with_labels(predictions: DataFrame, labels: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(predictions that have a label, joined with it; one row with the numbers of labels and of labels without a prediction)."""
    joined = predictions.join(labels, key)
    missing = labels.join(predictions.select(key), key, "left_anti").agg(F.count("*").alias("unmatched"))
    return joined, labels.agg(F.count("*").alias("labels")).crossJoin(missing)


def shares(df: DataFrame, by: str, flag: Column) -> DataFrame:
    """n and the percentage of rows with ``flag``, by group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), (F.avg(flag.cast("int")) * 100).alias("percent"))


def confusion(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """tp, fn, fp, tn (of the positive class) in all or for each group."""
    t, p = F.col(truth), F.col(pred)
    n = lambda a, b: F.count_if((t == a) & (p == b))
    counts = [n(POSITIVE, POSITIVE).alias("tp"), n(POSITIVE, NEGATIVE).alias("fn"), n(NEGATIVE, POSITIVE).alias("fp"), n(NEGATIVE, NEGATIVE).alias("tn")]
    return (df.groupBy(*by) if by else df.groupBy()).agg(*counts)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def scores(cm: DataFrame) -> DataFrame:
    """``cm`` with accuracy, macro precision, recall and F1 (0 where undefined) and Cohen's kappa (NULL where undefined)."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    all_n = tp + fn + fp + tn
    p1, p0 = _ratio(tp, tp + fp), _ratio(tn, tn + fn)
    r1, r0 = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    agree = (tp + tn).cast("double") / all_n
    chance = ((tp + fn).cast("double") * (tp + fp) + (fp + tn).cast("double") * (fn + tn)) / (all_n.cast("double") * all_n)
    safe = lambda c: F.when(all_n > 0, c)
    kappa = F.when((all_n > 0) & (chance != 1.0), (agree - chance) / (1 - chance))
    return cm.withColumns({
        "accuracy": safe(_ratio(tp + tn, all_n)), "precision_macro": safe((p1 + p0) / 2), "recall_macro": safe((r1 + r0) / 2), "f1_macro": safe((f1 + f0) / 2), "kappa": kappa,
    })


def bucket(conf: Column) -> Column:
    """low below .6, medium below .8, else high; NULL beyond [0, 1.01)."""
    return F.when(conf < 0, None).when(conf < 0.6, "low").when(conf < 0.8, "medium").when(conf < 1.01, "high")


def accuracy_by_bucket(df: DataFrame, truth: str, pred: str, conf: str) -> DataFrame:
    rows = df.withColumn("bucket", bucket(F.col(conf))).where("bucket is not null")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy"))


def auc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """auc and gini by mid-ranks, NULL where a class lacks; ``truth`` is 0 or 1.

    Ties are collapsed first. Running counts are then made within ranges of
    scores and the ranges' offsets added, so no task sorts all scores.
    """
    by = by or []
    counts = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(truth) == 1).alias("_p"), F.count_if(F.col(truth) == 0).alias("_n"))
    ends = counts.agg(F.min(score).cast("double").alias("_lo"), F.max(score).cast("double").alias("_hi"))
    place = F.floor(F.try_divide(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (_RANGES - 1))
    counts = counts.crossJoin(F.broadcast(ends)).withColumn("_range", F.coalesce(place, F.lit(0)).cast("int")).drop("_lo", "_hi")
    size = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_all"))
    off = size.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_range"])], (F.sum("_all").over(W.partitionBy(*by).orderBy("_range")) - F.col("_all")).alias("_off"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_range"])])
    within = F.coalesce(F.sum("_n").over(W.partitionBy(*by, "_range").orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_in", within).join(off, same)
    ranked = ranked.withColumn("_won", F.col("_p") * ((F.col("_off") + F.col("_in")).cast("double") + F.col("_n") / 2))
    total = F.sum("_p") * F.sum("_n")
    out = (ranked.groupBy(*by) if by else ranked.groupBy()).agg(F.when(total > 0, F.sum("_won") / total).alias("auc"))
    return out.withColumn("gini", 2 * F.col("auc") - 1)


def full_report(df: DataFrame, truth: str, pred: str, group: str) -> DataFrame:
    """One row with a JSON text: strict and liberal scores, and strict scores by group."""
    def one(view):
        s = scores(confusion(df.withColumn("_p", view(F.col(pred))), truth, "_p"))
        return s.select(F.struct(*s.columns).alias(view.__name__))

    per = scores(confusion(df.withColumn("_p", strict(F.col(pred))), truth, "_p", [group]))
    per = per.agg(F.array_sort(F.collect_list(F.struct(group, *[c for c in per.columns if c != group]))).alias("per_group"))
    return one(strict).crossJoin(one(liberal)).crossJoin(per).select(F.to_json(F.struct("strict", "liberal", "per_group")).alias("report"))
