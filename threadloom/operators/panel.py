"""Daily panels, market features, targets, and the models over them."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators import evaluation

QUANTILE, FOLDS = 0.75, 5


def weighted_daily(df: DataFrame, day: str, weight: str, columns: list[str]) -> DataFrame:
    """Means of ``columns`` by day, weighted by ``weight``, and its sum; NULL where the weights add up to 0."""
    return df.groupBy(day).agg(F.sum(weight).alias(weight), *[F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(c) for c in columns])


def daily_bars(df: DataFrame, symbol: str, time: str, key: str, price: str) -> DataFrame:
    """symbol, date, open and close: the first and last price of each day by (time, key)."""
    at = F.struct(time, key)
    return df.groupBy(F.col(symbol).alias("symbol"), F.to_date(time).alias("date")).agg(F.min_by(price, at).alias("open"), F.max_by(price, at).alias("close"))


def bar_return(open_: Column, close: Column) -> Column:
    return F.try_divide(close - open_, open_)


def features(bars: DataFrame, index: DataFrame) -> DataFrame:
    """date, returns and their sizes of ``bars`` (date, open, close) and of ``index``, on the days that both have."""
    one = bars.select("date", bar_return(F.col("open"), F.col("close")).alias("return_t"))
    two = index.select("date", bar_return(F.col("open"), F.col("close")).alias("index_return"))
    return one.join(two, "date").withColumns({"volatility_t": F.abs("return_t"), "index_volatility": F.abs("index_return")})


def with_activity(df: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``df`` with threshold (the exact quantile of |return_t|, linear between ranks) and active (above it)."""
    t = df.agg(F.percentile(F.abs("return_t"), quantile).alias("threshold"))
    return df.crossJoin(F.broadcast(t)).withColumn("active", (F.abs("return_t") > F.col("threshold")).cast("int"))


def with_target(df: DataFrame) -> DataFrame:
    """``df`` with target, whether the next day is active; days without a next one, or with any NULL, are dropped."""
    return df.withColumn("target", F.lead("active").over(W.orderBy("date"))).na.drop()


def cv_folds(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """date, fold and part: for each fold the days to test (as many for each, the last ones) and all days before to train."""
    n = F.count("*").over(W.partitionBy())
    rows = df.select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("r"), n.alias("n"))
    f = df.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    first = F.col("n") - (folds - F.col("fold")) * F.expr(f"n div {folds + 1}")
    x = rows.crossJoin(F.broadcast(f)).withColumn("first", first).withColumn("size", F.expr(f"n div {folds + 1}"))
    part = F.when(F.col("r") < F.col("first"), "train").when(F.col("r") < F.col("first") + F.col("size"), "test")
    return x.withColumn("part", part).where("part is not null").select("date", "fold", "part")


def standardized(df: DataFrame, columns: list[str], by: DataFrame | None = None) -> DataFrame:
    """z-scores by the mean and population deviation of ``by`` (``df`` itself); a constant column becomes 0."""
    stats = (by or df).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns})
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def _balanced(train: DataFrame) -> DataFrame:
    n = train.groupBy().agg(F.count("*").alias("_n"), F.sum("target").alias("_p"))
    w = F.when(F.col("target") == 1, F.col("_n") / (2 * F.col("_p"))).otherwise(F.col("_n") / (2 * (F.col("_n") - F.col("_p"))))
    return train.crossJoin(F.broadcast(n)).withColumn("_w", w).drop("_n", "_p")


def cross_validate(df: DataFrame, columns: list[str], folds: int = FOLDS) -> dict:
    """Mean scores of an L2 logistic model (C = 1, balanced) over expanding folds, features standardised by each training part; folds with one class are skipped."""
    split = df.join(cv_folds(df, folds), "date").persist()
    rows = []
    for k in range(folds):
        train, test = (split.where((F.col("fold") == k) & (F.col("part") == p)) for p in ("train", "test"))
        if train.select("target").distinct().count() < 2:
            continue
        n = train.count()
        make = VectorAssembler(inputCols=columns, outputCol="features")
        fit = LogisticRegression(labelCol="target", weightCol="_w", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=1000).fit(make.transform(_balanced(standardized(train, columns))))
        out = fit.transform(make.transform(standardized(test, columns, train))).withColumn("p", vector_to_array("probability")[1])
        s = evaluation.scores(evaluation.confusion(out.withColumns({"t": F.when(F.col("target") == 1, 1).otherwise(-1), "y": F.when(F.col("p") >= 0.5, 1).otherwise(-1)}), "t", "y"))
        r = s.crossJoin(evaluation.auc(out, "target", "p")).select("accuracy", "auc", F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("f1")).first()
        rows.append(r)
    split.unpersist()
    aucs = [r["auc"] for r in rows if r["auc"] is not None]
    mean = lambda v: sum(v) / len(v) if v else None
    m = mean(aucs)
    return {
        "auc": m, "auc_std": math.sqrt(sum((a - m) ** 2 for a in aucs) / len(aucs)) if aucs else None, "gini": 2 * m - 1 if aucs else None,
        "f1": mean([r["f1"] for r in rows]), "accuracy": mean([r["accuracy"] for r in rows]), "misclassification": 1 - mean([r["accuracy"] for r in rows]) if rows else None, "folds": len(rows),
    }


def compare(df: DataFrame, market: list[str], topics: list[str], folds: int = FOLDS) -> dict:
    """Scores of the market, topic (the first is the reference and left out) and combined feature sets."""
    sets = {"market_only": market, "topics_only": topics[1:], "combined": topics[1:] + market}
    out = {name: cross_validate(df, cols, folds) for name, cols in sets.items() if cols}
    a, b = (out.get(k, {}).get("auc") for k in ("combined", "market_only"))
    return {"models": out, "auc_improvement_over_market": None if a is None or b is None else a - b}


def odds_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, coefficient, odds_ratio and p_value of an unpenalised logit on standardised features, by falling odds ratio."""
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(standardized(df, columns))
    fit = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="target", maxIter=100, tol=1e-10).fit(rows)
    data = [(c, float(b), math.exp(b), float(p)) for c, b, p in zip(columns, fit.coefficients, fit.summary.pValues)]
    return df.sparkSession.createDataFrame(data, "feature string, coefficient double, odds_ratio double, p_value double").orderBy(F.desc("odds_ratio"), "feature")


def model_report(df: DataFrame, market: list[str], topics: list[str], names: dict[str, str] | None = None, folds: int = FOLDS) -> dict:
    """Everything a result file holds: days, the scores of the three feature sets, the improvement, and the odds ratios with labels."""
    out = compare(df, market, topics, folds)
    rows = [r.asDict() | {"label": (names or {}).get(r["feature"], r["feature"])} for r in odds_ratios(df, topics[1:] + market).collect()]
    return {"n_days": df.count(), **out, "odds_ratios": rows}
