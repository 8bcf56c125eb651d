"""CRF regression on the training table."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.operators.scan import group_sum, ordered_scan, running_sum
from trialspark.session import materialize

# Limits of a predicted CRF.
CRF_MIN, CRF_MAX = 22.0, 42.0
MIN_ROWS = 8
# Boosting rounds and folds.
ROUNDS, FOLDS = 400, 5
#: A fit runs thousands of short jobs, so its rows are spread over no more tasks than these make worthwhile.
ROWS_IN_TASK = 100_000


def contiguous_folds(df: DataFrame, order: list[str], chunk: Column, k: int) -> DataFrame:
    """Fold per row from contiguous blocks in `order`; the first n mod k folds get one more row."""
    one = F.lit(1).cast("bigint")
    x = ordered_scan(df, [], order, chunk, _rn=running_sum(one), _n=group_sum(one))
    kk = F.greatest(F.lit(2), F.least(F.lit(k), F.col("_n")))
    i, base, extra = F.col("_rn") - 1, F.floor(F.col("_n") / kk), F.col("_n") % kk
    head = extra * (base + 1)
    fold = F.when(i < head, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - head) / base))
    return x.withColumn("fold", fold.cast("int")).drop("_rn", "_n")


def clip_prediction(pred: Column, lo: float = CRF_MIN, hi: float = CRF_MAX) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.rint(pred)))


def fold_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAE and RMSE per fold."""
    e = F.col(label) - F.col(prediction)
    return df.groupBy("fold").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def mean_metrics(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(F.avg("mae").alias("cv_mae_mean"), F.avg("rmse").alias("cv_rmse_mean"), F.count(F.lit(1)).alias("folds"))


def vectors(df: DataFrame, features: list[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    x = df.filter(F.col(label).isNotNull()).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    x = x.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(x)


def require_rows(df: DataFrame) -> None:
    if df.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} labelled rows")


def fit(train: DataFrame, *, rounds: int = ROUNDS, depth: int = 6, step: float = 0.05, seed: int = 42):
    """Gradient-boosted trees on absolute error; `train` comes from `vectors`."""
    from pyspark.ml.regression import GBTRegressor
    return GBTRegressor(featuresCol="features", labelCol="label", lossType="absolute", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(train)


def cross_validate(folded: DataFrame, k: int = FOLDS, **params) -> DataFrame:
    """Out-of-fold predictions: one model per fold, each trained on the others, all at the same time."""
    require_rows(folded)
    folded = folded.coalesce(-(-folded.count() // ROWS_IN_TASK))

    def one(i: int) -> DataFrame:
        return fit(folded.filter(F.col("fold") != i), **params).transform(folded.filter(F.col("fold") == i))

    with ThreadPoolExecutor(k) as pool:
        parts = list(pool.map(one, range(k)))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("prediction", clip_prediction(F.col("prediction"))).drop("features")


def train_model(table: DataFrame, features: list[str], label: str, order: list[str], chunk: Column, path: str, k: int = FOLDS, **params) -> dict:
    """Cross-validate, fit on all labelled rows, and save the model with its metadata below `path`.

    The metadata hold the rows, the feature columns, the label and the metrics of each fold and their means.
    """
    rows = materialize(contiguous_folds(vectors(table, features, label), order, chunk, k), "training")
    per_fold = fold_metrics(cross_validate(rows, k, **params), "label", "prediction").orderBy("fold").collect()  # one row per fold
    meta = {"rows": rows.count(), "features": features, "label": label, "folds": [r.asDict() for r in per_fold],
            "cv_mae_mean": sum(r.mae for r in per_fold) / len(per_fold), "cv_rmse_mean": sum(r.rmse for r in per_fold) / len(per_fold)}
    fit(rows, **params).write().overwrite().save(f"{path}/model")
    table.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return meta


def load_model(spark, path: str):
    """(model, metadata) as saved by train_model."""
    from pyspark.ml.regression import GBTRegressionModel
    return GBTRegressionModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def predict(model, meta: dict, table: DataFrame) -> DataFrame:
    """table with `prediction`, a whole CRF within the limits; missing features count as 0."""
    rows = vectors(table.withColumn("__label", F.lit(0.0)), meta["features"], "__label")
    return model.transform(rows).withColumn("prediction", clip_prediction(F.col("prediction"))).select(*table.columns, "prediction")
