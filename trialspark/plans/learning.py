"""Training table and regression queries."""

from pyspark.sql import functions as F

from trialspark.operators import ml as M, trials as T
from trialspark.plans.registry import query, view
from trialspark.plans.segments import clips
from trialspark.session import materialize

FEATURES = ["motion_level", "texture_level", "noise_level_norm", "edge_level", "volatility", "duration"]

view("v_folds", """SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM (SELECT o_orderkey, o_totalprice, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) AS x""")


def folded(t):
    return M.contiguous_folds(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), ["o_orderkey"], F.floor(F.col("o_orderkey") / 2048).cast("bigint"), 5)


def training(t):
    lab = T.lowest_crf_at_threshold(t.trials, ["video_id"], 85.0).withColumnRenamed("crf", "crf_at_threshold")
    return clips(t).join(lab, "video_id").select("video_id", *[F.col(c).alias(f"feat_{c}") for c in FEATURES], F.lit(85).alias("threshold"), "crf_at_threshold")


@query("k01_crf_regression")
def _(t):
    names = [f"feat_{c}" for c in FEATURES] + ["threshold"]
    train = materialize(training(t), "training")
    x = M.vectors(train, names, "crf_at_threshold")
    x = materialize(M.contiguous_folds(x, ["video_id"], F.floor(F.col("video_id") / 1024).cast("bigint"), M.FOLDS), "folds")
    return M.cross_validate(x).select("video_id", "fold", "label", "prediction")


@query("k02_contiguous_folds", "SELECT o_orderkey, CAST(fold AS INT) AS fold FROM v_folds")
def _(t):
    return folded(t).select("o_orderkey", "fold")


PRED = "o_totalprice / 12000.0::DOUBLE"


@query("k03_prediction_clipping", f"SELECT o_orderkey, greatest(22.0::DOUBLE, least(42.0::DOUBLE, round_even({PRED}, 0))) AS prediction FROM orders")
def _(t):
    return t.orders.select("o_orderkey", M.clip_prediction(F.col("o_totalprice") / 12000.0).alias("prediction"))


METRIC_SQL = f"""SELECT CAST(fold AS INT) AS fold, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, count(*) AS n FROM (SELECT fold, 22 + o_custkey % 21 - greatest(22.0::DOUBLE, least(42.0::DOUBLE, round_even({PRED}, 0))) AS e FROM v_folds) AS x GROUP BY 1"""


def metrics(t):
    x = folded(t).select("fold", (F.lit(22) + F.col("o_custkey") % 21).alias("label"), M.clip_prediction(F.col("o_totalprice") / 12000.0).alias("prediction"))
    return M.fold_metrics(x, "label", "prediction")


@query("e18_fold_metrics", METRIC_SQL, "mae rmse")
def _(t):
    return metrics(t)


@query("e18_mean_metrics", f"SELECT avg(mae) AS cv_mae_mean, avg(rmse) AS cv_rmse_mean, count(*) AS folds FROM ({METRIC_SQL}) AS m", "cv_mae_mean cv_rmse_mean")
def _(t):
    return M.mean_metrics(metrics(t))
