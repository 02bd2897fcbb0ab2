"""Queries: closed-form out-of-fold models, and the same fitted by Spark ML."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.metrics import rmspe
from foldwright.functions.scalar import inverse_square_weight
from foldwright.operators import baselines as B
from foldwright.operators import folds as FO
from foldwright.operators import learners as LE
from foldwright.operators import library as L
from foldwright.plans import sql as Q
from foldwright.plans.common import folded_sales, library, tidy
from foldwright.plans.registry import query
from foldwright.sources import tables

IF = "CAST(iter AS BIGINT) AS iter, CAST(fold AS BIGINT) AS fold"


def _model(name: str) -> str:
    return f'WITH {Q.LIBRARY} SELECT {IF}, row_id, round("{name}", 3) AS pred FROM wide'


@query("oof_group_mean", _model("by_kind"))
def oof_group_mean(spark, folder):
    rows = B.fold_group_mean(folded_sales(spark, folder), "y", "kind", "pred")
    return tidy(rows.select("iter", "fold", "row_id", "pred"), 3)


@query("oof_fold_mean", _model("mean"))
def oof_fold_mean(spark, folder):
    return tidy(B.fold_mean(folded_sales(spark, folder), "y", "pred").select("iter", "fold", "row_id", "pred"), 3)


@query("oof_log_mean", _model("log_mean"))
def oof_log_mean(spark, folder):
    return tidy(B.fold_log_mean(folded_sales(spark, folder), "y", "pred").select("iter", "fold", "row_id", "pred"), 3)


@query("oof_ols1", _model("ols"))
def oof_ols1(spark, folder):
    return tidy(B.fold_line(folded_sales(spark, folder), "y", "x", "pred").select("iter", "fold", "row_id", "pred"), 3)


@query("oof_ridge1", _model("ridge"))
def oof_ridge1(spark, folder):
    rows = B.fold_line(folded_sales(spark, folder), "y", "x", "pred", l2=Q.RIDGE)
    return tidy(rows.select("iter", "fold", "row_id", "pred"), 3)


ITEM_LINE = Q.ITEMS + "," + Q.stratified("items", iters=1) + f""",
m AS {Q.leave_out("folded", "avg(l_quantity) AS mx, avg(y) AS my, covar_pop(l_quantity, y) * count(*) AS sp, var_pop(l_quantity) * count(*) AS ss, count(*) AS n")}"""
LASSO = 100.0


def _item_line(slope: str) -> str:
    return f"""WITH {ITEM_LINE} SELECT CAST(f.fold AS BIGINT) AS fold, row_id, round(my + {slope} * (l_quantity - mx), 2) AS pred
    FROM folded f JOIN m ON f.iter = m.iter AND f.fold = m.fold"""


def _item_folds(spark, folder, features=("l_quantity",)):
    rows = tables.items(spark, folder).select("row_id", "y", "stratum", *features)  # what is fitted here; the rest would be moved in vain
    return FO.store_folds(FO.stratified_folds(rows, "stratum", Q.K, 1))


def _fitted(spark, folder, learner: str, params: dict | None = None):
    table = _item_folds(spark, folder)
    out = LE.out_of_fold(table, learner, ["l_quantity"], Q.K, 1, params)
    return tidy(out.select("fold", "row_id", "pred"), 2)


@query("oof_linear", _item_line("sp / ss"))
def oof_linear(spark, folder):
    """Spark ML least squares against the closed form."""
    return _fitted(spark, folder, "linear")


@query("oof_ridge", _item_line("sp / (ss + 1000000.0::DOUBLE)"))
def oof_ridge(spark, folder):
    return _fitted(spark, folder, "ridge", {"alpha": 1_000_000.0})


@query("oof_lasso", _item_line(f"sign(sp) * greatest(abs(sp) - n * {LASSO}::DOUBLE, 0) / ss"))
def oof_lasso(spark, folder):
    return _fitted(spark, folder, "lasso", {"alpha": LASSO})


@query(
    "oof_lasso1",
    f"""WITH {ITEM_LINE} SELECT CAST(f.fold AS BIGINT) AS fold, row_id, round(my + sign(sp) * greatest(abs(sp) - n * {LASSO}::DOUBLE, 0) / ss * (l_quantity - mx), 3) AS pred
    FROM folded f JOIN m ON f.iter = m.iter AND f.fold = m.fold""",
)
def oof_lasso1(spark, folder):
    rows = B.fold_line(_item_folds(spark, folder), "y", "l_quantity", "pred", l1=LASSO)
    return tidy(rows.select("fold", "row_id", "pred"), 3)


@query(
    "oof_weighted_mean",
    f"""WITH {Q.SALES}, {Q.stratified("sales")}, m AS {Q.leave_out("folded", "sum(y / (y * y)) / sum(1 / (y * y)) AS pred")},
    p AS (SELECT f.iter, f.fold, y, pred FROM folded f JOIN m ON f.iter = m.iter AND f.fold = m.fold)
    SELECT {IF}, round(max(pred), 4) AS pred, round({Q.RMSPE}, 6) AS score FROM p GROUP BY iter, fold""",
)
def oof_weighted_mean(spark, folder):
    """The constant fitted under the percentage-error objective: weights 1 / y^2."""
    rows = folded_sales(spark, folder).withColumn("w", inverse_square_weight(F.col("y")))
    fitted = B.weighted_fold_mean(rows, "y", "w", "pred")
    scores = fitted.groupBy("iter", "fold").agg(
        F.round(F.max("pred"), 4).alias("pred"), F.round(rmspe(F.col("pred"), F.col("y")), 6).alias("score")
    )
    return tidy(scores)


@query(
    "flagship",
    f"""WITH {Q.SCORES} SELECT model, {IF}, round(score, 6) AS score FROM scores WHERE model IN ('mean', 'ols')""",
)
def flagship(spark, folder):
    """Join, features, folds, two out-of-fold models, and their error per fold."""
    wide = B.fold_line(B.fold_mean(folded_sales(spark, folder), "y"), "y", "x", "ols")
    return tidy(L.score(L.to_long(wide, ["mean", "ols"]), "rmspe").drop("metric"))


__all__ = ["flagship", "library"]
