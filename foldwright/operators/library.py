"""The model library: prediction tables, scores and what can be read off them.

``predictions`` is long: (model, iter, fold, row_id, pred). ``wide`` has one row per (iter, fold,
row_id) and one column per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.metrics import METRICS
from foldwright.functions.scalar import model_key
from foldwright.operators.ordered_metrics import normalised_gini, roc_auc
from foldwright.session import small_side

ROW = ["iter", "fold", "row_id"]


def to_long(wide: DataFrame, models: Sequence[str], keep: Sequence[str] = ("iter", "fold", "row_id", "y")) -> DataFrame:
    """One row per model and row; narrow, no shuffle."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("pred")) for m in models])
    return wide.select(*keep, F.explode(cells).alias("_c")).select("_c.model", *keep, "_c.pred")


def dealt_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal keys in one task each, before they are grouped: a group per row leaves nothing to combine on the
    side that sends, where the groups of a whole input split would be held at once. Fractions are left
    out of the dealing, as grouping makes their zeros alike first."""
    whole = [k for k in keys if not isinstance(df.schema[k].dataType, (T.FloatType, T.DoubleType))]
    return df.repartition(*(whole or keys))


def to_wide(predictions: DataFrame, models: Sequence[str], keys: Sequence[str] = tuple(ROW)) -> DataFrame:
    """One column per listed model, in one aggregation. The list is explicit, so there is no extra pass to find it."""
    cells = [F.first(F.when(F.col("model") == m, F.col("pred")), ignorenulls=True).alias(m) for m in models]
    dealt = dealt_by(predictions.select(*keys, "model", "pred"), keys)
    return dealt.groupBy(*keys).agg(*cells) if cells else dealt.select(*keys).distinct()


def align_with_labels(predictions: DataFrame, labels: DataFrame, keys: Sequence[str] = tuple(ROW)) -> DataFrame:
    return predictions.join(labels, list(keys))


def zeros_for_failed(labels: DataFrame, predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """Predictions of every listed model for every labelled row; 0 and ``failed`` = 1 where missing."""
    names = F.explode(F.array(*[F.lit(m) for m in models]))
    wanted = labels.withColumn("model", names)
    joined = wanted.join(predictions, ["model", *ROW], "left")
    return joined.withColumns(
        {"failed": F.col("pred").isNull().cast("int"), "pred": F.coalesce(F.col("pred"), F.lit(0.0))}
    )


def score(
    scored: DataFrame,
    metric: str,
    groups: Sequence[str] = ("model", "iter", "fold"),
    y: str = "y",
    pred: str = "pred",
    tie: str = "row_id",
    labels: DataFrame | None = None,
    label_groups: Sequence[str] | None = None,
) -> DataFrame:
    """``groups`` plus ``metric`` and ``score``, for any registered metric.

    ``labels`` (one row per ``label_groups`` and ``tie``) spares Gini the truth ordering per model.
    """
    entry = METRICS[metric]
    if metric == "gini":
        out = normalised_gini(scored, y, pred, groups, tie, labels, label_groups).withColumnRenamed("gini", "score")
    elif metric == "auc":
        out = roc_auc(scored, y, pred, groups).withColumnRenamed("auc", "score")
    else:
        out = scored.groupBy(*groups).agg(entry.aggregate(F.col(pred), F.col(y)).alias("score"))
    return out.select(*groups, F.lit(metric).alias("metric"), "score")


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over folds and repeats."""
    return scores.groupBy("model", "metric").agg(
        F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"), F.count(F.lit(1)).alias("n_folds")
    )


def best_first(metric: str, col: str = "cv_mean"):
    return F.col(col).desc() if METRICS[metric].higher_is_better else F.col(col).asc()


def ranking(summary: DataFrame, metric: str) -> DataFrame:
    """Models from best to worst; ties by name. One row per model, so one window will do."""
    order = Window.orderBy(best_first(metric), F.col("model"))
    return summary.withColumn("model_rank", F.row_number().over(order).cast("bigint"))


def best_model(summary: DataFrame, metric: str) -> str:
    """Name of the best model: the seed of an ensemble."""
    return summary.orderBy(best_first(metric), "model").limit(1).first()["model"]


def passing(summary: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Models on the good side of a threshold."""
    keep = F.col("cv_mean") > threshold if METRICS[metric].higher_is_better else F.col("cv_mean") < threshold
    return summary.filter(keep)


def completeness(index: DataFrame, k: int, iters: int) -> DataFrame:
    """Per model: how many (iter, fold) parts exist and whether that is all of them."""
    parts = index.select("model", "iter", "fold").distinct()
    counted = parts.groupBy("model").agg(F.count(F.lit(1)).alias("n_parts"))
    return counted.withColumn("complete", (F.col("n_parts") == k * iters).cast("int"))


def library_listing(index: DataFrame, k: int, iters: int) -> DataFrame:
    """Keys of the complete members over feature set, model and trial (null: the model's own parameters)."""
    member = ["feat", "model", "trial"]
    parts = index.select(*member, "iter", "fold").distinct().groupBy(*member).agg(F.count(F.lit(1)).alias("n_parts"))
    complete = parts.filter(F.col("n_parts") == k * iters)
    return complete.select(*member, model_key(F.col("feat"), F.col("model"), F.col("trial")).alias("key"))


def missing_work(wanted: DataFrame, existing: DataFrame, forced: Sequence[str] = ()) -> DataFrame:
    """(model, iter, fold) still to train: not there yet, or asked for again."""
    keys = ["model", "iter", "fold"]
    done = existing.select(*keys).distinct()
    if forced:
        done = done.filter(~F.col("model").isin(list(forced)))
    return wanted.select(*keys).join(done, keys, "left_anti")


def fold_sizes(df: DataFrame) -> DataFrame:
    """Rows per (iter, fold) and the largest of them."""
    sizes = df.groupBy("iter", "fold").agg(F.count(F.lit(1)).alias("n_valid"))
    return sizes.withColumn("max_valid", F.max("n_valid").over(Window.partitionBy()))  # one row per fold


def correlation_with(wide: DataFrame, reference: str, models: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of one model's predictions with every other's, in one aggregation."""
    stats = wide.groupBy(*groups).agg(*[F.corr(reference, m).alias(m) for m in models])
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("corr")) for m in models])
    return stats.select(*groups, F.explode(cells).alias("_c")).select(*groups, "_c.model", "_c.corr")


def model_report(wide: DataFrame, models: Sequence[str], metric: str) -> DataFrame:
    """Score, deviation, rank and correlation with the best model."""
    summary = cv_summary(score(to_long(wide, models), metric))
    ranked = small_side(ranking(summary, metric))
    best = ranked.filter(F.col("model_rank") == 1).first()["model"]
    return correlation_with(wide, best, models).join(ranked, "model").withColumn("is_best", (F.col("model") == best).cast("int"))


def prediction_range(predictions: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    return predictions.groupBy(*groups).agg(F.min("pred").alias("pred_min"), F.max("pred").alias("pred_max"))


def class_ratio(df: DataFrame, y: str) -> DataFrame:
    """Rows of class 0 per row of class 1."""
    zeros, ones = F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)
    return df.agg(zeros.alias("n0"), ones.alias("n1"), (zeros / ones).alias("ratio"))


def rescale(predictions: DataFrame, how, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Apply ``how(pred, min, max)`` with the minimum and maximum of the row's model."""
    bounds = small_side(prediction_range(predictions, groups))
    joined = predictions.join(bounds, list(groups))
    return joined.withColumn("pred", how(F.col("pred"), F.col("pred_min"), F.col("pred_max"))).drop("pred_min", "pred_max")
