"""Stacking: out-of-fold predictions as features of a second-level model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.learners import LEARNERS, out_of_fold
from foldwright.operators.library import cv_summary, passing, score, to_wide


def models_to_stack(predictions: DataFrame, metric: str, threshold: float) -> list[str]:
    """Names of the models on the good side of the threshold: model-level rows only."""
    kept = passing(cv_summary(score(predictions, metric)), metric, threshold)
    return sorted(r["model"] for r in kept.select("model").collect())


def stack_matrix(predictions: DataFrame, models: Sequence[str], keys: Sequence[str] = ("row_id", "iter")) -> DataFrame:
    """One row per (row, repeat) with a column per model. The folds of a repeat are disjoint, so
    keying by row puts each validation prediction back in its place."""
    return to_wide(predictions.filter(F.col("model").isin(list(models))), models, keys)


def with_raw_features(meta: DataFrame, raw: DataFrame, features: Sequence[str], key: str = "row_id") -> DataFrame:
    return meta.join(raw.select(key, *features), key)


def stack_cv(table: DataFrame, columns: Sequence[str], learner: str, k: int, iters: int, params: dict | None = None) -> DataFrame:
    """Second-level predictions over the same folds, all of them."""
    return out_of_fold(table, learner, columns, k, iters, params, model=f"stack_{learner}")


def stack_test(train: DataFrame, test: DataFrame, columns: Sequence[str], learner: str, iters: int, params: dict | None = None) -> DataFrame:
    """Fit on each repeat's matrix, predict the test matrix, average over repeats."""
    out, names = test, []
    for i in range(iters):
        predict = LEARNERS[learner](train.filter(F.col("iter") == i), columns, dict(params or {}))
        out = predict(out).withColumnRenamed("pred", f"_p{i}")
        names.append(f"_p{i}")
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / F.lit(float(len(names)))
    return out.withColumn("pred", mean).drop(*names)
