"""The linear booster: rounds of cyclic coordinate updates on second moments, without a pass over the rows per round.

One aggregation gives every part's sums of products of the features, the label and 1; a fold learns from the total less its
own part, and its watch loss is a quadratic form in its own part's sums. A round first moves the bias, then each weight, by
``eta`` times the step to the best value of that coordinate alone, with L1 ``alpha`` and L2 ``lambda`` on weights and
``lambda_bias`` on the bias.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.boosting import Watch


def moments(df: DataFrame, features: Sequence[str], y: str = "y", by: Sequence[str] = ("iter", "fold")) -> dict[tuple, np.ndarray]:
    """Per part the sums of products of (1, features, y): a few numbers per pair of features, whatever the rows.

    Sums are about the overall means, so that large offsets don't cost digits, and are shifted back.
    """
    names = [*features, y]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).first()
    mean = np.array([0.0, *[float(means[c] or 0.0) for c in names]])
    one = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(names, mean[1:], strict=True)]]
    pairs = [(i, j) for i in range(len(one)) for j in range(i, len(one))]
    rows = df.groupBy(*by).agg(*[F.sum(one[i] * one[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()  # one row per part
    out = {}
    for r in rows:
        m = np.zeros((len(one), len(one)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        shift = np.eye(len(one))
        shift[1:, 0] = mean[1:]
        out[tuple(r[c] for c in by)] = shift @ m @ shift.T
    return out


def loss(m: np.ndarray, w: np.ndarray) -> float:
    """Root mean squared error of the weights (bias first) on the rows behind the sums."""
    r = np.append(w, -1.0)
    return math.sqrt(max(float(r @ m @ r), 0.0) / m[0, 0]) if m[0, 0] else 0.0


def fit(learn: np.ndarray, watch: np.ndarray | None, rounds: int, eta: float, lam: float = 0.0, alpha: float = 0.0, lambda_bias: float = 0.0, patience: int = 0) -> tuple[np.ndarray, list[float]]:
    """(bias and weights, watch loss after each round). The bias starts at the mean label; with ``patience`` the
    weights of the best round are kept."""
    gram, target = learn[:-1, :-1], learn[:-1, -1]
    w = np.zeros(len(target))
    if not gram[0, 0]:
        return w, []
    w[0] = target[0] / gram[0, 0]
    best, seen, watching = w.copy(), [], Watch(patience)
    for number in range(1, rounds + 1):
        before = w.copy()
        w[0] -= eta * (gram[0] @ w - target[0] + lambda_bias * w[0]) / (gram[0, 0] + lambda_bias)
        for j in range(1, len(w)):
            curve = gram[j, j] + lam
            if curve <= 0:
                continue
            free = w[j] - (gram[j] @ w - target[j] + lam * w[j]) / curve  # the best value but for alpha
            w[j] += eta * (math.copysign(max(abs(free) - alpha / curve, 0.0), free) - w[j])
        if watch is not None and watch[0, 0]:
            seen.append(loss(watch, w))
            if patience:
                goes_on = watching.goes_on(number, seen[-1])
                if watching.rounds == number:
                    best = w.copy()
                if not goes_on:
                    break
        if np.array_equal(before, w):
            break
    return (best if patience and seen else w), seen


def _scored(df: DataFrame, features: Sequence[str], weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    pred = sum((F.get("_w", F.lit(n + 1)) * F.col(f).cast("double") for n, f in enumerate(features)), F.get("_w", F.lit(0)))
    return df.join(F.broadcast(weights), list(keys)).withColumn("pred", pred).drop("_w")  # one row per part


def settings(params: dict) -> dict:
    """Arguments of ``fit`` from parameters under their usual names."""
    return {
        "rounds": int(params["num_rounds"]),
        "eta": float(params.get("eta", 0.5)),
        "lam": float(params.get("lambda", 0.0)),
        "alpha": float(params.get("alpha", 0.0)),
        "lambda_bias": float(params.get("lambda_bias", 0.0)),
        "patience": int(params.get("early_stopping_rounds", 0)),
    }


def out_of_fold_linear(table: DataFrame, features: Sequence[str], params: dict, model: str = "xgb_linear") -> DataFrame:
    """(model, iter, fold, row_id, y, pred) of a linear booster per fold, which watches the fold that it predicts."""
    parts = moments(table, features)
    fitted = []
    for (i, f), own in sorted(parts.items()):
        rest = sum((m for (j, g), m in parts.items() if j == i and g != f), np.zeros_like(own))
        fitted.append((i, f, fit(rest, own, **settings(params))[0].tolist()))
    weights = table.sparkSession.createDataFrame(fitted, "iter int, fold int, _w array<double>")
    scored = _scored(table, features, weights, ["iter", "fold"])
    return scored.select(F.lit(model).alias("model"), "iter", "fold", "row_id", "y", "pred")


def fit_rows(train: DataFrame, features: Sequence[str], params: dict):
    """The learner on one frame; rows with ``is_valid`` = 1 are watched and teach nothing."""
    flag = F.col("is_valid").cast("int") if "is_valid" in train.columns else F.lit(0)
    parts = moments(train.withColumn("_part", flag), features, by=["_part"])
    blank = np.zeros((len(features) + 2, len(features) + 2))
    w = fit(parts.get((0,), blank), parts.get((1,)), **settings(params))[0]

    def predict(df: DataFrame) -> DataFrame:
        pred = sum((F.lit(float(c)) * F.col(f).cast("double") for c, f in zip(w[1:], features, strict=True)), F.lit(float(w[0])))
        return df.withColumn("pred", pred)

    return predict
