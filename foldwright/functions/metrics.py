"""Metric aggregates and the metric registry.

Each entry carries its direction, so that search and selection never mistake a loss for a gain.
Metrics that need an ordering (normalised Gini, AUC) live in ``operators.ordered_metrics``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def rmspe(pred: Column, truth: Column, weight_by: str = "truth") -> Column:
    """Root mean squared percentage error; a row whose weight base is 0 adds 0 but still counts."""
    base = truth if weight_by == "truth" else pred
    ratio = (truth - pred) / base
    return F.sqrt(F.avg(F.when(base != 0, ratio * ratio).otherwise(F.lit(0.0))))


def rmspe_of_logs(pred: Column, truth: Column) -> Column:
    """RMSPE after exp(x) - 1 on both sides."""
    return rmspe(F.expm1(pred), F.expm1(truth))


def rmse(pred: Column, truth: Column) -> Column:
    return F.sqrt(F.avg((truth - pred) * (truth - pred)))


def log_loss(pred: Column, truth: Column, eps: float = 1e-15) -> Column:
    p = F.least(F.greatest(pred, F.lit(eps)), F.lit(1.0 - eps))
    return F.avg(-(truth * F.log(p) + (F.lit(1.0) - truth) * F.log(F.lit(1.0) - p)))


@dataclass(frozen=True)
class Metric:
    name: str
    aggregate: Callable[[Column, Column], Column] | None
    higher_is_better: bool
    ordered: bool = False

    def better(self, new: float, old: float, gain: float = 0.0) -> bool:
        return (new - old if self.higher_is_better else old - new) >= gain


METRICS = {
    "rmspe": Metric("rmspe", rmspe, False),
    "rmspe_log": Metric("rmspe_log", rmspe_of_logs, False),
    "rmse": Metric("rmse", rmse, False),
    "logloss": Metric("logloss", log_loss, False),
    "gini": Metric("gini", None, True, ordered=True),
    "auc": Metric("auc", None, True, ordered=True),
}


def register_metric(name: str, aggregate: Callable[[Column, Column], Column], higher_is_better: bool) -> Metric:
    """Add a user metric: a function of (pred, truth) columns giving an aggregate column."""
    METRICS[name] = Metric(name, aggregate, higher_is_better)
    return METRICS[name]
