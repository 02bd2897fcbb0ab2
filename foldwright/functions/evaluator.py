"""Registered metrics as evaluators for Spark ML model selection."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.metrics import METRICS
from foldwright.operators.library import score


class MetricEvaluator(Evaluator):
    """Score of one frame of predictions under a registered metric, with the metric's direction."""

    def __init__(self, metric: str, y: str = "y", pred: str = "pred", tie: str = "row_id"):
        super().__init__()
        self.metric, self.y, self.pred, self.tie = metric, y, pred, tie

    def _evaluate(self, dataset: DataFrame) -> float:
        whole = dataset.withColumn("_all", F.lit(0))
        return float(score(whole, self.metric, ["_all"], self.y, self.pred, self.tie).first()["score"])

    def isLargerBetter(self) -> bool:
        return METRICS[self.metric].higher_is_better
