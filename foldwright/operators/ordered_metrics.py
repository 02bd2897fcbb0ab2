"""Metrics that depend on an ordering: Lorenz curve, normalised Gini, ROC AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.operators.ranking import CODE, _group_keys, ordering_buckets, ranked_by_value


def lorenz_area(df: DataFrame, key: str, y: str, groups: Sequence[str], tie: str, out: str) -> DataFrame:
    """Sum over rows of (even grid - Lorenz curve), rows in descending order of ``key``.

    With rank r of n rows and S = sum(y) this is n/2 - sum(y * (n - r + 1)) / S. Only local ranks and
    a few sums per bucket are needed, so rows are shuffled once and never joined back.
    """
    coded, keys = _group_keys(ordering_buckets(df, key, False, tie), groups)
    local = Window.partitionBy(CODE, *keys).orderBy(F.col(key).desc_nulls_first(), F.col(tie).asc())
    ranked = coded.select(*dict.fromkeys([*groups, *keys]), CODE, F.col(y).alias("_y"), F.row_number().over(local).alias("_r"))
    per_bucket = ranked.groupBy(CODE, *keys).agg(
        *[F.first(g).alias(g) for g in groups if g not in keys],
        F.count(F.lit(1)).alias("_n"),
        F.sum("_y").alias("_s"),
        F.sum(F.col("_y") * F.col("_r")).alias("_sr"),
    )
    before = Window.partitionBy(*keys).orderBy(CODE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    placed = per_bucket.withColumns(
        {"_off": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(whole)}
    )
    weighted = F.sum(F.col("_s") * (F.col("_all") - F.col("_off") + 1) - F.col("_sr"))
    return placed.groupBy(*keys).agg(
        *[F.first(g).alias(g) for g in groups if g not in keys],
        F.max("_all").alias("n"),
        (F.max("_all") / 2 - weighted / F.sum("_s")).alias(out),
    ).select(*groups, "n", out)


def normalised_gini(
    scored: DataFrame,
    y: str = "y",
    pred: str = "pred",
    groups: Sequence[str] = ("model", "iter", "fold"),
    tie: str = "row_id",
    labels: DataFrame | None = None,
    label_groups: Sequence[str] | None = None,
) -> DataFrame:
    """Lorenz area by prediction over Lorenz area by truth. Ties go by ``tie`` ascending.

    The area by truth is the same for all models: pass ``labels`` (one row per ``label_groups`` and
    ``tie``) to compute it once instead of once per model.
    """
    labels = scored if labels is None else labels
    label_groups = list(groups) if label_groups is None else list(label_groups)
    by_pred = lorenz_area(scored, pred, y, groups, tie, "_g_pred")
    by_true = lorenz_area(labels, y, y, label_groups, tie, "_g_true").drop("n")
    if not label_groups:
        return by_pred.select(*groups, (F.col("_g_pred") / by_true.scalar()).alias("gini"))  # one number
    joined = by_pred.join(by_true, label_groups)
    return joined.select(*groups, (F.col("_g_pred") / F.col("_g_true")).alias("gini"))


def lorenz_curve(df: DataFrame, key: str, y: str, groups: Sequence[str] = (), tie: str = "row_id") -> DataFrame:
    """Per row: rank in descending order of ``key``, Lorenz curve value and even-grid value."""
    ranked = ranked_by_value(
        df, key, False, tie, groups, rank="rank", total="_n", running={"_cum": F.col(y)}, totals={"_sum": F.col(y)}
    )
    grid = F.when(F.col("_n") > 1, (F.col("rank") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return ranked.withColumns({"lorenz": F.col("_cum") / F.col("_sum"), "even": grid}).drop("_n", "_cum", "_sum")


def roc_auc(
    scored: DataFrame, y: str = "y", pred: str = "pred", groups: Sequence[str] = ("model", "iter", "fold")
) -> DataFrame:
    """Rank-sum AUC with average ranks on ties. Rows are first counted per distinct prediction."""
    counts = scored.groupBy(*groups, pred).agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col(y)).alias("_p"))
    coded, keys = _group_keys(ordering_buckets(counts, pred, True), groups)
    local = Window.partitionBy(CODE, *keys).orderBy(F.col(pred).asc_nulls_last())
    upto = local.rowsBetween(Window.unboundedPreceding, -1)
    placed = coded.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    per_bucket = placed.groupBy(CODE, *keys).agg(
        *[F.first(g).alias(g) for g in groups if g not in keys],
        F.sum("_c").alias("_n"),
        F.sum("_p").alias("_pos"),
        F.sum(F.col("_p") * (F.col("_before") + (F.col("_c") + 1) / 2)).alias("_rank"),
    )
    before = Window.partitionBy(*keys).orderBy(CODE).rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_bucket.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    pos, total = F.sum("_pos"), F.sum("_n")
    rank_sum = F.sum(F.col("_rank") + F.col("_off") * F.col("_pos"))
    auc = (rank_sum - pos * (pos + 1) / 2) / (pos * (total - pos))
    return shifted.groupBy(*keys).agg(
        *[F.first(g).alias(g) for g in groups if g not in keys],
        F.when((pos > 0) & (total > pos), auc).alias("auc"),
    ).select(*groups, "auc")
