"""Closed-form out-of-fold predictors: every fold of every repeat from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.features import leave_fold_out_means, leave_fold_out_moments
from foldwright.session import small_side, small_sides


def fold_mean(df: DataFrame, y: str, out: str = "mean") -> DataFrame:
    stats = leave_fold_out_means(df, {out: F.col(y)}).drop("n_train")
    return df.join(F.broadcast(stats), ["iter", "fold"])  # one row per (iter, fold)


def fold_log_mean(df: DataFrame, y: str, out: str = "log_mean") -> DataFrame:
    """exp(mean(ln(y + 1))) - 1 over the training rows."""
    stats = leave_fold_out_means(df, {out: F.log1p(F.col(y))}).drop("n_train")
    return df.join(F.broadcast(stats.withColumn(out, F.expm1(out))), ["iter", "fold"])


def fold_group_mean(df: DataFrame, y: str, group: str, out: str) -> DataFrame:
    """Training mean of the row's category; the overall training mean where the category is absent."""
    per_group = leave_fold_out_means(df, {"_by_group": F.col(y)}, [group]).drop("n_train")
    overall = leave_fold_out_means(df, {"_overall": F.col(y)}).drop("n_train")
    joined = df.join(F.broadcast(overall), ["iter", "fold"]).join(small_side(per_group), ["iter", "fold", group], "left")
    return joined.withColumn(out, F.coalesce("_by_group", "_overall")).drop("_by_group", "_overall")


def fold_line(df: DataFrame, y: str, x: str, out: str, l2: float = 0.0, l1: float = 0.0) -> DataFrame:
    """One-feature least squares, ridge (``l2`` added to the sum of squares) or lasso (soft threshold
    ``n * l1`` on the sum of products), fitted outside the row's fold; the intercept is not penalised."""
    m = leave_fold_out_moments(df, [x, y], [(x, y)])
    sp, ss = F.col(f"sp_{x}_{y}"), F.col(f"ss_{x}")
    shrunk = F.signum(sp) * F.greatest(F.abs(sp) - F.col("n") * F.lit(float(l1)), F.lit(0.0)) if l1 else sp
    lines = m.select(
        "iter",
        "fold",
        (shrunk / (ss + F.lit(float(l2)))).alias("_slope"),
        F.col(f"mean_{x}").alias("_mx"),
        F.col(f"mean_{y}").alias("_my"),
    )
    joined = df.join(F.broadcast(lines), ["iter", "fold"])  # one row per (iter, fold)
    return joined.withColumn(out, F.col("_my") + F.col("_slope") * (F.col(x) - F.col("_mx"))).drop("_slope", "_mx", "_my")


def weighted_fold_mean(df: DataFrame, y: str, weight: str, out: str) -> DataFrame:
    """The constant that minimises the weighted squared error on the training rows."""
    stats = leave_fold_out_means(df, {"_wy": F.col(weight) * F.col(y), "_w": F.col(weight)})
    lines = stats.select("iter", "fold", (F.col("_wy") / F.col("_w")).alias(out))
    return df.join(F.broadcast(lines), ["iter", "fold"])


def baseline_library(df: DataFrame, y: str, x: str, groups: dict[str, str], ridge: float = 1.0) -> DataFrame:
    """A library of closed-form models as columns next to the rows.

    One aggregation serves the means and lines of all folds, one more each category; the statistics
    are fetched once, so the result is a scan with broadcast lookups, however often it is used.
    """
    m = leave_fold_out_moments(df.withColumn("_log", F.log1p(y)), [x, y, "_log"], [(x, y)])
    slope = lambda penalty: F.col(f"sp_{x}_{y}") / (F.col(f"ss_{x}") + F.lit(float(penalty)))
    stats = m.select(
        "iter",
        "fold",
        F.col(f"mean_{y}").alias("mean"),
        F.expm1("mean__log").alias("log_mean"),
        F.col(f"mean_{x}").alias("_mx"),
        slope(0.0).alias("_ols"),
        slope(ridge).alias("_ridge"),
    )
    per_group = [leave_fold_out_means(df, {name: F.col(y)}, [group]).drop("n_train") for name, group in groups.items()]
    overall, *lookups = small_sides([stats, *per_group])
    df = df.join(overall, ["iter", "fold"])
    for (name, group), lookup in zip(groups.items(), lookups):
        df = df.join(lookup, ["iter", "fold", group], "left").withColumn(name, F.coalesce(name, "mean"))
    lines = {n: F.col("mean") + F.col(f"_{n}") * (F.col(x) - F.col("_mx")) for n in ("ols", "ridge")}
    return df.withColumns(lines).drop("_mx", "_ols", "_ridge")


def model_columns(groups: Sequence[str]) -> list[str]:
    return ["mean", "log_mean", *groups, "ols", "ridge"]
