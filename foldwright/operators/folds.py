"""Reproducible folds, holdouts and fold membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.hashing import hash_order
from foldwright.operators.ranking import is_within_first, ranked_by_hash, ranked_by_value
from foldwright.session import materialise

# The seed of repeat i is 711 + 1000 * (i + 1).
SEED_BASE = 711
SEED_STEP = 1000


def fold_seeds(iters: int) -> list[int]:
    return [SEED_BASE + SEED_STEP * (i + 1) for i in range(iters)]


def repeated(df: DataFrame, iters: int) -> DataFrame:
    """One copy of each row per repeat, with its ``iter`` and ``_seed``."""
    plan = F.array(*[F.struct(F.lit(i).alias("iter"), F.lit(s).alias("_seed")) for i, s in enumerate(fold_seeds(iters))])
    return df.withColumn("_plan", F.explode(plan)).select(*df.columns, "_plan.iter", "_plan._seed")


def stratified_folds(
    df: DataFrame, stratum: str, k: int = 3, iters: int = 1, row_id: str = "row_id", buckets: int | None = None
) -> DataFrame:
    """Shuffled folds, repeated, dealt out in turn inside each stratum.

    Adds ``iter`` and ``fold`` (the fold in which the row validates) and keeps the other columns,
    so that no join is needed to put rows into folds.
    """
    rows = repeated(df, iters).withColumn("_h", hash_order(F.col("_seed"), F.col(row_id)))
    ranked = ranked_by_hash(rows, "_h", row_id, ["iter", stratum], buckets, rank="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_seed", "_h")


def store_folds(df: DataFrame) -> DataFrame:
    """Write a frame with folds once, partitioned by (iter, fold).

    Dealing out folds takes a shuffle; everything after it scans the table, and what concerns one
    fold, or all others, reads only those partitions.
    """
    return materialise(df, "folds", ("iter", "fold"))


def block_folds(
    df: DataFrame, k: int = 3, iters: int = 1, row_id: str = "row_id", buckets: int | None = None
) -> DataFrame:
    """Shuffled blocks of floor(n / k) rows; the remainder never validates and gets fold -1."""
    rows = repeated(df, iters).withColumn("_h", hash_order(F.col("_seed"), F.col(row_id)))
    ranked = ranked_by_hash(rows, "_h", row_id, ["iter"], buckets, rank="_rank", total="_n")
    block = F.floor(F.col("_n") / k)
    fold = F.floor((F.col("_rank") - 1) / block)
    placed = F.when((block > 0) & (fold < k), fold).otherwise(F.lit(-1)).cast("int")
    return ranked.withColumn("fold", placed).drop("_rank", "_n", "_seed", "_h")


def value_strata(df: DataFrame, col: str, bins: int, row_id: str = "row_id", out: str = "stratum") -> DataFrame:
    """Equal-count bins of a continuous column, so that it can be stratified on."""
    ranked = ranked_by_value(df, col, True, row_id, rank="_rank", total="_n")
    return ranked.withColumn(out, F.floor((F.col("_rank") - 1) * bins / F.col("_n")).cast("int")).drop("_rank", "_n")


def tail_holdout(df: DataFrame, by: str, size: int, row_id: str = "row_id", out: str = "is_valid") -> DataFrame:
    """Flag the last ``size`` rows along ``by`` as validation rows."""
    return df.withColumn(out, is_within_first(df, by, False, row_id, size).cast("int"))


def head_fraction(df: DataFrame, by: str, fraction: float, row_id: str = "row_id", out: str = "is_valid", ascending: bool = True) -> DataFrame:
    """Flag the first int(fraction * n) + 1 rows along ``by`` (numbers or text) as validation rows."""
    n = df.count()
    size = int(fraction * n) + 1
    if not isinstance(df.schema[by].dataType, T.StringType):
        return df.withColumn(out, is_within_first(df, by, ascending, row_id, size).cast("int"))
    # text orders ties: with one value throughout it alone decides, and the last rows are those not among the first
    even = df.withColumn("_even", F.lit(0.0))
    first = is_within_first(even, "_even", True, by, size if ascending else n - size)
    return even.withColumn(out, (first if ascending else ~first).cast("int")).drop("_even")


def in_training(df: DataFrame, fold: int, iteration: int = 0) -> DataFrame:
    return df.filter((F.col("iter") == iteration) & (F.col("fold") != fold))


def in_validation(df: DataFrame, fold: int, iteration: int = 0) -> DataFrame:
    return df.filter((F.col("iter") == iteration) & (F.col("fold") == fold))


def membership(df: DataFrame, k: int) -> DataFrame:
    """Every row once per fold it takes part in, with ``part`` = train or valid.

    This is the fold-by-fold slicing of all folds in one narrow step: each row is repeated k times
    in place, without a join.
    """
    spread = df.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    part = F.when(F.col("fold") == F.col("_f"), F.lit("valid")).otherwise(F.lit("train"))
    return spread.withColumn("part", part).drop("fold").withColumnRenamed("_f", "fold")
