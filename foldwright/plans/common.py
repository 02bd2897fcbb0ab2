"""Frames and finishing shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.operators.baselines import baseline_library
from foldwright.operators.folds import store_folds, stratified_folds
from foldwright.operators.library import to_long
from foldwright.plans.sql import ITERS, K, MODELS, RIDGE
from foldwright.sources import tables


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as bigint, fractions as double rounded to ``digits`` (never -0.0)."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            col = col.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            col = F.round(col.cast("double"), digits) + F.lit(0.0)
        out.append(col.alias(field.name))
    return df.select(*out)


def folded_sales(spark: SparkSession, folder: str, iters: int = ITERS) -> DataFrame:
    return store_folds(stratified_folds(tables.sales(spark, folder), "stratum", K, iters))


def library(spark: SparkSession, folder: str, iters: int = ITERS) -> DataFrame:
    """The closed-form model library on the sales frame: one column per model."""
    rows = folded_sales(spark, folder, iters)
    return baseline_library(rows, "y", "x", {"by_kind": "kind", "by_stratum": "stratum"}, RIDGE)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a long prediction table with the label."""
    return to_long(library(spark, folder), MODELS)
