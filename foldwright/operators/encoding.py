"""Positions of categories in sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import materialise, small_side

SMALL_DICTIONARY = 20_000


def value_positions(df: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct values of ``col`` with their 0-based position in sorted order.

    A dictionary of proven small size is ranked in one window. A larger one is range partitioned and
    written; positions are then local row numbers plus the sizes of the partitions before. It is
    written first because range bounds are sampled: both uses must see the same partitions.
    """
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    if values.limit(SMALL_DICTIONARY + 1).count() <= SMALL_DICTIONARY:
        ranked = values.select(col, (F.row_number().over(Window.orderBy(col)) - 1).cast("bigint").alias(out))
        return small_side(ranked, SMALL_DICTIONARY)
    pieces = values.repartitionByRange(col).withColumn("_p", F.spark_partition_id())
    stored = materialise(pieces, "dictionary")
    sizes = stored.groupBy("_p").count()  # one row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(col)) - 1
    return (
        stored.withColumn("_local", local)
        .join(F.broadcast(offsets), "_p")
        .select(col, (F.col("_local") + F.col("_off")).cast("bigint").alias(out))
    )
