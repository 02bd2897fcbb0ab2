"""File sources and sinks. Every sink writes in parallel; nothing is gathered into one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions import scalar as S
from foldwright.session import scratch_path, setting

TRAIN_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("store", T.LongType()),
        T.StructField("date_text", T.StringType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("sales", T.DoubleType()),
        T.StructField("open", T.IntegerType()),
        T.StructField("promo", T.IntegerType()),
        T.StructField("school_holiday", T.IntegerType()),
        T.StructField("state_holiday", T.StringType()),
        T.StructField("stratum", T.StringType()),
    ]
)
#: Files that a task has open at once, and bytes that each gathers before it writes them out.
OPEN_PARTS, ROW_GROUP_BYTES = 128, 4 << 20
PREDICTION_SCHEMA = "model string, iter int, fold int, row_id bigint, pred double"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, index_column: bool = False) -> DataFrame:
    """CSV with a header and a declared schema. With ``index_column`` the unnamed first column of an
    exported frame is read and left out."""
    if index_column:
        schema = T.StructType([T.StructField("_index", T.LongType()), *schema.fields])
    frame = spark.read.schema(schema).option("header", True).csv(path)
    return frame.drop("_index") if index_column else frame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_external_predictions(spark: SparkSession, path: str, model: str, iteration: int, fold: int, key: str = "bigint") -> DataFrame:
    """Predictions of an outside program as rows of the prediction table.

    The file holds ``row_id,pred``: lines of a distributed text file have no position to rely on.
    """
    frame = spark.read.schema(f"row_id {key}, pred double").csv(path)
    return frame.select(
        F.lit(model).alias("model"), F.lit(iteration).alias("iter"), F.lit(fold).alias("fold"), "row_id", "pred"
    )


def write_features(df: DataFrame, path: str, feature_set: str) -> None:
    """The feature table of one feature set, partitioned by split."""
    df.withColumn("feature_set", F.lit(feature_set)).write.mode("append").partitionBy("feature_set", "split").parquet(path)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Put whole (model, iter, fold) parts into the prediction table: new ones are added, parts that it holds are
    replaced. Rows are written where they are, without a shuffle or a sort: a task keeps a file open for each of up to
    ``OPEN_PARTS`` parts that it meets, with small row groups, and sorts what comes after if there are more. Text keys are most of a part's bytes and
    halve under zstd."""
    keys = ("model", "iter", "fold")
    chosen = predictions.select(*keys, "row_id", "pred")
    writer = chosen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd")
    with setting(predictions.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_PARTS)):
        writer.partitionBy(*keys).parquet(path)


def read_predictions(spark: SparkSession, path: str, row_id: str = "bigint") -> DataFrame:
    """The prediction table; ``row_id`` is the type of its row key."""
    return spark.read.schema(PREDICTION_SCHEMA.replace("row_id bigint", f"row_id {row_id}")).parquet(path)


def write_per_model(predictions: DataFrame, path: str, id_col: str, target: str) -> None:
    """One folder of (id, target) rows per model."""
    chosen = predictions.select("model", F.col("row_id").alias(id_col), F.col("pred").alias(target))
    chosen.hint("rebalance", "model").write.partitionBy("model").option("header", True).csv(path)


# Text exports for outside programs.


def dense_lines(values: Column) -> Column:
    return S.dense_text(values)


def sparse_lines(label: Column, values: Column, digits: int = 6) -> Column:
    """``label idx:val idx:val``, zeros left out."""
    body = S.sparse_text(values, digits)
    head = F.format_string(f"%.{digits}f", label.cast("double"))
    return F.when(body == "", head).otherwise(F.concat(head, F.lit(" "), body))


def labelled_lines(label: Column, values: Column, digits: int = 6) -> Column:
    """``label,v1 v2 ...``"""
    return F.concat(F.format_string(f"%.{digits}f", label.cast("double")), F.lit(","), S.dense_text(values, digits))


def sign_lines(label: Column) -> Column:
    """``-1`` for label 0, ``+1`` for any other."""
    return F.when(label == 0, F.lit("-1")).otherwise(F.lit("+1"))


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


def round_trip(df: DataFrame, label: str, fmt: str = "parquet") -> DataFrame:
    """Write to a fresh folder and read back."""
    path = scratch_path(df.sparkSession, label)
    if fmt == "csv":
        write_csv(df, path)
        return read_csv(df.sparkSession, path, df.schema)
    df.write.format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


# Submissions: a folder per version, and a ledger that is written last.


def next_version(spark: SparkSession, root: str) -> int:
    try:
        ledger = spark.read.schema("version bigint, name string").parquet(f"{root}/ledger")
    except AnalysisException:
        return 1
    return (ledger.agg(F.max("version")).first()[0] or 0) + 1


def write_submission(predictions: DataFrame, root: str, name: str = "model_library", id_col: str = "Id", target: str = "Sales") -> int:
    """Write (id, target) as ``name@version`` and return the version.

    The ledger row follows the data, so a run that dies half way leaves no version behind.
    """
    spark = predictions.sparkSession
    version = next_version(spark, root)
    rows = predictions.select(F.col("row_id").alias(id_col), F.col("pred").alias(target))
    write_csv(rows, submission_path(root, name, version))
    ledger = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(name).alias("name"))
    ledger.write.mode("append").parquet(f"{root}/ledger")
    return version


def submission_path(root: str, name: str, version: int) -> str:
    return f"{root}/{name}@{version}"


def read_submission(spark: SparkSession, root: str, name: str, version: int, id_col: str = "Id", target: str = "Sales", key: str = "bigint") -> DataFrame:
    schema = T.StructType([T.StructField(id_col, T.StringType() if key == "string" else T.LongType()), T.StructField(target, T.DoubleType())])
    return read_csv(spark, submission_path(root, name, version), schema)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail when a row key occurs twice: every alignment in the library is by key."""
    repeats = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if repeats:
        raise ValueError(f"row key {list(keys)} is not unique: {repeats[0]}")
    return df
