"""The library's input frames as views of the given star-schema tables.

``train`` / ``test`` are the order facts, ``store`` the customer dimension, ``items`` the order lines
with their part, ``docs`` the documents with their labels, ``vectors`` the embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def train(spark: SparkSession, folder: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    day = F.col("o_orderdate").cast("date")
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("store"),
        day.cast("string").alias("date_text"),
        (F.weekday(day) + 1).alias("day_of_week"),
        F.col("o_totalprice").alias("sales"),
        F.when(status == "P", F.lit(0)).when(status == "O", F.lit(1)).alias("open"),
        (priority == "1-URGENT").cast("int").alias("promo"),
        (priority == "2-HIGH").cast("int").alias("school_holiday"),
        F.when(priority == "3-MEDIUM", F.lit("a"))
        .when(priority == "4-NOT SPECIFIED", F.lit("b"))
        .when(priority == "5-LOW", F.lit("c"))
        .otherwise(F.lit("0"))
        .alias("state_holiday"),
        priority.alias("stratum"),
    )


def test(spark: SparkSession, folder: str) -> DataFrame:
    """The same facts seen as test rows: an ``id`` and no target."""
    return train(spark, folder).withColumnRenamed("row_id", "id").drop("sales", "stratum")


def store(spark: SparkSession, folder: str) -> DataFrame:
    segment, balance, nation = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey")
    known = balance >= 0
    promo2 = nation % 2
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("store"),
        F.when(segment == "AUTOMOBILE", F.lit("a"))
        .when(segment == "BUILDING", F.lit("b"))
        .when(segment == "FURNITURE", F.lit("c"))
        .when(segment == "HOUSEHOLD", F.lit("d"))
        .alias("store_type"),
        F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), nation % 3).alias("assortment"),
        F.when(known, balance).alias("competition_distance"),
        F.when(known, (nation % 12 + 1).cast("double")).alias("competition_month"),
        F.when(known, (nation + 1990).cast("double")).alias("competition_year"),
        promo2.alias("promo2"),
        F.when(promo2 == 1, (nation + 1).cast("double")).alias("promo2_week"),
        F.when(promo2 == 1, (nation + 2000).cast("double")).alias("promo2_year"),
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Modelling frame: target ``y``, one numeric feature ``x``, two categories."""
    balance = F.col("c_acctbal")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("y"),
        F.col("o_orderpriority").alias("stratum"),
    )
    customers = table(spark, folder, "customer").select("c_custkey", balance.alias("x"), F.col("c_mktsegment").alias("kind"))
    return orders.join(customers, "c_custkey").select("row_id", "y", "x", "kind", "stratum")


ITEM_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with part features. No id combination is unique, so the key is a hash of all of
    them and the price in cents."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    lines = table(spark, folder, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], cents.cast("string")))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        key.alias("row_id"), F.col("l_extendedprice").alias("y"), F.col("l_returnflag").alias("stratum"), *ITEM_FEATURES
    )


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; unlabelled documents have nulls."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "lang", "source", "n_chars")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    return documents.join(labels, "row_id", "left")


def labelled_docs(spark: SparkSession, folder: str, target: str = "quality") -> DataFrame:
    """Labelled documents only: binary ``y``, a score from the length, the source as category."""
    frame = docs(spark, folder).filter(F.col(target).isNotNull())
    length = F.col("n_chars").cast("double")
    return frame.select(
        "row_id",
        F.col(target).cast("double").alias("y"),
        F.col(target).cast("string").alias("stratum"),
        (length / (length + F.lit(1000.0))).alias("length_score"),
        F.log1p(length).alias("log_chars"),
        "lang",
        "source",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label"
    )


def vector_folds(spark: SparkSession, folder: str, k: int = 3) -> DataFrame:
    from foldwright.operators.folds import store_folds, stratified_folds

    rows = vectors(spark, folder).withColumn("stratum", F.col("label").cast("string"))
    return store_folds(stratified_folds(rows, "stratum", k, 1))


