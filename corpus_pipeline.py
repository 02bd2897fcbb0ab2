"""From raw documents to tokens: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents;
``n_chars``, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm import bpe, line_dedup, mixing, quality, simhash
from foldwright.llm.common import documents, empty_if_null
from foldwright.session import materialise


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length(empty_if_null(F.col("text"))).cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go, except in the last document."""
    return _counted(line_dedup.dedup_lines(docs, counts=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as their source's quota takes them."""
    return _counted(mixing.mixed_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row that is left."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("byte-level bpe", tokens),
]

#: Fingerprints and tokens can't be expressed in SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
