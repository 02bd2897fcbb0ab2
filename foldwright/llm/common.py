"""What the text operators share: the white space of the contracts, document columns, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
#: for Java's and Python's regular expressions alike
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null becomes empty), so that other columns can't clash with ours."""
    return df.select(df[id_col].cast("long").alias("doc_id"), empty_if_null(df[text_col]).alias("text"))


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores before it as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key() -> Column:
    """The identifier, or a hash of the text where that is null: such rows are not all drawn alike."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text"))


def drawn(key: Column, share: Column | float) -> Column:
    """Whether a 64-bit hash falls into a share of all hashes, down to one in 2^62."""
    whole = float(1 << 62)
    return key.bitwiseAND(F.lit((1 << 62) - 1)).cast("double") < F.least(F.lit(share) if isinstance(share, float) else share, F.lit(1.0)) * F.lit(whole)


def map_text(df: DataFrame, work: Callable[[list, list], dict], schema: str, chars: int = 2_000_000) -> DataFrame:
    """``work(ids, texts)`` over slices of at most ``chars`` bytes of text, or of one document.

    The slices bound what a task holds beside its input batch; a slice never changes a result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = texts.nbytes // max(1, len(texts))
            step = max(1, chars // max(1, sizes))
            for at in range(0, len(ids), step):
                made = work(ids[at : at + step], texts.slice(at, step).to_pylist())
                yield pa.RecordBatch.from_pydict(made, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)
