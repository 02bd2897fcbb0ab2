"""Exact deduplication as a stateful stream.

A stream of documents keeps, per digest of the normalised text, how many rows were seen and which of them
stays: its identifier and where its content lies (file and row). The state lives in RocksDB on the
executors' disks and in the checkpoint folder, and never expires; a restart from the same folder goes on
with it. Every digest that was hit more than once is then checked on the full normalised bytes.

Defined results: a null text counts as empty, so null, empty and all-white texts are one group. Of equal
texts the row with the most code points stays, then the smallest doc_id (null last), then the first in
file order, so of fully repeated rows exactly one is kept. Empty tables give no rows. Columns other than
the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import SPACE_BYTES, empty_if_null
from foldwright.session import materialise, scratch_path

MEMBER = "doc_id long, file string, row long, n_chars long, sha binary, digest binary"
#: Digests whose hits are picked out by a broadcast of 8 bytes each; more are picked by a shuffle.
SEND_DIGESTS = 1_000_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else every one of many small partitions reserves megabytes of disk ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "150",
}


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, with_text: bool = False) -> DataFrame:
    """One row per document: identifier, content locator, length and digest of the text without white space."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, files, rows = batch.columns
            plain = [t.as_buffer().to_pybytes().translate(None, SPACE_BYTES) for t in texts]
            sha = [hashlib.sha256(t).digest() for t in plain]
            columns = {
                "doc_id": ids, "file": files, "row": rows, "n_chars": pc.utf8_length(texts).cast("int64"),
                "sha": pa.array(sha, pa.binary()), "digest": pa.array([s[:digest_bytes] for s in sha], pa.binary()),
            }
            if with_text:
                columns["plain"] = pa.array(plain, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    located = docs.select(
        docs[id_col].cast("long"), empty_if_null(docs[text_col]), F.col("_metadata.file_path"), F.col("_metadata.row_index")
    ).toDF("doc_id", "text", "file", "row")
    return located.mapInArrow(digest, MEMBER + (", plain binary" if with_text else ""))


def best() -> F.Column:
    """The row that stays, as the smallest of these."""
    return F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "file", "row"))


def seen(stream: DataFrame, folder: str, **options) -> DataFrame:
    """Feed all that is available of ``stream`` into the state under ``folder``; return the state's groups.

    Partial sums are made before the exchange, so a digest with a third of all rows sends one row per task.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        groups = members(stream, **options).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best().alias("best"))
        query = (
            groups.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .foreachBatch(lambda changed, number: changed.write.mode("overwrite").parquet(f"{folder}/changed/batch={number}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = groups.schema
    history = spark.read.schema(schema).option("basePath", f"{folder}/changed").parquet(f"{folder}/changed/*")
    # counts only grow, so a digest's largest count is its latest state
    return history.groupBy("digest").agg(F.max(F.struct("n", "best")).alias("s")).select("digest", "s.n", "s.best")


def exact_dedup(spark: SparkSession, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, files_per_batch: int = 1000) -> DataFrame:
    """Decisions for every row of the parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256."""
    folder = folder or scratch_path(spark, "exact-dedup")
    docs = spark.read.parquet(path)
    options = {"id_col": id_col, "text_col": text_col, "digest_bytes": digest_bytes}
    # as a pattern, the path may name a folder or a single file
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    # the state stays under its folder; what is read off it belongs to this call
    groups = materialise(seen(stream, folder, **options), "exact-groups")
    rows = members(docs, **options)

    hit = groups.where("n > 1").select("digest")
    texts = members(docs, **options, with_text=True)
    some = hit.limit(SEND_DIGESTS + 1).count() <= SEND_DIGESTS
    texts = texts.join(F.broadcast(hit) if some else hit, "digest", "left_semi")
    # copies meet as two equal strings per task, not as rows of a group
    spans = texts.groupBy("digest").agg(F.min("plain").alias("a"), F.max("plain").alias("b"))
    clash = materialise(spans.where("a <> b").select("digest"), "exact-clash")

    out = rows.join(groups, "digest")
    if not clash.isEmpty():  # different texts of one digest: the bytes decide
        odd = texts.join(clash, "digest", "left_semi")
        exact = odd.groupBy("digest", "plain").agg(F.count(F.lit(1)).alias("n"), best().alias("best"))
        out = out.join(clash, "digest", "left_anti").unionByName(odd.join(exact, ["digest", "plain"]).drop("plain"))
    kept = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
