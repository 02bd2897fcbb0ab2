"""Line deduplication over documents that come and go.

State, in a shared folder, grows by whole batches and never changes in place:

* ``refs``: the exact reference table, one row per (key, document row) with sign +1 for an inserted and -1
  for a deleted document; sums over it are reference counts, so every insertion can be undone;
* ``manifest``: a row per update, written last: the batch of references, the common keys and filters that it left, whether
  anything was deleted so far. A state opened again goes on from the latest row; what a broken update wrote is not read.
* ``filters``: per shard of the key space a cuckoo filter of the keys that are common now. An update
  inserts keys that became common and deletes keys that ceased to be; a full filter is rebuilt from the
  exact table.

Cleaning sends the filters to the tasks while they are small (checked), so that lines which can't be common
never leave their task; the exact table confirms what is left. Larger filters are skipped and all long lines
go to the exact table, with the same result.

A line's key is the line without white space at both ends and with A-Z in lower case; it counts once per
document row. A common key's lines go, except in the largest doc_id holding it (a null doc_id is smaller
than any; rows sharing the largest doc_id all keep it). Keys are compared by 128-bit BLAKE2 digests.
Null or empty text is one empty line. Empty tables give no rows; other columns are passed on untouched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foldwright.llm.common import SPACE_BYTES, empty_if_null, free_names, map_text, text_of
from foldwright.llm.cuckoo import CuckooFilter, Full
from foldwright.session import scratch_path

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 15
#: Filters up to this size are sent to every task.
SEND_BYTES = 32 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
REFS = "k1 long, k2 long, doc_id long, sign int"
MANIFEST = "step long, batch string, shards long, reversed boolean"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a lower-cased line's key, or None for a short line."""
    key = line.strip(SPACE_BYTES)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def references(docs: DataFrame, min_chars: int = MIN_CHARS, sign: int = 1) -> DataFrame:
    """The long keys of every document row, each once per row."""

    def keys(ids: list, texts: list) -> dict:
        found: list[bytes] = []
        owners: list = []
        for doc, text in zip(ids, texts, strict=True):
            own = {line_key(x, min_chars) for x in text.encode().translate(_LOWER).split(b"\n")} - {None}
            found += own
            owners += [doc] * len(own)
        pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        return {"k1": pair[:, 0], "k2": pair[:, 1], "doc_id": pa.array(owners, pa.int64()), "sign": np.full(len(owners), sign, np.int32)}

    return map_text(docs, keys, REFS)


class LineDedup:
    """The state under ``folder``; ``shards`` is fixed when it is first written to."""

    def __init__(self, spark: SparkSession, folder: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.folder = spark, folder or scratch_path(spark, "line-dedup")
        self.min_chars, self.min_docs = min_chars, min_docs
        self.batches: list[str] = []
        self.shards = 0
        self.reversed = False  # whether any batch deletes
        self.filters: DataFrame | None = None
        self.common: DataFrame | None = None
        try:
            steps = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").orderBy("step").collect()  # a row per update
        except AnalysisException:  # nothing was written here yet
            steps = []
        for step in steps:
            self.batches.append(step["batch"])
            self.shards, self.reversed = step["shards"], step["reversed"]
        if steps:
            self._read(self.batches[-1])

    def _read(self, batch: str) -> None:
        self.common, self.filters = (self.spark.read.parquet(f"{self.folder}/{kind}/{batch}") for kind in ("common", "filters"))

    @property
    def shard(self) -> Column:
        return F.pmod(F.xxhash64("k2"), F.lit(self.shards)).alias("shard")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineDedup:
        return self._add(text_of(docs, id_col, text_col), 1)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineDedup:
        """Take back documents that were inserted, given with the same identifier and text."""
        return self._add(text_of(docs, id_col, text_col), -1)

    def refs(self) -> DataFrame:
        return self.spark.read.schema(REFS).parquet(*[f"{self.folder}/refs/{b}" for b in self.batches])

    def counts(self) -> DataFrame:
        """Per key the number of documents holding it and the largest of them."""
        refs = self.refs()
        if self.reversed:
            refs = refs.groupBy("k1", "k2", "doc_id").agg(F.sum("sign").alias("sign")).where("sign > 0")
        return refs.groupBy("k1", "k2").agg(F.sum("sign").alias("n"), F.max("doc_id").alias("last"))

    def _add(self, docs: DataFrame, sign: int) -> LineDedup:
        batch = uuid.uuid4().hex
        references(docs, self.min_chars, sign).write.parquet(f"{self.folder}/refs/{batch}")
        self.batches, self.reversed = [*self.batches, batch], self.reversed or sign < 0
        path = f"{self.folder}/common/{batch}"
        self.counts().where(F.col("n") >= self.min_docs).drop("n").write.parquet(path)
        before, self.common = self.common, self.spark.read.parquet(path)
        if self.filters is None:
            self.shards = 1 + self.common.count() // SHARD_KEYS
            made = self.common.select(self.shard, "k1").groupBy("shard").applyInPandas(_build, "shard long, filter binary")
        else:
            keys = ["k1", "k2"]
            risen = self.common.join(before, keys, "left_anti").select(self.shard, "k1", F.lit(1).alias("sign"))
            fallen = before.join(self.common, keys, "left_anti").select(self.shard, "k1", F.lit(-1).alias("sign"))
            now = self.common.select(self.shard, "k1", F.lit(0).alias("sign"))
            change = risen.union(fallen).union(now)
            made = change.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_update, "shard long, filter binary")
        made.write.parquet(f"{self.folder}/filters/{batch}")
        told = self.spark.createDataFrame([(len(self.batches), batch, self.shards, self.reversed)], MANIFEST)
        told.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self._read(batch)
        return self

    def _candidates(self) -> DataFrame:
        """References whose key the filters hold."""
        refs = self.refs().select("k1", "k2", "doc_id", self.shard)
        size = self.filters.select(F.sum(F.length("filter"))).first()[0] or 0
        if size > SEND_BYTES:
            return refs
        sent = self.spark.sparkContext.broadcast({r.shard: bytes(r["filter"]) for r in self.filters.toLocalIterator()})

        def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
            for batch in batches:
                k1, shard = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                held = np.zeros(len(k1), bool)
                for s in np.unique(shard).tolist():
                    if s in filters:
                        at = shard == s
                        held[at] = filters[s].contains(k1[at])
                yield batch.filter(pa.array(held))

        return refs.mapInArrow(probe, refs.schema)

    def dropped(self) -> DataFrame:
        """Per document the digests of the keys whose lines it loses: doc_id, gone."""
        refs = self._candidates().drop("shard").join(self.common, ["k1", "k2"])
        gone = refs.where(~F.col("doc_id").eqNullSafe(F.col("last")))
        return gone.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("gone"))

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
        """``docs`` with ``text_col`` rewritten and, with ``counts``, the columns n_lines and n_dropped added (or replaced).

        Rows without a dropped line keep their text as it is.
        """
        if counts:
            docs = docs.drop("n_lines", "n_dropped")
        gone_id, gone_keys = free_names(docs, "_gone_id", "_gone")
        gone = self.dropped().toDF(gone_id, gone_keys)
        joined = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone[gone_id]), "left").drop(gone_id)
        names = joined.columns
        at_text, at_gone, min_chars = names.index(text_col), names.index(gone_keys), self.min_chars
        schema = StructType([*docs.schema.fields, *([StructField(c, LongType()) for c in ("n_lines", "n_dropped")] if counts else [])])

        def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, total, lost = [], [], []
                for text, keys in zip(batch.column(at_text), batch.column(at_gone), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    total.append(raw.count(b"\n") + 1)
                    if keys.is_valid:
                        drop = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys.as_py()}
                        lines = raw.split(b"\n")
                        lower = raw.translate(_LOWER).split(b"\n")
                        kept = [a for a, b in zip(lines, lower, strict=True) if line_key(b, min_chars) not in drop]
                        lost.append(len(lines) - len(kept))
                        texts.append(b"\n".join(kept))
                    else:
                        lost.append(0)
                        texts.append(raw if text.is_valid else None)
                columns = [c for i, c in enumerate(batch.columns) if i != at_gone]
                columns[at_text] = pa.array(texts, pa.binary()).cast(pa.string())
                if counts:
                    columns += [pa.array(total, pa.int64()), pa.array(lost, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return joined.mapInArrow(rewrite, schema)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": rows["shard"][:1], "filter": [CuckooFilter.of(rows["k1"].to_numpy()).to_bytes()]})


def _update(change: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after keys rose (1) and fell (-1); sign 0 rows are all its keys, for a rebuild."""
    if not len(change):
        return old
    keys = {s: change.loc[change["sign"] == s, "k1"].to_numpy() for s in (-1, 0, 1)}
    try:
        if not len(old):
            raise Full
        made = CuckooFilter.from_bytes(old["filter"].iloc[0])
        for k in keys[-1].tolist():
            made.delete(k)
        for k in keys[1].tolist():
            made.insert(k)
    except Full:
        made = CuckooFilter.of(keys[0])
    return pd.DataFrame({"shard": change["shard"][:1], "filter": [made.to_bytes()]})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, counts: bool = True) -> DataFrame:
    """One batch: insert all documents, then clean them."""
    return LineDedup(docs.sparkSession, folder).insert(docs, id_col, text_col).clean(docs, id_col, text_col, counts)


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the registered query: counts and the digest of each cleaned text."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(empty_if_null(F.col("text")), 256).alias("kept_sha256"))
