"""Approximate nearest neighbours by product quantisation.

A vector is cut into ``PARTS`` stretches, and each stretch is replaced by the number of its nearest entry in a code book of at most
256 entries, learnt by k-means from a bounded sample: one byte a stretch. The codes of all references are written once.
A block of queries (``QUERY_ROWS``) is sent to the tasks, which scan the codes where they lie: the distance from a query to a
coded vector is the sum over the stretches of table entries, here one matrix product with the decoded block. Each task
keeps ``keep`` times k candidates per query; the best of all tasks are measured again on the vectors themselves.

What is read per query is the codes (a byte a stretch instead of four bytes a component) and ``keep`` times k vectors. How
many of the true neighbours are found depends on the data and is to be measured; pruning by cells needs structure, codes
do not.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.hashing import hash_hex
from foldwright.operators.neighbours import QUERY_ROWS, _found_schema, _ids, _key, _matrix, _skip_codes, query_blocks
from foldwright.session import materialise

PARTS, ENTRIES, SAMPLE_ROWS, ROUNDS = 16, 256, 16_384, 8
#: Candidates measured again, in multiples of k.
KEEP = 4
SLICE = 512


def code_books(sample: np.ndarray, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Per stretch its code book, by Lloyd's rounds from evenly spaced rows of the sample."""
    books = []
    for columns in np.array_split(np.arange(sample.shape[1]), parts):
        rows = sample[:, columns]
        book = np.unique(rows[np.linspace(0, len(rows) - 1, min(entries, len(rows))).astype(int)], axis=0)
        for _ in range(rounds):
            own = _entry(rows, book)
            total = np.stack([np.bincount(own, rows[:, c], len(book)) for c in range(rows.shape[1])], axis=1)
            n = np.bincount(own, minlength=len(book))
            book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
        books.append(book)
    return books


def _entry(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * rows @ book.T).argmin(axis=1)


def encode(vectors: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """A byte per stretch."""
    ends = np.cumsum([b.shape[1] for b in books])
    return np.stack([_entry(vectors[:, e - b.shape[1] : e], b) for e, b in zip(ends, books, strict=True)], axis=1).astype(np.uint8)


def decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([b[codes[:, s]] for s, b in enumerate(books)], axis=1)


def coded(refs: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(rid, code[, skip]) of refs (rid, v[, skip])."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = encode(_matrix(pdf["v"]), books) if len(pdf) else np.zeros((0, len(books)), np.uint8)
            yield pd.DataFrame({"rid": pdf["rid"], "code": [c.tobytes() for c in made], **({"skip": pdf["skip"]} if "skip" in pdf else {})})

    skip = ", skip int" if "skip" in refs.columns else ""
    return refs.mapInPandas(work, f"rid {refs.schema['rid'].dataType.simpleString()}, code binary{skip}")


def _scan(codes: DataFrame, block: pd.DataFrame, books: list[np.ndarray], keep: int, schema: str) -> DataFrame:
    """(qid, rid, d2): per task the ``keep`` references whose decoded vectors are nearest to each query of the block."""
    queries, qid, q_skip = _matrix(block["v"]), _ids(block["qid"]), _skip_codes(block, -1)
    q_norm = (queries * queries).sum(axis=1)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = np.full((len(queries), 0), np.inf)
        ids: np.ndarray | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            own = _ids(pdf["rid"])
            shown = decode(np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1), books)
            norm, r_skip = (shown * shown).sum(axis=1), _skip_codes(pdf, -2)
            take = min(keep, far.shape[1] + len(own))
            new_far, new_ids = np.empty((len(queries), take)), np.empty((len(queries), take), own.dtype if ids is None else np.result_type(own, ids))
            for low in range(0, len(queries), SLICE):
                part = slice(low, low + SLICE)
                d = q_norm[part, None] + norm - 2 * queries[part] @ shown.T
                d[q_skip[part, None] == r_skip[None, :]] = np.inf
                d = np.concatenate([far[part], d], axis=1)
                at = np.argpartition(d, take - 1, axis=1)[:, :take]
                new_far[part] = np.take_along_axis(d, at, 1)
                held = np.tile(own, (len(d), 1)) if ids is None else np.concatenate([ids[part], np.tile(own, (len(d), 1))], axis=1)
                new_ids[part] = np.take_along_axis(held, at, 1)
            far, ids = new_far, new_ids
        if ids is not None:
            row, col = np.nonzero(np.isfinite(far))
            told = lambda x: x.astype(object) if x.dtype.kind == "U" else x
            yield pd.DataFrame({"qid": told(qid[row]), "rid": told(ids[row, col]), "d2": far[row, col]})

    return codes.mapInPandas(work, schema)


def _measured(pairs: DataFrame, schema: str) -> DataFrame:
    """Squared distances of (qid, rid, qv, v)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(((a - b) ** 2).sum(axis=1), pa.float64())], names=["qid", "rid", "d2"])

    return pairs.select("qid", "rid", "qv", "v").mapInArrow(work, schema)


def knn_by_codes(
    queries: DataFrame, refs: DataFrame, k: int, query_id: str = "query_id", ref_id: str = "ref_id", vector: str = "vector",
    skip: str | None = None, keep: int = KEEP, parts: int = PARTS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Most of the ``k`` nearest references of every query, in the columns of ``knn_join``; distances are exact."""
    extra = [F.col(skip).cast("int").alias("skip")] if skip else []
    q = materialise(queries.select(_key(queries, query_id).alias("qid"), F.col(vector).cast("array<double>").alias("v"), *extra), "code-queries")
    r = materialise(refs.select(_key(refs, ref_id).alias("rid"), F.col(vector).cast("array<double>").alias("v"), *extra), "code-refs")
    schema = _found_schema(q, r)
    sample = _matrix(r.orderBy(hash_hex(29, F.col("rid")), "rid").limit(SAMPLE_ROWS).select("v").toPandas()["v"])
    if not len(sample):
        return q.sparkSession.createDataFrame([], f"{query_id} {q.schema['qid'].dataType.simpleString()}, {ref_id} {r.schema['rid'].dataType.simpleString()}, distance double, neighbour_rank bigint")
    books = code_books(sample, min(parts, sample.shape[1]))
    codes = materialise(coded(r, books), "codes")
    found = None
    for block in query_blocks(q, query_rows):
        likely = _scan(codes, block, books, keep * k, schema)
        nearest = Window.partitionBy("qid").orderBy("d2", "rid")
        likely = likely.withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= keep * k).select("qid", "rid")
        made = materialise(likely, "code-candidates")
        found = made if found is None else found.unionByName(made)
    pairs = found.join(r.select("rid", "v"), "rid").join(q.select("qid", F.col("v").alias("qv")), "qid")
    order = Window.partitionBy("qid").orderBy("d2", "rid")  # keep * k rows per query
    ranked = _measured(pairs, schema).withColumn("neighbour_rank", F.row_number().over(order)).filter(F.col("neighbour_rank") <= k)
    return ranked.select(F.col("qid").alias(query_id), F.col("rid").alias(ref_id), F.sqrt("d2").alias("distance"), F.col("neighbour_rank").cast("bigint").alias("neighbour_rank"))
