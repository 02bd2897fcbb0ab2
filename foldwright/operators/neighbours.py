"""k-nearest-neighbour join, exact or by the nearest cells, and what is built on it: regression,
classification, mean-target features and oversampling.

Small reference side (rows and bytes checked): it is sent to the tasks and queries are scanned once.

Few queries (``SCANNED_QUERIES``): blocks of them are sent to the tasks, which scan the references where they lie and
keep k per query. No reference moves, whatever the structure of the vectors.

Otherwise both sides are cut into cells around pivot vectors, whose number grows with the square root of
the references. A first pass compares each query with one block of each of the nearest cells of its chunk, which bounds
its k-th distance; the triangle inequality then rules out cells that cannot hold anything closer. Chunks hold queries of
one cell, which ask for much the same blocks. The blocks that a chunk asks for come to it one after the other: a task
holds the queries of one chunk, their k nearest references so far and one batch, and emits k rows per query, whatever
the number of blocks. Where chunks ask for much of the references, queries are sent to the references instead.

Pruning lives on structure: among vectors that spread evenly over dozens of dimensions all distances are
alike, no cell can be ruled out, and an exact join compares everything. ``probes`` then looks into that many
nearest cells only; how many of the true neighbours it finds is to be measured on the data at hand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.hashing import hash_hex, hash_uniform
from foldwright.session import materialise

BLOCK_ROWS = 4096
BLOCK_BYTES = 1 << 26
CHUNK_ROWS = 16_384
SLICE = 512
#: Queries sent to the tasks at once, and up to which references are scanned rather than cut into cells.
QUERY_ROWS, SCANNED_QUERIES = 8192, 65_536
#: Distances from rows to pivots that a task holds at once.
GAPS = 1 << 22
MARGIN = 16
FIRST_CELLS = 3
#: Share of the references beyond which cells rule out too little to send references to chunks of queries.
CROWDED = 0.3
RELATIVE_SLACK = 1e-9
#: Components of the pairs of a slice that are under their limits, up to which they are measured without an ordering of all.
FEW_CELLS = 1 << 21


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _ids(column: pd.Series) -> np.ndarray:
    """Whole numbers, or text in an array that sorts by code points."""
    return np.array(column.tolist(), dtype=str) if column.dtype == object else column.to_numpy()


def _nearest(
    q: np.ndarray, q_skip: np.ndarray, r: np.ndarray, r_skip: np.ndarray, r_id: np.ndarray, k: int, limit: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of queries: query positions, reference positions and squared distances of (at least) the k nearest
    references not above ``limit``.

    A matrix product narrows the field; survivors are measured again by direct differences, so
    distances do not suffer from the cancellation in |q|^2 + |r|^2 - 2qr.
    """
    r_norm = (r * r).sum(axis=1)
    few = min(len(r), k + MARGIN)
    for start in range(0, len(q), SLICE):
        part = q[start : start + SLICE]
        q_norm = (part * part).sum(axis=1)
        rough = q_norm[:, None] + r_norm[None, :] - 2.0 * (part @ r.T)
        rough[q_skip[start : start + SLICE, None] == r_skip[None, :]] = np.inf
        own = limit[start : start + SLICE]
        if len(r) > k and np.isfinite(own).all():
            slack = RELATIVE_SLACK * (q_norm + r_norm.max())
            rows, cols = np.nonzero(rough <= (own + slack)[:, None])
            if len(rows) * r.shape[1] <= FEW_CELLS:  # few are left: no ordering of all
                diff = r[cols] - part[rows]
                yield start + rows, cols, (diff * diff).sum(axis=1)
                continue
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(r) > k else np.full(len(part), np.inf)
        slack = RELATIVE_SLACK * (q_norm + (r_norm.max() if len(r_norm) else 0.0))
        near = (rough <= (np.minimum(kth, limit[start : start + SLICE]) + slack)[:, None]) & np.isfinite(rough)
        crowded = near.sum(axis=1) > few  # more near ties than the margin holds
        at = np.argpartition(rough, few - 1, axis=1)[:, :few] if few < len(r) else np.tile(np.arange(len(r)), (len(part), 1))
        diff = r[at] - part[:, None, :]
        exact = np.where(np.take_along_axis(near, at, 1), (diff * diff).sum(axis=2), np.inf)
        exact[crowded] = np.inf
        order = np.lexsort((r_id[at], exact), axis=1)[:, :k]
        at, exact = np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)
        rows, cols = np.nonzero(np.isfinite(exact))
        yield start + rows, at[rows, cols], exact[rows, cols]
        for row in np.flatnonzero(crowded):
            tied = np.flatnonzero(near[row])
            diff = r[tied] - part[row]
            d2 = (diff * diff).sum(axis=1)
            best = np.lexsort((r_id[tied], d2))[:k]
            yield np.full(len(best), start + row), tied[best], d2[best]


def _skip_codes(pdf: pd.DataFrame, absent: int) -> np.ndarray:
    return pdf["skip"].to_numpy() if "skip" in pdf else np.full(len(pdf), absent)


def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    query_id: str = "query_id",
    ref_id: str = "ref_id",
    vector: str = "vector",
    skip: str | None = None,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    probes: int | float | None = None,
    scanned: int | None = SCANNED_QUERIES,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` nearest references of every query: (query_id, ref_id, distance, neighbour_rank).

    Ids are whole numbers or text. ``skip`` names an integer column on both sides; a pair with equal values is
    left out (for out-of-fold use: the fold). Equal distances are ordered by ``ref_id``. With ``probes`` a
    reference side that is cut into cells is searched in that many nearest cells only (below 1: that share of the
    cells), which may miss some. Up to ``scanned`` queries (None: any number) go to the references by scan.
    """
    extra = [F.col(skip).cast("int").alias("skip")] if skip else []
    q = queries.select(_key(queries, query_id).alias("qid"), F.col(vector).cast("array<double>").alias("v"), *extra)
    r = refs.select(_key(refs, ref_id).alias("rid"), F.col(vector).cast("array<double>").alias("v"), *extra)
    start = r.limit(block_rows + 1)
    size = start.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("v") * 8).alias("bytes")).first()
    if size["rows"] <= block_rows and (size["bytes"] or 0) <= BLOCK_BYTES:
        found = _join_with_sent_block(q, start.toPandas(), k)
    elif not probes and (scanned is None or q.limit(scanned + 1).count() <= scanned):
        found = _join_by_scan(q, r, k, query_rows)
    else:
        found = _join_by_blocks(q, r, k, block_rows, chunk_rows, probes, query_rows if scanned else 0)
    order = Window.partitionBy("qid").orderBy("d2", "rid")  # k rows per visited block
    ranked = found.withColumn("neighbour_rank", F.row_number().over(order)).filter(F.col("neighbour_rank") <= k)
    return ranked.select(
        F.col("qid").alias(query_id),
        F.col("rid").alias(ref_id),
        F.sqrt("d2").alias("distance"),
        F.col("neighbour_rank").cast("bigint").alias("neighbour_rank"),
    )


def _key(df: DataFrame, name: str) -> Column:
    return F.col(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name).cast("bigint")


def _found_schema(q: DataFrame, r: DataFrame) -> str:
    return f"qid {q.schema['qid'].dataType.simpleString()}, rid {r.schema['rid'].dataType.simpleString()}, d2 double"


def _join_with_sent_block(q: DataFrame, refs: pd.DataFrame, k: int) -> DataFrame:
    block, block_id, block_skip = _matrix(refs["v"]), _ids(refs["rid"]), _skip_codes(refs, -2)
    rid = "string" if block_id.dtype.kind == "U" else "bigint"

    def scan(batches):
        for pdf in batches:
            yield _pairs(pdf, block, block_id, block_skip, k, np.full(len(pdf), np.inf))

    return q.mapInPandas(scan, f"qid {q.schema['qid'].dataType.simpleString()}, rid {rid}, d2 double")


def query_blocks(q: DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    """The queries in blocks of about ``rows``, by a hash of the identifier."""
    q = materialise(q, "knn-queries")
    n = max(1, -(-q.count() // rows))
    for block in range(n):
        some = q if n == 1 else q.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == block)
        yield some.toPandas()


class _Held:
    """The ``k`` nearest references that a block of queries has met so far, none beyond a query's ``limit`` (squared)."""

    def __init__(self, vectors: np.ndarray, skip: np.ndarray, k: int, limit: np.ndarray):
        self.vectors, self.skip, self.k, self.limit = vectors, skip, k, limit.copy()
        self.at, self.ids, self.d2 = np.zeros(0, int), None, np.zeros(0)

    def meet(self, r: np.ndarray, r_skip: np.ndarray, r_id: np.ndarray) -> None:
        met = list(_nearest(self.vectors, self.skip, r, r_skip, r_id, self.k, self.limit))
        rows, near, far = (np.concatenate(parts) for parts in zip(*met, strict=True))
        if not len(rows):
            return
        new = np.zeros(len(self.vectors), bool)
        new[rows] = True
        again = new[self.at]  # the others stay as they are
        at, d2 = np.concatenate([self.at[again], rows]), np.concatenate([self.d2[again], far])
        ids = r_id[near] if self.ids is None else np.concatenate([self.ids[again], r_id[near]])
        order = np.lexsort((ids, d2, at))
        at, ids, d2 = at[order], ids[order], d2[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, ids, d2, place = (x[place < self.k] for x in (at, ids, d2, place))
        self.limit[at[place == self.k - 1]] = d2[place == self.k - 1]
        self.ids = ids if self.ids is None else np.concatenate([self.ids[~again], ids])
        self.at, self.d2 = np.concatenate([self.at[~again], at]), np.concatenate([self.d2[~again], d2])


def _join_by_scan(q: DataFrame, r: DataFrame, k: int, query_rows: int) -> DataFrame:
    """Queries go to the references: a task scans its references and emits k rows per query, of which k are stored."""
    schema, found = _found_schema(q, r), None
    nearest = Window.partitionBy("qid").orderBy("d2", "rid")
    for block in query_blocks(q, query_rows):
        vectors, qid, q_skip = _matrix(block["v"]), _ids(block["qid"]), _skip_codes(block, -1)

        def scan(batches, vectors=vectors, qid=qid, q_skip=q_skip):
            held = _Held(vectors, q_skip, k, np.full(len(vectors), np.inf))
            for pdf in batches:
                if len(pdf):
                    held.meet(_matrix(pdf["v"]), _skip_codes(pdf, -2), _ids(pdf["rid"]))
            if held.ids is not None:
                told = lambda x: x.astype(object) if x.dtype.kind == "U" else x
                yield pd.DataFrame({"qid": told(qid[held.at]), "rid": told(held.ids), "d2": held.d2})

        if len(block):
            met = r.mapInPandas(scan, schema).withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= k).drop("_n")
            made = materialise(met, "knn-scanned")
            found = made if found is None else found.unionByName(made)
    return found if found is not None else q.sparkSession.createDataFrame([], schema)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(chunk, side, rows) of a batch that is sorted by both."""
    chunk, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "side"))
    cuts = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)], strict=True):
        if high > low:
            yield int(chunk[low]), int(side[low]), batch.slice(low, high - low)


def _arrow_ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=str) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def _arrow_told(ids: np.ndarray) -> pa.Array:
    if ids.dtype.kind == "f":  # with nulls
        return pa.array(np.where(np.isnan(ids), 0, ids).astype(np.int64), mask=np.isnan(ids))
    return pa.array(ids.tolist(), pa.string()) if ids.dtype.kind == "U" else pa.array(ids)


def _arrow_skip(batch: pa.RecordBatch, absent: int) -> np.ndarray:
    if "skip" not in batch.schema.names:
        return np.full(batch.num_rows, absent)
    return batch.column("skip").to_numpy(zero_copy_only=False)


def _pairs(pdf, block, block_id, block_skip, k, limit) -> pd.DataFrame:
    rows, near, d2 = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if len(pdf) and len(block):
        found = list(_nearest(_matrix(pdf["v"]), _skip_codes(pdf, -1), block, block_skip, block_id, k, limit))
        rows, near, d2 = (np.concatenate(parts) for parts in zip(*found, strict=True))
    rid = block_id[near]
    return pd.DataFrame({"qid": pdf["qid"].to_numpy()[rows], "rid": rid.astype(object) if rid.dtype.kind == "U" else rid, "d2": d2})


def _pivot_gaps(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to all pivots, by direct differences."""
    return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _rows_at_once(pivots: np.ndarray) -> int:
    return max(1, min(SLICE, GAPS // len(pivots)))


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""

    @F.pandas_udf("struct<cell:int,dist:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        cells, dists = np.zeros(len(v), "int32"), np.zeros(len(v))
        step = _rows_at_once(pivots)
        for start in range(0, len(v), step):
            gaps = _pivot_gaps(_matrix(v[start : start + step]), pivots)
            cells[start : start + step], dists[start : start + step] = gaps.argmin(axis=1), gaps.min(axis=1)
        return pd.DataFrame({"cell": cells, "dist": dists})

    return df.withColumn("_p", place("v")).select(*df.columns, "_p.*")


class _Pieces:
    """How many pieces every cell is cut into, and the number of its first piece."""

    def __init__(self, rows_per_cell: np.ndarray, most: int):
        self.n = -(-rows_per_cell // most)
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]])

    def of(self, cell: str, key: str) -> Column:
        first, n = self.first, np.maximum(self.n, 1)
        piece = F.pandas_udf(lambda c, h: pd.Series(first[c.to_numpy()] + h.to_numpy() % n[c.to_numpy()]), "bigint")
        return piece(F.col(cell), F.xxhash64(key))


def _rows_per_cell(placed: DataFrame, n_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, smallest and largest pivot distance of every cell: one row per pivot."""
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).toPandas()
    n, lo, hi = np.zeros(n_cells, int), np.full(n_cells, np.inf), np.full(n_cells, -np.inf)
    at = cells["cell"].to_numpy()
    n[at], lo[at], hi[at] = cells["n"], cells["lo"], cells["hi"]
    return n, lo, hi


def _join_by_blocks(q: DataFrame, r: DataFrame, k: int, block_rows: int, chunk_rows: int, probes: int | float | None, query_rows: int = 0) -> DataFrame:
    """By cells. With ``query_rows`` queries whose chunks ask for more than ``CROWDED`` of the references go by scan instead."""
    # pivots: the references first in hash order; 10^12 references have 62,500 of them
    n_pivots = max(2, round((r.count() / block_rows) ** 0.5 * 4))
    pivots = _matrix(r.orderBy(hash_hex(17, F.col("rid")), "rid").limit(n_pivots).toPandas()["v"])
    placed_refs = materialise(_with_cell(r, pivots), "knn-refs")
    placed = materialise(_with_cell(q, pivots), "knn-queries")
    n_refs, lo, hi = _rows_per_cell(placed_refs, len(pivots))
    blocks = _Pieces(n_refs, block_rows)
    chunks = _Pieces(_rows_per_cell(placed, len(pivots))[0], chunk_rows)
    first, n_blocks = blocks.first, blocks.n
    blocked = materialise(placed_refs.withColumn("block", blocks.of("cell", "rid")).drop("cell", "dist"), "knn-blocks")
    base = [*q.columns, "chunk"]
    asking = placed.withColumn("chunk", chunks.of("cell", "qid"))
    n_chunks = max(1, int(chunks.n.sum()))
    schema = _found_schema(q, r)

    def match(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _pairs(left, _matrix(right["v"]), _ids(right["rid"]), _skip_codes(right, -2), k, left["bound"].to_numpy())

    def meet(asked: DataFrame) -> DataFrame:
        """``asked`` has the list ``blocks`` of every query. A reference block is sent only to the chunks that ask for it."""
        asked = materialise(asked, "knn-asked").select(*base, "bound", F.explode("blocks").alias("block"))
        wanted = asked.select(F.col("block").alias("block"), F.col("chunk").alias("to_chunk")).distinct()
        sent = blocked.join(wanted, "block").withColumnRenamed("block", "to_block")
        return asked.groupBy("block", "chunk").cogroup(sent.groupBy("to_block", "to_chunk")).applyInPandas(match, schema)

    def nearest_cells(gaps: np.ndarray, count: int) -> np.ndarray:
        """Which cells are the nearest ``count`` that hold references."""
        gaps = np.where(n_blocks[None, :] > 0, gaps, np.inf)
        if count >= gaps.shape[1]:
            return np.isfinite(gaps)
        return (gaps <= np.partition(gaps, count - 1, axis=1)[:, count - 1 : count]) & np.isfinite(gaps)

    def all_blocks(visit: np.ndarray) -> list[list[int]]:
        return [[b for c in np.flatnonzero(row) for b in range(first[c], first[c] + n_blocks[c])] for row in visit]

    def sliced(work, v: pd.Series, *others: pd.Series) -> pd.Series:
        out = []
        step = _rows_at_once(pivots)
        for start in range(0, len(v), step):
            rows = _matrix(v[start : start + step])
            out += work(rows, _pivot_gaps(rows, pivots), *[o[start : start + step].to_numpy() for o in others])
        return pd.Series(out, dtype=object)

    no_bound = F.lit(float("inf")).alias("bound")
    if probes:
        probes = max(1, round(probes * len(pivots))) if probes < 1 else int(probes)
        probed = F.pandas_udf(lambda v: sliced(lambda rows, gaps: all_blocks(nearest_cells(gaps, probes)), v), "array<bigint>")
        return meet(asking.select(*base, no_bound, probed("v").alias("blocks")))

    def stream(asked: DataFrame, wanted: DataFrame, work, schema: str) -> DataFrame:
        """``work(queries, blocks)`` per chunk: ``asked`` has its queries, ``blocks`` are batches of references, which come to the
        chunk one after the other."""
        side = [c for c in ("rid", "v", "skip") if c in r.columns]
        refs = blocked.join(wanted, "block").select("chunk", F.lit(1).cast("byte").alias("side"), F.lit(None).cast(q.schema["qid"].dataType).alias("qid"), F.lit(None).cast("int").alias("cell"), F.lit(None).cast("double").alias("bound"), *side)
        asks = asked.select("chunk", F.lit(0).cast("byte").alias("side"), "qid", "cell", "bound", F.lit(None).cast(r.schema["rid"].dataType).alias("rid"), *side[1:])
        both = asks.unionByName(refs).repartition(min(2 * n_chunks, 10_000), "chunk").sortWithinPartitions("chunk", "side")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = (piece for batch in batches for piece in _runs(batch))
            for _, own in groupby(pieces, lambda p: p[0]):
                queries, later = [], None
                for _, kind, rows in own:
                    if kind:
                        later = rows
                        break
                    queries.append(rows)
                if queries:
                    blocks = chain([] if later is None else [later], (rows for _, _, rows in own))
                    yield work(pa.Table.from_batches(queries).combine_chunks().to_batches()[0], blocks)

        return both.mapInArrow(run, schema)

    def held_by(queries: pa.RecordBatch, blocks: Iterable[pa.RecordBatch], limit: np.ndarray) -> _Held:
        held = _Held(_matrix(queries.column("v").to_pandas()), _arrow_skip(queries, -1), k, limit)
        for block in blocks:
            held.meet(_matrix(block.column("v").to_pandas()), _arrow_skip(block, -2), _arrow_ids(block.column("rid")))
        return held

    def first_bounds(queries: pa.RecordBatch, blocks: Iterable[pa.RecordBatch]) -> pa.RecordBatch:
        """The queries with their k-th distance so far; infinite when fewer were found."""
        limit = held_by(queries, blocks, np.full(queries.num_rows, np.inf)).limit
        return pa.RecordBatch.from_arrays([queries.column(c) if c != "bound" else pa.array(limit, pa.float64()) for c in columns], names=columns)

    def nearest(queries: pa.RecordBatch, blocks: Iterable[pa.RecordBatch]) -> pa.RecordBatch:
        held = held_by(queries, blocks, queries.column("bound").to_numpy(zero_copy_only=False))
        rid = pa.array([], pa.int64()) if held.ids is None else _arrow_told(held.ids)
        told = [queries.column("qid").take(pa.array(held.at)), rid.cast(rid_type), pa.array(held.d2, pa.float64())]
        return pa.RecordBatch.from_arrays(told, names=["qid", "rid", "d2"])

    def asked_cells(asked: DataFrame, pick) -> DataFrame:
        """(chunk, of), once each: the cells that ``pick(rows, gaps, cell, bound)`` has a chunk visit."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: set[int] = set()
            step = _rows_at_once(pivots)
            for batch in batches:
                for low in range(0, batch.num_rows, step):
                    part = batch.slice(low, step)
                    rows = _matrix(part.column("v").to_pandas())
                    chunk, cell, bound = (part.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "cell", "bound"))
                    visit = pick(rows, _pivot_gaps(rows, pivots), cell, bound)
                    at, cells = np.nonzero(visit)
                    known.update(np.unique(chunk[at] * len(pivots) + cells).tolist())
            told = np.array(sorted(known), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(told // len(pivots)), pa.array(told % len(pivots))], names=["chunk", "of"])

        return asked.select("v", "chunk", "cell", "bound").mapInArrow(run, "chunk long, of long").distinct()

    blocks_of = F.udf(lambda c: list(range(int(first[c]), int(first[c] + n_blocks[c]))), "array<bigint>")
    one_of = F.udf(lambda chunk, c: [int(first[c] + chunk % n_blocks[c])], "array<bigint>")
    columns = ["chunk", "qid", "cell", "v", *(["skip"] if "skip" in q.columns else []), "bound"]
    kinds = ", ".join(f"{c} {'double' if c == 'bound' else asking.schema[c].dataType.simpleString()}" for c in columns)
    rid_type = pa.string() if isinstance(r.schema["rid"].dataType, T.StringType) else pa.int64()
    begun = asking.select(*columns[:-1], no_bound)
    start = asked_cells(begun, lambda rows, gaps, cell, bound: nearest_cells(gaps, FIRST_CELLS))
    start = start.select("chunk", F.explode(one_of("chunk", "of")).alias("block"))
    bounded = materialise(stream(begun, start, first_bounds, kinds), "knn-asked")

    def within(rows, gaps, cell, bound):
        radius = np.sqrt(bound) * (1.0 + 1e-9) + 1e-9
        near = gaps[np.arange(len(rows)), cell]
        ring = np.maximum(gaps - hi[None, :], lo[None, :] - gaps)
        apart = _pivot_gaps(pivots[cell], pivots)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (gaps**2 - near[:, None] ** 2) / (2.0 * apart), 0.0)
        return (np.maximum(ring, plane) <= radius[:, None]) & (n_blocks[None, :] > 0)

    visits = materialise(asked_cells(bounded, within), "knn-visits")
    if query_rows:
        # rows that would be sent, one row per cell
        sent = visits.groupBy("of").count().collect()
        if sum(v["count"] * int(n_refs[v["of"]]) for v in sent) > CROWDED * n_chunks * max(1, int(n_refs.sum())):
            return _join_by_scan(q, r, k, query_rows)
    wanted = visits.select("chunk", F.explode(blocks_of("of")).alias("block"))
    return stream(bounded, wanted, nearest, schema)


def knn_regress(
    neighbours: DataFrame, targets: DataFrame, query_id: str = "query_id", ref_id: str = "ref_id", y: str = "y", weights: str = "distance"
) -> DataFrame:
    """Distance-weighted mean; when some distance is 0, the mean over the rows at distance 0. ``weights='uniform'``
    is the plain mean."""
    joined = neighbours.join(targets.select(F.col("row_id").alias(ref_id), y), ref_id)
    if weights == "uniform":
        return joined.groupBy(query_id).agg(F.avg(y).alias("pred"))
    exact = F.col("distance") == 0
    return joined.groupBy(query_id).agg(
        F.coalesce(
            F.avg(F.when(exact, F.col(y))),
            F.sum(F.when(~exact, F.col(y) / F.col("distance"))) / F.sum(F.when(~exact, F.lit(1.0) / F.col("distance"))),
        ).alias("pred")
    )


def knn_classify(
    neighbours: DataFrame, targets: DataFrame, query_id: str = "query_id", ref_id: str = "ref_id", y: str = "y", weights: str = "distance"
) -> DataFrame:
    """Class with the largest distance-weighted vote (``weights='uniform'``: the most votes); equal votes go to the
    smaller class."""
    joined = neighbours.join(targets.select(F.col("row_id").alias(ref_id), y), ref_id)
    if weights == "uniform":
        joined = joined.withColumn("distance", F.lit(1.0))
    votes = joined.groupBy(query_id, y).agg(
        F.count_if(F.col("distance") == 0).alias("_exact"),
        F.sum(F.when(F.col("distance") > 0, F.lit(1.0) / F.col("distance")).otherwise(F.lit(0.0))).alias("_vote"),
    )
    key = F.struct(F.col("_exact"), F.round("_vote", 9), -F.col(y))
    return votes.groupBy(query_id).agg(F.max_by(y, key).alias("pred"))


def knn_target_means(neighbours: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (1, 2, 4, 8), query_id: str = "query_id", ref_id: str = "ref_id", y: str = "y") -> DataFrame:
    """Mean target of the nearest 1, 2, 4, 8 neighbours as feature columns."""
    joined = neighbours.join(targets.select(F.col("row_id").alias(ref_id), y), ref_id)
    return joined.groupBy(query_id).agg(*[F.avg(F.when(F.col("neighbour_rank") <= n, F.col(y))).alias(f"mean_{n}") for n in ks])


def smote(df: DataFrame, y: str = "y", row_id: str = "row_id", vector: str = "vector", k: int = 5, seed: int = 711, mode: str = "away", minority_only: bool = False, **join) -> DataFrame:
    """Original rows plus int(n0 / n1) synthetic rows per row of class 1.

    A synthetic row picks one of the k nearest rows of the whole table, itself included, and moves
    away from it: x + (x - nb) * u. ``mode='interpolate'`` moves towards it instead, and
    ``minority_only`` looks for neighbours within class 1.
    """
    counts = df.agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1")).first()
    copies = int(counts["n0"] / counts["n1"]) if counts["n1"] else 0
    original = df.select(row_id, F.lit(0).alias("copy"), F.col(row_id).alias("neighbour_id"), F.col(vector).cast("array<double>").alias(vector), F.col(y).cast("int").alias(y), F.lit(0).alias("synthetic"))
    if copies < 1:
        return original
    minority = df.filter(F.col(y) == 1)
    refs = minority if minority_only else df
    near = knn_join(
        minority.select(F.col(row_id).alias("query_id"), vector), refs.select(F.col(row_id).alias("ref_id"), vector), k, vector=vector, **join
    )
    held = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("neighbour_rank", "ref_id"))).alias("_near"))  # k entries
    drawn = held.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    pick = F.floor(hash_uniform(seed, F.col("query_id"), F.col("copy"), F.lit("n")) * F.size("_near")).cast("int")
    drawn = drawn.select("query_id", "copy", F.get(F.col("_near"), pick)["ref_id"].alias("neighbour_id"), hash_uniform(seed, F.col("query_id"), F.col("copy"), F.lit("u")).alias("_u"))
    x = minority.select(F.col(row_id).alias("query_id"), F.col(vector).cast("array<double>").alias("_x"))
    nb = refs.select(F.col(row_id).alias("neighbour_id"), F.col(vector).cast("array<double>").alias("_nb"))
    joined = drawn.join(x, "query_id").join(nb, "neighbour_id")
    step = (lambda a, b: (a - b) * F.col("_u")) if mode == "away" else (lambda a, b: (b - a) * F.col("_u"))
    made = joined.select(
        F.col("query_id").alias(row_id), "copy", "neighbour_id", F.zip_with("_x", "_nb", lambda a, b: a + step(a, b)).alias(vector), F.lit(1).alias(y), F.lit(1).alias("synthetic")
    )
    return original.unionByName(made)
