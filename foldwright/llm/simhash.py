"""SimHash near-duplicates by a vantage-point tree of fingerprints.

Distinct fingerprints are parted by a tree whose nodes hold a vantage point and a middle distance: nearer
ones go left. By the triangle inequality a pair within the radius parts at a node only if its left member's
distance lies within the radius of the middle; such members also visit the right branch, and visitors go on into
every branch that their ball can reach. Each leaf is a shard: one task looks up its residents and visitors,
with a tree of its own built the same way, and compares what meets in a small leaf. So every pair within the radius
is found at exactly the branch points its distances allow, and none is missed.

A shard returns a spanning forest of the links it found, at most one link per fingerprint, never all pairs of
a dense group. Links become components by alternating stars until nothing changes, each round written to the
shared folder. Rows with one fingerprint are one vertex from the start, so large groups of copies cost nothing.

The upper tree is built on the driver from a bounded sample of fingerprints and has at most ``MAX_SHARDS``
leaves; the sample shapes the shards, never the result.

Null or empty text has fingerprint zero and links like any other. A null doc_id takes part, but names no component; a
component of null identifiers alone has a null component_id. Repeated rows are returned each. Empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foldwright.llm.common import free_names, map_text, text_of
from foldwright.session import materialise

SHINGLE, MAX_BITS = 3, 2
#: A shard aims at so many fingerprints; a sample of this many per shard shapes the upper tree.
SHARD, MAX_SHARDS, SAMPLE_PER_SHARD = 4096, 4096, 32
LEAF = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64 majority bits of the shingles' hashes, as a signed number."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """fp for every row of ``docs`` (doc_id, text), with a key of the text to find the row again."""

    def work(ids: list, texts: list) -> dict:
        keys = [xxhash.xxh64_intdigest(t.encode(), 0) - (1 << 63) for t in texts]
        return {"doc_id": ids, "text_key": keys, "fp": [fingerprint(t, shingle) for t in texts]}

    return map_text(docs, work, "doc_id long, text_key long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Node:
    """A branch: vantage point, middle, and two branches; or a shard's number."""

    __slots__ = ("left", "middle", "right", "shard", "vantage")

    def __init__(self, vantage=None, middle=0, left=None, right=None, shard=-1):
        self.vantage, self.middle, self.left, self.right, self.shard = vantage, middle, left, right, shard


def split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the middle distance from it; None if all are equally far."""
    vantage = points[len(points) // 2]
    far = distance(points, vantage)
    middle = int(np.median(far))
    if middle == far.max():
        middle -= 1
    return (vantage, middle) if far.min() <= middle < far.max() else None


def build(points: np.ndarray, shards: int) -> tuple[Node, int]:
    """A tree of about ``shards`` leaves over a sample; returns it and the number of leaves."""
    count = 0

    def grow(own: np.ndarray, share: int) -> Node:
        nonlocal count
        cut = split(own) if share > 1 and len(own) > 1 else None
        if cut is None:
            count += 1
            return Node(shard=count - 1)
        near = distance(own, cut[0]) <= cut[1]
        return Node(*cut, grow(own[near], share // 2), grow(own[~near], share - share // 2))

    return grow(points, shards), count


def route(node: Node, points: np.ndarray, home: np.ndarray, radius: int, out: list) -> None:
    """Send ``points`` down the tree; ``home`` tells residents from visitors. Appends (shard, points, home)."""
    if not len(points):
        return
    if node.left is None:
        out.append((node.shard, points, home))
        return
    far = distance(points, node.vantage)
    near = far <= node.middle
    left = np.where(home, near, far <= node.middle + radius)
    right = np.where(home, ~near, far + radius > node.middle)
    route(node.left, points[left], home[left], radius, out)
    # a resident of the left within reach of the middle visits the right
    cross = home & near & (far + radius > node.middle)
    route(node.right, np.r_[points[right], points[cross]], np.r_[home[right], np.zeros(cross.sum(), bool)], radius, out)


def forest(residents: np.ndarray, visitors: np.ndarray, radius: int, out: list) -> None:
    """Append links (a, b) that connect what lies within the radius: residents with one another and with visitors."""
    if not len(residents) or len(residents) + len(visitors) < 2:
        return
    cut = split(residents) if len(residents) > LEAF else None
    if cut is None:
        _compare(residents, visitors, radius, out)
        return
    far, seen = distance(residents, cut[0]), distance(visitors, cut[0])
    near = far <= cut[1]
    forest(residents[near], visitors[seen <= cut[1] + radius], radius, out)
    forest(residents[~near], np.r_[visitors[seen + radius > cut[1]], residents[near & (far + radius > cut[1])]], radius, out)


def _compare(residents: np.ndarray, visitors: np.ndarray, radius: int, out: list) -> None:
    """All pairs of one leaf, in blocks; of each block only a spanning forest goes on."""
    every = np.r_[residents, visitors]
    label = np.arange(len(every))
    for at in range(0, len(residents), 1024):
        a, b = np.nonzero(distance(residents[at : at + 1024, None], every[None, :]) <= radius)
        a = a + at
        a, b = a[a != b], b[a != b]
        while len(a):
            low = np.minimum(label[a], label[b])
            if (label[a] == label[b]).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label != label[label]).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(every)))
    if len(linked):
        out.append((every[linked], every[label[linked]]))


def links(distinct: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """Links (a > b as unsigned order plays no part) whose components are those of the full relation, over column ``fp``."""
    total = distinct.count()
    shards = int(min(MAX_SHARDS, max(1, total // SHARD)))
    sample = distinct.orderBy(F.xxhash64(F.col("fp"), F.lit(8)), "fp").limit(SAMPLE_PER_SHARD * shards).toArrow()["fp"].to_numpy()
    tree, _ = build(sample.view(np.uint64), shards)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            out: list = []
            route(tree, points, np.ones(len(points), bool), radius, out)
            for shard, own, home in out:
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(own), shard, np.int32), "fp": own.view(np.int64), "home": home})

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        points, home = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy()
        out: list = []
        forest(np.unique(points[home]), np.unique(points[~home]), radius, out)
        a = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.uint64)
        b = np.concatenate([x[1] for x in out]) if out else np.zeros(0, np.uint64)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(place, "shard int, fp long, home boolean").groupBy("shard").applyInPandas(pairs, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """fp and root for every linked fingerprint: alternating large and small stars, until the stars stay."""
    stars = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        both = stars.union(stars.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(lowest, both["u"] == lowest["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(lowest, large["u"] == lowest["k"])
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        stars = materialise(small.select("e.*").where("u <> v").distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, text_key, fp, component_id (the smallest doc_id reachable) and root (the component's own name)."""
    rows = materialise(fingerprints(text_of(docs, id_col, text_col), shingle), "simhash")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct, max_bits)).withColumnRenamed("fp", "k")
    named = distinct.join(found, distinct["fp"] == found["k"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = named.join(least, named["root"] == least["r"]).select(F.col("fp").alias("k"), "root", "component_id")
    return rows.join(named, rows["fp"] == named["k"]).select("doc_id", "text_key", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest doc_id; repeated rows count as one."""
    found = near_duplicates(docs, id_col, text_col, **options)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("s"))
    on = free_names(docs, "_id", "_none", "_key")
    stay = stay.select(F.coalesce("s.doc_id", F.lit(0)).alias(on[0]), F.col("s.none").alias(on[1]), F.col("s.text_key").alias(on[2]))

    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            keys = [xxhash.xxh64_intdigest(t.as_buffer().to_pybytes() if t.is_valid else b"", 0) - (1 << 63) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, on[2]])

    at = docs.columns.index(text_col)
    keyed = docs.mapInArrow(key, StructType([*docs.schema.fields, StructField(on[2], LongType())]))
    keyed = keyed.withColumn(on[0], F.coalesce(F.col(id_col).cast("long"), F.lit(0))).withColumn(on[1], F.col(id_col).isNull())
    return keyed.join(stay, on, "left_semi").dropDuplicates(on).select(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
