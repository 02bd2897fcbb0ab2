"""Second-order boosted trees, grown level by level from sums of gradients.

Features are cut into bins once: by their values where these are few, else by quantiles. The binned table is written, with
one running prediction per model as soon as there are more trees than a pass should evaluate (``FRESH``). A pass over it grows one level of the trees of all models side by side: tasks add
up gradients and curvatures per (model, node, feature, bin) in numpy, one shuffle by node adds the tasks up, running
sums along the bins give the gain of every split, and one row per node comes back. With folds, model ``m`` learns from
all parts but ``m``, so the running predictions are out-of-fold predictions too, and the first pass of a round also
adds up the loss of the rounds before on each model's watch rows: early stopping costs no pass and no second fit.

``lambda`` and ``alpha`` are penalties on leaf values, ``gamma`` is what a split must gain, ``min_child_weight`` the
curvature a child must have. A null or NaN feature lies below all values. Row and feature draws follow from the row's
key, the seed and the round, not from partitions. Equal gains go to the first feature, then to the lowest bin.

With ``random_splits`` a node tries one threshold per feature, drawn evenly between the smallest and the largest value that its
rows have (the largest bin below it is taken), and of the features the share ``split_features``, drawn per node: extremely
randomised trees. A forest of them is many models of one round that skip the same part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.hashing import hash_uniform
from foldwright.functions.metrics import METRICS
from foldwright.operators.library import score
from foldwright.session import scratch_path

#: Cells (node, feature, bin) of which a task holds sums at once; wider levels take several passes.
MAX_CELLS = 1 << 21
#: Levels of a tree: its places are numbered by doubling.
MAX_DEPTH = 30
#: Trees that passes evaluate on top of the written running predictions.
FRESH = 10
#: Bytes of a block of the binned table: rows are kept in blocks of whole columns, which cost a pass no work per row but numpy's.
#: Blocks are written, and so read, in groups of about so many bytes.
BLOCK_BYTES, BLOCK_ROWS = 1 << 25, 10_000
#: Trees of up to so many nodes are evaluated node by node over whole columns, larger ones row by row.
FEW_NODES = 127
#: Trees of a forest that grow side by side: a row has a running prediction for each.
MODELS = 64
#: Quantiles asked of a feature with more values than bins.
ACCURACY = 10_000


def _squared(margin, y, w):
    return w * (margin - y), w


def _logistic(margin, y, w):
    p = 1 / (1 + np.exp(-margin))
    return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)


def _poisson(margin, y, w):
    p = np.exp(margin)
    return w * (p - y), w * p


def _log_odds(mean: float) -> float:
    return math.log(max(mean, 1e-12) / max(1 - mean, 1e-12))


#: Gradient and curvature of the loss, prediction of a margin, margin of a mean.
OBJECTIVES: dict[str, tuple[Callable, Callable, Callable]] = {
    "squared": (_squared, lambda m: m, lambda mean: mean),
    "rmspe": (_squared, lambda m: m, lambda mean: mean),  # rows weigh 1 / y^2
    "logistic": (_logistic, lambda m: 1 / (1 + np.exp(-m)), _log_odds),
    "poisson": (_poisson, np.exp, lambda mean: math.log(max(mean, 1e-12))),
}


def _log_loss(p, y):
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def _share_off(p, y):
    return np.where(y != 0, ((y - p) / np.where(y != 0, y, 1)) ** 2, 0.0)


#: Metrics that are means over rows: added up in the pass that grows trees. Others are scored by a job per round.
ROW_LOSSES: dict[str, tuple[Callable, Callable]] = {
    "rmse": (lambda p, y: (p - y) ** 2, math.sqrt),
    "rmspe": (_share_off, math.sqrt),
    "rmspe_log": (lambda p, y: _share_off(np.expm1(p), np.expm1(y)), math.sqrt),
    "logloss": (_log_loss, lambda mean: mean),
}


@dataclass(frozen=True)
class Settings:
    num_rounds: int = 100
    max_depth: int = 6
    eta: float = 0.3
    lam: float = 1.0
    alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    max_bin: int = 64
    objective: str = "squared"
    metric: str = "rmse"
    patience: int = 0  # 0: all rounds are kept
    base_score: float | None = None  # default: the mean of the learning rows
    seed: int = 231
    random_splits: bool = False
    split_features: float = 1.0


@dataclass
class Tree:
    """Nodes in order of growth; ``feature`` is -1 at a leaf."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    place: list[int] = field(default_factory=list)  # 1 at the root, 2 p and 2 p + 1 below place p
    depth: int = 0

    def add(self, value: float, place: int = 1) -> int:
        for column, blank in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.place, place)):
            column.append(blank)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int, left: float, right: float) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, at
        below = 2 * self.place[node]
        self.left[node], self.right[node] = self.add(left, below), self.add(right, below + 1)
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row ends."""
        if len(self.feature) <= FEW_NODES:
            near = np.zeros(len(bins), np.uint8)
            for node, (f, at, left, right) in enumerate(zip(self.feature, self.bin, self.left, self.right, strict=True)):
                if f >= 0:  # parents come before their children, a right child after its left one
                    inside = near == node
                    beyond = (bins[:, f] > at) & inside
                    near += inside.view(np.uint8) * np.uint8(left - node)
                    near += beyond.view(np.uint8) * np.uint8(right - left)
            return near.astype(np.int64)
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.asarray(c, np.int64) for c in (self.feature, self.bin, self.left, self.right))
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            f = feature[at]
            down = np.where(bins[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at])
            at = np.where(f >= 0, down, at)
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(bins)]


@dataclass
class Boosted:
    """Models that share bins: one base margin and one list of trees each."""

    features: list[str]
    edges: list[np.ndarray]
    settings: Settings
    base: list[float]
    trees: list[list[Tree]]
    kept: list[int]
    history: list[tuple[int, int, float]]  # (model, rounds, loss on the model's watch rows)

    def margins(self, bins: np.ndarray, model: int) -> np.ndarray:
        return self.base[model] + sum((t.values(bins) for t in self.trees[model][: self.kept[model]]), np.zeros(len(bins)))

    def predict(self, df: DataFrame, model: int = 0) -> DataFrame:
        """``df`` with ``pred``."""
        own, shape = self, OBJECTIVES[self.settings.objective][1]
        x = F.array(*[F.col(f).cast("double") for f in self.features])

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = cut(batch.column("_x"), own.edges)
                pred = shape(own.margins(bins, model))
                columns = [*batch.columns[:-1], pa.array(pred, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "pred"])

        schema = T.StructType([*df.schema.fields, T.StructField("pred", T.DoubleType())])
        return df.withColumn("_x", x).mapInArrow(work, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def cut(column: pa.Array, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of a column of feature arrays: 0 for missing, else 1 + the number of edges below the value."""
    x = _matrix(column, len(edges))
    out = np.empty(x.shape, np.uint8, order="F")
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(e, x[:, f], side="left"))
    return out


def bin_edges(df: DataFrame, features: Sequence[str], max_bin: int) -> list[np.ndarray]:
    """Per feature the values themselves if there are at most ``max_bin``, else quantiles."""
    x = df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"))

    def few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = [np.zeros(0)] * len(features)
        for batch in batches:
            values = _matrix(batch.column(0), len(features))
            for f in range(len(features)):
                if len(met[f]) <= max_bin:
                    own = values[:, f]
                    met[f] = np.union1d(met[f], own[~np.isnan(own)])[: max_bin + 1]
        at = np.repeat(np.arange(len(features)), [len(m) for m in met])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate(met), pa.float64())], names=["f", "v"])

    # a task tells at most max_bin + 1 values of a feature
    seen = x.mapInArrow(few, "f int, v double").groupBy("f").agg(F.slice(F.array_sort(F.collect_set("v")), 1, max_bin + 1).alias("v"))
    values = {r["f"]: r["v"] for r in seen.collect()}
    edges = [np.array(values.get(f, []), float) for f in range(len(features))]
    wide = [f for f, e in enumerate(edges) if len(e) > max_bin]
    if wide:
        shares = [i / max_bin for i in range(1, max_bin)]
        asked = [F.percentile_approx(F.nanvl(F.col(features[f]).cast("double"), F.lit(None)), shares, ACCURACY).alias(f"q{f}") for f in wide]
        found = df.agg(*asked).first()
        for f in wide:
            edges[f] = np.unique(np.array(found[f"q{f}"], float))
    return edges


def _mix(key: np.ndarray, number: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit keys and a number."""
    x = key.astype(np.uint64) + np.uint64((number * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def _worth(g: Column, h: Column, lam: Column, alpha: Column) -> Column:
    t = F.greatest(F.abs(g) - alpha, F.lit(0.0))
    return t * t / (h + lam)


def leaf_value(g: float, h: float, s: Settings) -> float:
    t = math.copysign(max(abs(g) - s.alpha, 0.0), g)
    return -s.eta * t / (h + s.lam) if h + s.lam > 0 else 0.0


SUMS = "model int, node long, feature int, bin int, g double, h double"


#: Columns of the binned table, a row per block; bins and margins are kept column by column. Margins are empty until they are written.
BLOCKS = {"part": np.int32, "y": np.float64, "w": np.float64, "key": np.int64, "bins": np.uint8, "margin": np.float64}
BLOCK_SCHEMA = ", ".join(f"{name} binary" for name in BLOCKS)


def _blocks(columns: Sequence[np.ndarray], rows: int) -> pa.RecordBatch:
    """The columns (of one length, without margins) cut into blocks of at most ``rows``."""
    starts = range(0, len(columns[0]), rows)
    told = [pa.array([c[low : low + rows].astype(kind, copy=False).tobytes(order="F") for low in starts], pa.binary()) for c, kind in zip(columns, BLOCKS.values(), strict=False)]
    told.append(pa.array([b""] * len(starts), pa.binary()))
    return pa.RecordBatch.from_arrays(told, names=list(BLOCKS))


@dataclass(frozen=True)
class Reader:
    """Columns of the blocks of a batch, with the margins brought up to date by the trees grown since it was written."""

    n_features: int
    trees: list[list[Tree]]
    base: list[float]
    models: Sequence[int]  # those whose margins are asked for

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for i in range(batch.num_rows):
            part, y, w, key, bins, margin = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in enumerate(BLOCKS.values()))
            bins = bins.reshape(self.n_features, len(part)).T
            if len(margin):
                margin = margin.reshape(len(self.trees), len(part)).copy().T
            else:  # none were written yet
                margin = np.repeat(np.array(self.base), len(part)).reshape(len(self.base), len(part)).T
            for m in self.models:
                for tree in self.trees[m]:
                    margin[:, m] += tree.values(bins)
            yield part, y, w, key, bins, margin


@dataclass
class Watch:
    """The best loss so far and the rounds it took; ends after ``patience`` rounds without a better one (0: never)."""

    patience: int
    best: float = math.inf
    rounds: int = 0

    def goes_on(self, rounds: int, loss: float) -> bool:
        if loss < self.best:
            self.best, self.rounds = loss, rounds
        return not self.patience or rounds - self.rounds < self.patience


@dataclass(frozen=True)
class Model:
    """What one of the models that grow together learns by: it skips the rows of ``part``, and watches them."""

    part: int
    settings: Settings


#: What models that grow together must have in common.
SHARED = ("objective", "metric", "max_bin", "base_score", "random_splits")


class Booster:
    """Grows boosted models side by side on one table (part, y, key and features).

    A model learns from the rows of other parts than its own, and watches those of its own. Rows with a negative part are
    learnt from by all.
    """

    def __init__(self, table: DataFrame, features: Sequence[str], models: Sequence[Model], like: Booster | None = None):
        """``like`` is a booster of the same table that has grown nothing beyond its first round: its binned table is used again."""
        self.features, self.models, self.s = list(features), list(models), models[0].settings
        if any(getattr(m.settings, c) != getattr(self.s, c) for m in models for c in SHARED):
            raise ValueError(f"models that grow together share {SHARED}")
        if self.s.max_bin > 254:
            raise ValueError("max_bin is 254 at most")
        if any(m.settings.max_depth > MAX_DEPTH for m in models):
            raise ValueError(f"max_depth is {MAX_DEPTH} at most")
        # bins of folds are shared; a single model's come from the rows that it learns from
        self.edges = like.edges if like else bin_edges(table.filter("part < 0") if len(models) == 1 else table, features, self.s.max_bin)
        self.width = max((len(e) for e in self.edges), default=0) + 2
        y = F.col("y").cast("double")
        self.stats = stats = like.stats if like else self._stats(table)
        weight = F.lit(1.0)
        if self.s.objective == "rmspe":
            # as shares of the largest label, so that curvatures are near 1 for large labels
            top = max((r["top"] or 0.0 for r in stats.values()), default=0.0)
            weight = F.when(y != 0, F.pow(F.lit(top) / y, F.lit(2.0))).otherwise(0.0)
        self.base = [self._base(stats, m.part) for m in self.models]
        #: about the largest gain there can be, so that rounding of gains is relative
        self.unit = max(sum(r["n"] * (r["var"] or 0.0) for r in stats.values()), 1e-300)
        if self.s.objective != "squared":
            self.unit = max(float(sum(r["n"] for r in stats.values())), 1.0)
        self.trees: list[list[Tree]] = [[] for _ in models]
        self.fresh = 0  # index of the first tree that the written predictions lack
        self.history: list[tuple[int, int, float]] = []
        if like:
            self.rows = like.rows
            return
        kept = table.select(F.col("part").cast("int").alias("part"), y.alias("y"), weight.alias("w"), F.col("key").cast("long").alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
        # a table of few files would keep most cores idle in every pass
        spread = kept.repartition(table.sparkSession.sparkContext.defaultParallelism, "key", "part", "y", "x")
        self.rows = self._stored(self._start(spread), False)

    def _stats(self, table: DataFrame) -> dict[int, dict]:
        y = F.col("y").cast("double")
        w = F.when(y != 0, 1 / (y * y)).otherwise(0.0) if self.s.objective == "rmspe" else F.lit(1.0)
        found = table.groupBy(F.col("part").cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(w * y).alias("wy"), F.sum(w).alias("w"), F.var_pop(y).alias("var"), F.max(F.abs(y)).alias("top"))
        return {r["part"]: r.asDict() for r in found.collect()}  # one row per part

    def _base(self, stats: dict[int, dict], part: int) -> float:
        to_margin = OBJECTIVES[self.s.objective][2]
        if self.s.base_score is not None:
            return to_margin(self.s.base_score)
        own = [r for p, r in stats.items() if p != part]
        weight = sum(r["w"] for r in own)
        return to_margin(sum(r["wy"] for r in own) / weight) if weight else 0.0

    def _start(self, kept: DataFrame) -> DataFrame:
        edges, rows = self.edges, self._block_rows()

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = cut(batch.column("x"), edges)
                yield _blocks([*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]), bins], rows)

        return kept.mapInArrow(work, BLOCK_SCHEMA)

    def _block_rows(self) -> int:
        return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (28 + len(self.features) + 8 * len(self.models))))

    def _stored(self, blocks: DataFrame, margins: bool) -> DataFrame:
        """The table written and read back. Readers decode a group of blocks at once, so groups are bounded; equal blocks are
        no dictionary, in which a group would grow beyond its bytes."""
        path = scratch_path(blocks.sparkSession, "boosted")
        group = max(1, BLOCK_BYTES // (self._block_rows() * (28 + len(self.features) + 8 * len(self.models) * margins)))
        blocks.write.options(**{"parquet.enable.dictionary": "false", "parquet.block.row.count.limit": str(group)}).parquet(path)
        return blocks.sparkSession.read.schema(blocks.schema).parquet(path)

    def _reader(self, models: Sequence[int] | None = None) -> Reader:
        asked = range(len(self.trees)) if models is None else list(models)
        return Reader(len(self.features), [trees[self.fresh :] for trees in self.trees], self.base, asked)

    def _refresh(self) -> None:
        """Write the running predictions of all trees so far."""
        read = self._reader()

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = pa.array([columns[-1].tobytes(order="F") for columns in read(batch)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], margins], names=batch.schema.names)

        self.rows = self._stored(self.rows.mapInArrow(work, self.rows.schema), True)
        self.fresh = len(self.trees[0])

    def _sums(self, growing: dict[int, Tree], open_nodes: dict[int, list[int]], columns: dict[int, list[int]], number: int, watch: bool) -> DataFrame:
        """Partial sums of this level: SUMS, with feature -1 for the watch loss and the number of watch rows."""
        s, width, models, read = self.s, self.width, self.models, self._reader(open_nodes)
        grad, shape, _ = OBJECTIVES[s.objective]
        loss = ROW_LOSSES[s.metric][0] if s.metric in ROW_LOSSES else None

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {m: np.zeros((2, len(columns[m]), len(nodes) * width)) for m, nodes in open_nodes.items()}
            watched = np.zeros((len(models), 2))
            slots = {}
            for m, nodes in open_nodes.items():
                slots[m] = np.full(len(growing[m].feature), -1, np.int64)
                slots[m][nodes] = np.arange(len(nodes))
            for part, y, w, key, bins, margin in (block for batch in batches for block in read(batch)):
                draws: dict[int, np.ndarray] = {}
                for m, nodes in open_nodes.items():
                    own = models[m].settings
                    slot = slots[m][growing[m].leaves(bins)]
                    learns = (part != models[m].part) & (slot >= 0)
                    if own.subsample < 1:
                        if own.seed not in draws:
                            draws[own.seed] = _mix(key, own.seed + 7919 * number)
                        learns &= draws[own.seed] < own.subsample
                    rows = np.flatnonzero(learns)
                    if len(rows):
                        g, h = grad(margin[rows, m], y[rows], w[rows])
                        first = slot[rows] * width
                        for c, f in enumerate(columns[m]):
                            at = first + bins[:, f][rows]
                            sums[m][0, c] += np.bincount(at, g, len(nodes) * width)
                            sums[m][1, c] += np.bincount(at, h, len(nodes) * width)
                if watch and loss:
                    for m in open_nodes:
                        rows = part == models[m].part
                        watched[m] += loss(shape(margin[rows, m]), y[rows]).sum(), rows.sum()
            for m, nodes in open_nodes.items():
                c, at = np.nonzero(sums[m][1])
                told = [np.full(len(c), m), np.array(growing[m].place)[nodes][at // width], np.array(columns[m])[c], at % width, sums[m][0, c, at], sums[m][1, c, at]]
                if watch and loss and watched[m, 1]:
                    told = [np.append(t, x) for t, x in zip(told, (m, -1, -1, 0, *watched[m]), strict=True)]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(k.to_pandas_dtype()), k) for t, k in zip(told, kinds, strict=True)], names=["model", "node", "feature", "bin", "g", "h"])

        return self.rows.mapInArrow(work, SUMS)

    def _each(self, name: str) -> Column:
        """A setting of the row's model."""
        values = [float(getattr(m.settings, name)) for m in self.models]
        return F.lit(values[0]) if len(set(values)) == 1 else F.get(F.array(*map(F.lit, values)), F.col("model"))

    def _best(self, sums: DataFrame) -> list:
        """Per (model, node): its sums and its best split; one row each. The watch loss comes as node -1."""
        gamma, least = self._each("gamma"), self._each("min_child_weight")
        cells = sums.repartition("model", "node").groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        along = Window.partitionBy("model", "node", "feature").orderBy("bin")
        upto = along.rowsBetween(Window.unboundedPreceding, 0)
        whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cells = cells.select("model", "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(whole).alias("ga"), F.sum("h").over(whole).alias("ha"), F.lead("bin").over(along).alias("next"))
        gr, hr = F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl")
        lam, alpha = self._each("lam"), self._each("alpha")
        gain = (_worth(F.col("gl"), F.col("hl"), lam, alpha) + _worth(gr, hr, lam, alpha) - _worth(F.col("ga"), F.col("ha"), lam, alpha)) / 2 - gamma
        fits = F.col("next").isNotNull() & (F.col("hl") >= least) & (hr >= least)
        if self.s.random_splits:
            cells = self._drawn(cells)
            fits &= F.col("drawn")
        # rounded, so that gains that are equal but for the order of additions are equal
        order = F.struct(F.round(gain / self.unit, 12).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
        split = F.struct("feature", "bin", "gl", "hl", gain.alias("gain"))
        return cells.groupBy("model", "node").agg(F.min_by("ga", "feature").alias("g"), F.min_by("ha", "feature").alias("h"), F.max_by(split, F.when(fits, order)).alias("split")).collect()

    def _drawn(self, cells: DataFrame) -> DataFrame:
        """``cells`` with ``drawn``: whether a split is the drawn one of its node and feature."""
        seed = [str(m.settings.seed) for m in self.models]
        seed = F.lit(seed[0]) if len(set(seed)) == 1 else F.get(F.array(*map(F.lit, seed)), F.col("model"))
        u = lambda what: hash_uniform(self.s.seed, seed, F.col("node"), F.col("feature"), F.lit(what))
        edges = F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in e) + ")" if len(e) else "array(0D)" for e in self.edges) + ")")
        # rows beyond the last edge count as that edge, missing ones as the first
        value = F.get(F.get(edges, F.col("feature")), F.least(F.greatest(F.col("bin") - 1, F.lit(0)), F.size(F.get(edges, F.col("feature"))) - 1))
        whole = Window.partitionBy("model", "node", "feature")
        cells = cells.withColumn("value", value).withColumns({"low": F.min("value").over(whole), "high": F.max("value").over(whole)})
        under = F.col("value") <= F.col("low") + u("at") * (F.col("high") - F.col("low"))
        cells = cells.withColumn("below", F.max(F.when(under, F.col("bin"))).over(whole))
        return cells.withColumn("drawn", (F.col("bin") == F.col("below")) & (u("in") < self._each("split_features")))

    def _columns(self, m: int, number: int) -> list[int]:
        n = len(self.features)
        own = self.models[m].settings
        take = max(1, round(own.colsample * n))
        return list(range(n)) if take >= n else sorted(np.random.default_rng((own.seed, m, number)).choice(n, take, replace=False).tolist())

    def _grow(self, models: Sequence[int], number: int) -> tuple[dict[int, Tree], dict[int, tuple[float, float]]]:
        """A tree per model, and each model's watch loss (sum, rows) before it."""
        growing = {m: Tree() for m in models}
        open_nodes = {m: [growing[m].add(0.0)] for m in models}
        columns = {m: self._columns(m, number) for m in models}
        watched = {}
        for level in range(max(self.models[m].settings.max_depth for m in models)):
            step = max(1, MAX_CELLS // (self.width * max(len(c) for c in columns.values()) * len(models)))
            found = []
            for low in range(0, max(map(len, open_nodes.values())), step):
                some = {m: nodes[low : low + step] for m, nodes in open_nodes.items() if nodes[low : low + step]}
                found += self._best(self._sums(growing, some, columns, number, level == 0 and low == 0))
            following: dict[int, list[int]] = {}
            at = {(m, growing[m].place[node]): node for m, nodes in open_nodes.items() for node in nodes}
            for r in sorted(found, key=lambda r: (r["model"], r["node"])):
                m, best = r["model"], r["split"]
                if r["node"] < 0:
                    watched[m] = r["g"], r["h"]
                    continue
                tree, s, node = growing[m], self.models[m].settings, at[m, r["node"]]
                if level == 0:
                    tree.value[node] = leaf_value(r["g"], r["h"], s)
                if best is None or best["gain"] <= 1e-12 * self.unit:
                    continue
                ends = leaf_value(best["gl"], best["hl"], s), leaf_value(r["g"] - best["gl"], r["h"] - best["hl"], s)
                children = tree.split(node, best["feature"], best["bin"], *ends)
                tree.depth = level + 1
                if tree.depth < s.max_depth:
                    following.setdefault(m, []).extend(children)
            open_nodes = following
            if not open_nodes:
                break
        return growing, watched

    def _score(self, models: Sequence[int]) -> dict[int, float]:
        """Watch loss by the registered metric, for metrics that need an ordering or an aggregate of their own."""
        shape, read = OBJECTIVES[self.s.objective][1], self._reader(models)
        parts = [(m, self.models[m].part) for m in models]

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, y, _, key, _, margin in (block for batch in batches for block in read(batch)):
                for m, own in parts:
                    rows = np.flatnonzero(part == own)
                    pred = shape(margin[rows, m])
                    columns = [pa.array(np.full(len(rows), m), pa.int32()), pa.array(key[rows]), pa.array(y[rows]), pa.array(pred)]
                    yield pa.RecordBatch.from_arrays(columns, names=["fold", "row_id", "y", "pred"])

        watched = self.rows.mapInArrow(work, "fold int, row_id long, y double, pred double")
        return {r["fold"]: r["score"] for r in score(watched, self.s.metric, groups=["fold"]).collect()}

    def fit(self, rungs: Sequence[int] = (), groups: Sequence[int] = ()) -> Boosted:
        """Grow all models. At each number of rounds in ``rungs`` the worse half of the ``groups`` (one number per model; by mean
        watch loss) stops."""
        metric = self.s.metric
        sign = -1 if metric in METRICS and METRICS[metric].higher_is_better else 1
        watches = [Watch(m.settings.patience) for m in self.models]
        latest: dict[int, float] = {}
        going = list(range(len(self.models)))
        last = max(m.settings.num_rounds for m in self.models)

        def note(m: int, rounds: int, value: float) -> None:
            self.history.append((m, rounds, value))
            latest[m] = sign * value
            if not watches[m].goes_on(rounds, sign * value):
                going.remove(m)

        def halve() -> None:
            losses: dict[int, list[float]] = {}
            for m in going:
                losses.setdefault(groups[m], []).append(latest[m])
            ranked = sorted(losses, key=lambda g: (sum(losses[g]) / len(losses[g]), g))
            for m in [m for m in going if groups[m] in ranked[(len(ranked) + 1) // 2 :]]:
                going.remove(m)

        def leave(number: int) -> None:
            if number in rungs:
                halve()
            for m in [m for m in going if self.models[m].settings.num_rounds <= number]:
                going.remove(m)

        for number in range(last + 1):
            if number - self.fresh >= FRESH and number < last:
                self._refresh()
            if metric not in ROW_LOSSES and (self.s.patience or rungs):
                for m, value in self._score(list(going)).items():
                    note(m, number, value)
                leave(number)
                if not going:
                    break
            if number == last:
                if metric in ROW_LOSSES and going:  # what the last round did
                    stumps = {m: Tree() for m in going}
                    nodes = {m: [stumps[m].add(0.0)] for m in going}
                    for r in self._best(self._sums(stumps, nodes, {m: [0] for m in going}, number, True)):
                        if r["node"] < 0:
                            note(r["model"], number, ROW_LOSSES[metric][1](r["g"] / r["h"]))
                break
            grown, watched = self._grow(list(going), number)
            for m, (total, n) in sorted(watched.items()):
                note(m, number, ROW_LOSSES[metric][1](total / n))
            leave(number)
            for m, trees in enumerate(self.trees):
                # a model that has stopped gets empty trees, so that all lists have one length
                trees.append(grown[m] if m in going else _nothing())
            if not going:
                break
        kept = [w.rounds if m.settings.patience and math.isfinite(w.best) else len(t) for w, m, t in zip(watches, self.models, self.trees, strict=True)]
        return Boosted(self.features, self.edges, self.s, self.base, self.trees, kept, self.history)


def _nothing() -> Tree:
    tree = Tree()
    tree.add(0.0)
    return tree


def boost(table: DataFrame, features: Sequence[str], settings: Settings, n_models: int = 1) -> Boosted:
    """Fit on ``table`` (part, y, key, features): a model for each of the parts 0, 1, ...; see ``Booster``."""
    return Booster(table, features, [Model(m, settings) for m in range(n_models)]).fit()


def race(table: DataFrame, features: Sequence[str], k: int, trials: Sequence[Settings], rungs: Sequence[int], label: Column | None = None) -> tuple[Boosted, list[tuple[int, int, int, float]]]:
    """All trials on all folds of one repeat at once; at each rung the worse half stops. (models, trial x k + fold each;
    the watch losses as (trial, fold, rounds, loss))."""
    rows = table.withColumns({"part": F.col("fold"), "key": F.xxhash64("row_id"), "y": F.col("y") if label is None else label})
    models = [Model(f, s) for s in trials for f in range(k)]
    made = Booster(rows, features, models).fit(rungs, [n // k for n in range(len(models))])
    return made, [(m // k, m % k, rounds, loss) for m, rounds, loss in made.history]


def out_of_fold_boosting(table: DataFrame, features: Sequence[str], k: int, settings: Settings, iters: int = 1, model: str = "boosted", label: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, history) of one boosted model per fold, all folds of a repeat grown in the same passes.

    Predictions are (model, iter, fold, row_id, y, pred), on the scale of ``label`` (default y); history is (model, iter, fold, rounds, loss, kept).
    """
    pieces, told = [], []
    for i in range(iters):
        rows = table.filter(F.col("iter") == i)
        made = boost(rows.withColumns({"part": F.col("fold"), "key": F.xxhash64("row_id"), "y": F.col("y") if label is None else label}), features, settings, k)
        for m in range(k):
            own = made.predict(rows.filter(F.col("fold") == m).select("iter", "fold", "row_id", "y", *features), m)
            pieces.append(own.select(F.lit(model).alias("model"), "iter", "fold", "row_id", "y", "pred"))
        told += [(model, i, m, rounds, float(loss), int(rounds == made.kept[m])) for m, rounds, loss in made.history]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out, table.sparkSession.createDataFrame(told, "model string, iter int, fold int, rounds int, loss double, kept int")


def random_forest(table: DataFrame, features: Sequence[str], k: int, trees: int, settings: Settings, seeds: Sequence[int] | None = None, label: Column | None = None) -> list[Boosted]:
    """Extremely randomised trees of the folds 0 .. k - 1 (one boosted model of one round each), ``MODELS`` at a time."""
    rows = table.withColumns({"part": F.col("fold"), "key": F.xxhash64("row_id"), "y": F.col("y") if label is None else label})
    seeds = list(seeds or range(settings.seed, settings.seed + trees))
    per_tree = [replace(settings, num_rounds=1, eta=1.0, patience=0, random_splits=True, seed=s) for s in seeds]
    out, first = [], None
    for low in range(0, trees, max(1, MODELS // k)):
        some = per_tree[low : low + max(1, MODELS // k)]
        booster = Booster(rows, features, [Model(f, s) for s in some for f in range(k)], first)
        first = first or booster  # one round writes no margins, so all share one binned table
        out.append(booster.fit())
    return out


def out_of_fold_forest(table: DataFrame, features: Sequence[str], k: int, trees: int, settings: Settings, iters: int = 1, model: str = "extratree") -> DataFrame:
    """(model, iter, fold, row_id, y, pred): the mean over a fold's trees."""
    pieces = []
    for i in range(iters):
        rows = table.filter(F.col("iter") == i)
        parts = random_forest(rows, features, k, trees, settings)
        for f in range(k):
            own = rows.filter(F.col("fold") == f).select("iter", "fold", "row_id", "y", *features)
            pieces.append(mean_of(own, [(p, m) for p in parts for m in range(f, len(p.trees), k)]).select(F.lit(model).alias("model"), "iter", "fold", "row_id", "y", "pred"))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def mean_of(df: DataFrame, members: Sequence[tuple[Boosted, int]]) -> DataFrame:
    """``df`` with ``pred``, the mean prediction of models that share bins."""
    first = members[0][0]
    features, edges, shape = first.features, first.edges, OBJECTIVES[first.settings.objective][1]
    small = [(p.base[m], p.trees[m][: p.kept[m]]) for p, m in members]
    x = F.array(*[F.col(f).cast("double") for f in features])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = cut(batch.column("_x"), edges)
            pred = np.zeros(len(bins))
            for base, trees in small:
                pred += shape(base + sum((t.values(bins) for t in trees), np.zeros(len(bins))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred / len(small), pa.float64())], names=[*batch.schema.names[:-1], "pred"])

    schema = T.StructType([*df.schema.fields, T.StructField("pred", T.DoubleType())])
    return df.withColumn("_x", x).mapInArrow(work, schema)
