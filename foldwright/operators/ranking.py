"""Ranks and running sums over whole groups without putting a group into one task.

``row_number() over (partition by fold order by pred)`` sorts a whole fold in one task. Here the
ordering is cut into buckets by a pure function of the row, so that

* every (group, bucket) is small and ranked locally,
* a table of one row per (group, bucket) supplies the offset of each bucket.

Bucket bounds are quantiles fetched once and used as literals, so a task that is run again puts
every row into the same bucket. A value frequent enough to appear twice among the quantiles gets
a bucket of its own, which is cut further along the tie-break key.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.hashing import hash_order_bucket
from foldwright.session import range_buckets

CODE = "_bucket"


# A bucket is not worth its place below this many rows.
ROWS_PER_BUCKET = 5000
# Rows that one task should sort; a longer table is dealt to more tasks.
ROWS_PER_TASK = 1 << 21


def _quantiles(df: DataFrame, cols: Sequence[str], buckets: int) -> tuple[list[list[float]], int]:
    """Approximate quantiles of several columns and the number of rows, in one pass."""
    probs = [i / buckets for i in range(1, buckets)]
    accuracy = max(1000, 8 * buckets)
    found = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(F.col(c).cast("double") + F.lit(0.0), probs, accuracy).alias(f"q{i}") for i, c in enumerate(cols)],
    ).first()
    return [sorted(q or []) for q in found[1:]], found["n"]


def _bucketize(df: DataFrame, col: str, bounds: Sequence[float], out: str) -> DataFrame:
    uniq = sorted(set(bounds))
    if not uniq:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    tmp = f"{out}_key"
    cutter = Bucketizer(
        splits=[float("-inf"), *uniq, float("inf")], inputCol=tmp, outputCol=out, handleInvalid="keep"
    )
    # adding 0.0 turns -0.0 into 0.0, which order alike but not in a binary search
    keyed = df.withColumn(tmp, F.col(col).cast("double") + F.lit(0.0))
    return cutter.transform(keyed).withColumn(out, F.col(out).cast("bigint")).drop(tmp)


def ordering_buckets(
    df: DataFrame, by: str, ascending: bool = True, tie: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Add a bucket number that increases along (``by`` in the given direction, ``tie`` ascending)."""
    return _counted_buckets(df, by, ascending, tie, buckets)[0]


def _counted_buckets(df: DataFrame, by: str, ascending: bool, tie: str | None, buckets: int | None) -> tuple[DataFrame, int]:
    """The frame with bucket numbers, and its number of rows."""
    has_tie = tie is not None and tie != by
    cut_tie = has_tie and not isinstance(df.schema[tie].dataType, T.StringType)
    most = buckets or range_buckets(df.sparkSession)
    found, n_rows = _quantiles(df, [by, tie] if cut_tie else [by], most)
    if buckets is None:  # a small table needs fewer: keep every n-th quantile
        every = -(-most // max(2, n_rows // ROWS_PER_BUCKET))
        found = [q[every - 1 :: every] for q in found]
    bounds, *tie_bounds = found
    buckets = len(bounds) + 1
    out = _bucketize(df, by, bounds, "_b")
    sign = 1 if ascending else -1
    starts = sorted(set(bounds))
    # how often each bucket's lower end occurs among the quantiles: its share of the rows
    shares = [0, *Counter(bounds).values()]
    if max(shares) < 2 or tie is None or tie == by:
        return out.withColumn(CODE, F.col("_b") * sign).drop("_b"), n_rows
    if cut_tie:
        out = _bucketize(out, tie, tie_bounds[0], "_t")
    else:
        out = _bucketize_text(out, tie, buckets, "_t")
    share = F.coalesce(F.get(F.expr(_numbers("L", shares)), F.col("_b").cast("int")), F.lit(0))
    start = F.get(F.expr(_numbers("D", [starts[0], *starts])), F.col("_b").cast("int"))
    key = F.col(by).cast("double") + F.lit(0.0)
    is_hot = F.coalesce((share >= 2) & (key == start) & _is_exact(df.schema[by].dataType, start), F.lit(False))
    # A hot value is the lower end of its bucket: first when ascending, last when descending. It is cut
    # into as many pieces as its share asks for, so there are at most twice as many pieces as buckets.
    place = F.when(is_hot, F.lit(0 if ascending else 1)).otherwise(F.lit(1 if ascending else 0))
    piece = F.when(is_hot, F.floor(F.col("_t") * (share + 1) / F.lit(buckets + 1))).otherwise(F.lit(0))
    code = (F.col("_b") * sign * 2 + place) * (buckets + 2) + piece
    return out.withColumn(CODE, code.cast("bigint")).drop("_b", "_t"), n_rows


def _is_exact(kind: T.DataType, bound: Column) -> Column:
    """Whether values that equal ``bound`` as doubles are one value: not so for whole numbers beyond 2^53."""
    if isinstance(kind, T.LongType):
        return F.abs(bound) < float(2**53)
    return F.lit(not isinstance(kind, T.DecimalType) or kind.precision <= 15)


def _bucketize_text(df: DataFrame, col: str, buckets: int, out: str) -> DataFrame:
    """Buckets along a text column at quantiles of the six bytes that follow the column's common prefix."""
    ends = df.agg(F.min(col).alias("a"), F.max(col).alias("b")).first()
    prefix = len(os.path.commonprefix([(ends["a"] or "").encode(), (ends["b"] or "").encode()]))
    head = F.substring(F.encode(F.col(col), "utf-8"), prefix + 1, 6)
    code = F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double")
    coded = df.withColumn("_text", F.coalesce(code, F.lit(-1.0)))
    bounds, _ = _quantiles(coded, ["_text"], buckets)
    return _bucketize(coded, "_text", bounds[0], out).drop("_text")


def _numbers(suffix: str, values: Sequence[float]) -> str:
    """An array literal as SQL text: one expression, however long."""
    return "array(" + ", ".join(f"{v!r}{suffix}" for v in values) + ")"


def hash_buckets(df: DataFrame, hash_col: str, buckets: int | None = None) -> DataFrame:
    """Bucket number along a hash column. Hashes are uniform, so no quantiles are needed."""
    buckets = buckets or range_buckets(df.sparkSession)
    return df.withColumn(CODE, hash_order_bucket(F.col(hash_col), buckets))


# Columns that are never null in the library's tables, whatever their schema says.
KEY_COLUMNS = ("model", "iter", "fold", "n_models", "submission", "at")


def _group_keys(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Non-null stand-ins for nullable group columns, so that null groups survive the offset join."""
    keys = []
    for g in groups:
        if df.schema[g].nullable and g not in KEY_COLUMNS:
            key = f"_g_{g}"
            df = df.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")))
            keys.append(key)
        else:
            keys.append(g)
    return df, keys


def scan_in_order(
    df: DataFrame,
    order: Sequence[Column],
    groups: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    running: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    n_rows: int = 0,
) -> DataFrame:
    """Rank, running sums and group totals for a frame that carries bucket numbers. With ``n_rows`` beyond
    ``ROWS_PER_TASK`` buckets are dealt to so many tasks that none sorts much more than that."""
    running, totals = running or {}, totals or {}
    df, keys = _group_keys(df, groups)
    sums = {**{f"_r_{n}": c for n, c in running.items()}, **{f"_t_{n}": c for n, c in totals.items()}}
    per_bucket = df.groupBy(*keys, CODE).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy(CODE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys,
        CODE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(whole).alias("_total"),
        *[F.coalesce(F.sum(f"_r_{n}").over(before), F.lit(0.0)).alias(f"_off_{n}") for n in running],
        *[F.sum(f"_t_{n}").over(whole).alias(f"_tot_{n}") for n in totals],
    )
    # the bucket leads: the sort then compares mostly one number
    local = Window.partitionBy(CODE, *keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = df.repartition(-(-n_rows // ROWS_PER_TASK), CODE, *keys) if n_rows > ROWS_PER_TASK else df
    ranked = dealt.select(
        "*",
        F.row_number().over(local).alias("_local"),
        *[F.sum(c).over(upto).alias(f"_run_{n}") for n, c in running.items()],
    )
    joined = ranked.join(offsets, [CODE, *keys])
    keep = [c for c in df.columns if c != CODE and c not in {k for k in keys if k.startswith("_g_")}]
    return joined.select(
        *keep,
        (F.col("_local") + F.col("_off")).cast("bigint").alias(rank),
        *([F.col("_total").alias(total)] if total else []),
        *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in running],
        *[F.col(f"_tot_{n}").alias(n) for n in totals],
    )


def ranked_by_value(
    df: DataFrame,
    by: str,
    ascending: bool = True,
    tie: str = "row_id",
    groups: Sequence[str] = (),
    buckets: int | None = None,
    **scan,
) -> DataFrame:
    """1-based rank along a numeric column, ties by ``tie`` ascending."""
    coded, n_rows = _counted_buckets(df, by, ascending, tie, buckets)
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_first()
    order = [key] if tie == by else [key, F.col(tie).asc()]
    return scan_in_order(coded, order, groups, n_rows=n_rows, **scan)


def ranked_by_hash(
    df: DataFrame, hash_col: str, tie: str = "row_id", groups: Sequence[str] = (), buckets: int | None = None, **scan
) -> DataFrame:
    """1-based rank in the pseudo-random order given by a ``hash_order`` column."""
    coded = hash_buckets(df, hash_col, buckets)
    return scan_in_order(coded, [F.col(hash_col).asc(), F.col(tie).asc()], groups, **scan)


def row_at(
    df: DataFrame, by: str, ascending: bool, tie: str, position: int, buckets: int | None = None
) -> tuple[float, object] | None:
    """(``by``, ``tie``) of the row at a 1-based position of the ordering, or None beyond the end.

    Counts per bucket find the bucket that holds the position; only that bucket is ordered.
    """
    coded = ordering_buckets(df.select(*dict.fromkeys([by, tie])), by, ascending, tie, buckets)
    counts = coded.groupBy(CODE).count().orderBy(CODE).collect()  # one row per bucket
    passed = 0
    for row in counts:
        if passed + row["count"] >= position:
            key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_first()
            inside = coded.filter(F.col(CODE) == row[CODE])
            local = F.row_number().over(Window.partitionBy(CODE).orderBy(key, F.col(tie).asc()))
            at = inside.withColumn("_local", local).filter(F.col("_local") == position - passed).first()
            return at[by], at[tie]
        passed += row["count"]
    return None


def is_within_first(df: DataFrame, by: str, ascending: bool, tie: str, size: int) -> Column:
    """Whether a row is among the first ``size`` of the ordering: a comparison with one boundary row,
    so the table itself is neither sorted nor shuffled. ``by`` must not be null."""
    if size <= 0:
        return F.lit(False)
    last = row_at(df, by, ascending, tie, size)
    if last is None:
        return F.lit(True)
    before = F.col(by) < last[0] if ascending else F.col(by) > last[0]
    return before | ((F.col(by) == last[0]) & (F.col(tie) <= last[1]))
