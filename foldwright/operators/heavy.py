"""Frequent values and constant columns without shuffling the values.

Each task keeps, per column, a Misra-Gries summary of at most ``counters`` values: when there are more, the largest count
that does not fit is taken off all of them, and remembered as the summary's error. Summaries add up, and an added count
falls short of the true one by at most the added error. So every value that can occur often enough is in the
summaries; a second pass counts these candidates exactly. What is shuffled is tasks x columns x counters numbers, whatever the
number of distinct values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.session import materialise, small_side

COUNTERS = 1024
SENTINEL = "-1"


def _as_text(df: DataFrame, column: str) -> Column:
    """The value as text, -1 for null; numbers as doubles, so that 1 and 1.0 are one value."""
    kind = df.schema[column].dataType.typeName()
    value = F.col(column) if kind == "string" else F.col(column).cast("double")
    text = value.cast("string") if kind != "string" else value
    return F.coalesce(F.regexp_replace(text, r"\.0$", "") if kind != "string" else text, F.lit(SENTINEL))


def _added(held: pa.Table | None, batch: pa.Table, counters: int) -> tuple[pa.Table, int]:
    """A summary with more values in it, and by how much its counts may now fall short in addition."""
    both = batch if held is None else pa.concat_tables([held, batch])
    both = both.group_by("value").aggregate([("n", "sum")]).rename_columns(["value", "n"]).select(["value", "n"])
    if len(both) <= counters:
        return both, 0
    off = pc.take(both["n"], pc.select_k_unstable(both["n"], counters + 1, sort_keys=[("n", "descending")]))[-1].as_py()
    both = both.set_column(1, "n", pc.subtract(both["n"], off))
    return both.filter(pc.greater(both["n"], 0)), off


def summaries(df: DataFrame, columns: Sequence[str], counters: int = COUNTERS) -> DataFrame:
    """(column_name, value, n) and, with a null value, (column_name, error, rows) of every task."""
    names = list(columns)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.Table] = {}
        short, rows = dict.fromkeys(names, 0), 0
        for batch in batches:
            rows += batch.num_rows
            for i, name in enumerate(names):
                seen = pc.value_counts(batch.column(i))
                more = pa.table({"value": seen.field("values").cast(pa.string()), "n": seen.field("counts")})
                held[name], off = _added(held.get(name), more, counters)
                short[name] += off
        for name in names if rows else ():
            own = held[name].combine_chunks()
            values = pa.concat_arrays([own["value"].combine_chunks() if len(own) else pa.array([], pa.string()), pa.array([None], pa.string())])
            n = pa.array([*own["n"].to_pylist(), short[name]], pa.int64())
            told = [pa.array([name] * len(n)), values, n, pa.array([0] * (len(n) - 1) + [rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(told, names=["column_name", "value", "n", "rows"])

    return df.select(*[_as_text(df, c).alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(work, "column_name string, value string, n long, rows long")


def frequent_values(df: DataFrame, columns: Sequence[str], above: int, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(found, seen): every (column_name, value, n) with n > ``above``, counted exactly; and per column the number of distinct
    values where the summaries hold them all (null where they don't), and whether the sentinel is among them."""
    told = materialise(summaries(df, columns, counters), "summaries")
    error = told.filter("value IS NULL").groupBy("column_name").agg(F.sum("n").alias("error"))
    added = told.filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.sum("n").alias("n")).join(F.broadcast(error), "column_name")  # one row per column
    added = materialise(added, "summary")
    seen = added.groupBy("column_name").agg(F.max("error").alias("error"), F.count(F.lit(1)).alias("held"), F.max((F.col("value") == SENTINEL).cast("int")).alias("has_sentinel"))
    seen = seen.select("column_name", F.when(F.col("error") == 0, F.col("held")).alias("n_distinct"), "has_sentinel")
    likely = added.filter(F.col("n") + F.col("error") > above)
    sure = likely.filter(F.col("error") == 0).select("column_name", "value", "n")
    open_ = [r["column_name"] for r in likely.filter(F.col("error") > 0).select("column_name").distinct().collect()]  # names
    if not open_:
        return sure, seen
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _as_text(df, c).alias("value")) for c in open_]))
    again = df.select(cells.alias("_s")).select("_s.*").join(small_side(likely.filter(F.col("error") > 0).select("column_name", "value")), ["column_name", "value"])
    counted = again.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > above)
    return sure.unionByName(counted), seen


def drop_summary(df: DataFrame, columns: Sequence[str], min_std: float = 0.1, max_same: int = 140_000, counters: int = COUNTERS) -> DataFrame:
    """The drop list without counting every value: column_name, n_distinct (if at most 2), max_count (if over ``max_same``),
    std and ``drop``, by the rules of ``feature_drop_list``."""
    found, seen = frequent_values(df, columns, max_same, counters)
    most = found.groupBy("column_name").agg(F.max("n").alias("max_count"))
    numeric = [c for c in columns if df.schema[c].dataType.typeName() != "string"]
    spread = df.agg(*[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(-1.0))).alias(c) for c in numeric], F.count(F.lit(1)).alias("_rows")).first()
    stds = df.sparkSession.createDataFrame([(c, spread[c]) for c in numeric] + [(c, None) for c in columns if c not in numeric], "column_name string, std double")
    out = F.broadcast(stds).join(seen, "column_name").join(most, "column_name", "left")  # one row per column
    constant = (F.col("n_distinct") <= 1) | ((F.col("n_distinct") == 2) & (F.col("has_sentinel") == 1))
    numeric_rule = F.col("std").isNotNull() & ((F.col("std") < min_std) | F.col("max_count").isNotNull())
    drop = F.coalesce(constant, F.lit(False)) | numeric_rule
    return out.select("column_name", F.when(F.col("n_distinct") <= 2, F.col("n_distinct")).alias("n_distinct"), "max_count", "std", drop.cast("int").alias("drop"))
