"""Cleaning, derived features and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions import scalar as S
from foldwright.operators.encoding import value_positions

# The model features, in the order of the feature frame.
FEATURES = [
    "store",
    "competition_distance",
    "competition_month",
    "competition_year",
    "promo",
    "promo2",
    "promo2_week",
    "promo2_year",
    "school_holiday",
    "day_of_week",
    "month",
    "day",
    "year",
    "store_type",
    "assortment",
]


def join_store(facts: DataFrame, stores: DataFrame) -> DataFrame:
    """Facts with their store. Spark broadcasts the store table when its size allows; otherwise it
    shuffles, and adaptive skew handling splits a store that holds a large share of the facts."""
    return facts.join(stores, "store")


def drop_closed(df: DataFrame) -> DataFrame:
    """Keep rows that are not closed and have a non-zero target; nulls are kept."""
    return df.filter(S.is_not_zero(F.col("open")) & S.is_not_zero(F.col("sales")))


def default_open(df: DataFrame) -> DataFrame:
    """An unknown ``open`` flag counts as open. Runs before the general null fill."""
    return df.withColumn("open", F.coalesce(F.col("open"), F.lit(1)))


def fill_nulls(df: DataFrame) -> DataFrame:
    """0 for numbers, '0' for text."""
    return df.na.fill(0).na.fill("0")


def fill_sentinel(df: DataFrame) -> DataFrame:
    return df.na.fill(-1).na.fill("-1")


def build_features(df: DataFrame, state_holiday: bool = False) -> DataFrame:
    """Clean a merged frame and derive its feature columns, all double, next to its other columns."""
    df = fill_nulls(default_open(df))
    derived = {part: S.date_part_from_text(F.col("date_text"), part) for part in ("year", "month", "day")}
    derived["store_type"] = S.ordinal_code(F.col("store_type"), S.STORE_TYPE_CODES)
    derived["assortment"] = S.ordinal_code(F.col("assortment"), S.ASSORTMENT_CODES)
    if state_holiday:
        derived["state_holiday"] = S.ordinal_code(F.col("state_holiday"), S.STATE_HOLIDAY_CODES)
    df = df.withColumns(derived)
    as_double = [c for c in FEATURES if c != "store"]
    return df.withColumns({c: F.col(c).cast("double") for c in as_double})


def features_only(df: DataFrame, *keep: str, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    return df.select(*keep, *features)


def leave_fold_out_means(df: DataFrame, values: dict[str, object], groups: Sequence[str] = ()) -> DataFrame:
    """Mean of each value over the rows of the *other* folds, per (iter, fold, groups).

    One aggregation serves all folds: the total of a repeat less the fold's own share. Nothing is
    repeated k times.
    """
    own = df.groupBy("iter", "fold", *groups).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{n}") for n, c in values.items()]
    )
    # at most one row per fold in each of these windows
    across = Window.partitionBy("iter", *groups)
    others = F.sum("_n").over(across) - F.col("_n")
    return own.select(
        "iter",
        "fold",
        *groups,
        others.alias("n_train"),
        *[
            F.when(others > 0, (F.sum(f"_s_{n}").over(across) - F.col(f"_s_{n}")) / others).alias(n)
            for n in values
        ],
    )


def leave_fold_out_moments(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Count, means and centred (co)moments over the rows of the other folds, per (iter, fold).

    Columns: ``n``, ``mean_<c>``, ``ss_<c>`` (sum of squared deviations) and ``sp_<a>_<b>``.
    Fold moments are combined around the overall mean, which avoids cancellation.
    """
    pairs = list(pairs)
    products = [(c, c) for c in columns] + pairs
    own = df.groupBy("iter", "fold").agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[
            (F.covar_pop(a, b) if a != b else F.var_pop(a)).alias(f"_v_{a}_{b}")
            for a, b in products
        ],
    )
    repeat = Window.partitionBy("iter")  # one row per fold
    own = own.withColumns(
        {
            "_all": F.sum("_n").over(repeat),
            **{f"_all_{c}": F.sum(F.col("_n") * F.col(f"_m_{c}")).over(repeat) / F.sum("_n").over(repeat) for c in columns},
        }
    )
    shifted = {
        f"_dev_{a}_{b}": F.col("_n")
        * (F.col(f"_v_{a}_{b}") + (F.col(f"_m_{a}") - F.col(f"_all_{a}")) * (F.col(f"_m_{b}") - F.col(f"_all_{b}")))
        for a, b in products
    }
    own = own.withColumns(shifted)
    n_train = F.col("_all") - F.col("_n")
    means = {c: (F.col("_all") * F.col(f"_all_{c}") - F.col("_n") * F.col(f"_m_{c}")) / n_train for c in columns}

    def centred(a: str, b: str):
        rest = F.sum(f"_dev_{a}_{b}").over(repeat) - F.col(f"_dev_{a}_{b}")
        return rest - n_train * (means[a] - F.col(f"_all_{a}")) * (means[b] - F.col(f"_all_{b}"))

    return own.select(
        "iter",
        "fold",
        n_train.alias("n"),
        *[means[c].alias(f"mean_{c}") for c in columns],
        *[centred(c, c).alias(f"ss_{c}") for c in columns],
        *[centred(a, b).alias(f"sp_{a}_{b}") for a, b in pairs],
    )


def standardise_by_fold(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standard scores of a frame with ``iter`` and ``fold``: each row is scaled by the mean and the
    *population* deviation of the rows outside its fold. A constant column is only centred."""
    stats = leave_fold_out_moments(df, columns)
    # one row per (iter, fold): bounded by the fold arguments
    joined = df.join(F.broadcast(stats), ["iter", "fold"])
    scaled = {}
    for c in columns:
        std = F.sqrt(F.col(f"ss_{c}") / F.col("n"))
        scaled[c] = (F.col(c) - F.col(f"mean_{c}")) / F.when(std > 0, std).otherwise(F.lit(1.0))
    return joined.withColumns(scaled).select(*df.columns)


def standardise(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale ``other`` by the statistics of ``train`` (population deviation)."""
    stats = train.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    ).first()
    scaled = {}
    for c in columns:
        mean, std = float(stats[f"_m_{c}"]), float(stats[f"_s_{c}"]) or 1.0
        scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(std)
    return other.withColumns(scaled)


def log_truncated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: S.log_of_truncated(F.col(c)) for c in columns})


def feature_drop_list(
    df: DataFrame, columns: Sequence[str], min_std: float = 0.1, max_same: int = 140_000
) -> DataFrame:
    """Columns worth removing: one row per column with its statistics and ``drop``.

    A column goes when it has at most one distinct value, or two of which one is the -1 that stands
    for null; a numeric column also goes when its population deviation is below ``min_std`` or one
    value occurs more than ``max_same`` times.

    Values are counted per (column, value) with map-side combining, so a value that fills most of a
    column travels as one row per task.
    """
    numeric = [f.name for f in df.schema.fields if f.name in columns and f.dataType.typeName() != "string"]
    spread = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.coalesce(F.col(c).cast("string"), F.lit("-1")).alias("value"),
                    (F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) if c in numeric else F.lit(None).cast("double")).alias("number"),
                )
                for c in columns
            ]
        )
    )
    counts = df.select(spread.alias("_s")).select("_s.*").groupBy("column_name", "value", "number").count()
    is_sentinel = F.coalesce(F.col("number") == -1, F.col("value") == "-1")
    mean = F.sum(F.col("number") * F.col("count")) / F.sum("count")
    per_column = counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.max(is_sentinel.cast("int")).alias("has_sentinel"),
        F.max("count").alias("max_count"),
        mean.alias("_mean"),
    )
    # deviation in one pass over the rows, without a shuffle of the values
    spread_of = [(c, F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)))) for c in numeric]
    cells = [F.struct(F.lit(c).alias("column_name"), s.alias("std")) for c, s in spread_of]
    none = F.array().cast("array<struct<column_name:string,std:double>>")
    long = df.agg(F.array(*cells).alias("_a") if cells else F.max(F.lit(None)).alias("_a"))
    long = long.select(F.explode(F.col("_a") if cells else none).alias("_s")).select("_s.*")
    # one row per column on both sides
    joined = per_column.join(F.broadcast(long), "column_name", "left")
    constant = (F.col("n_distinct") <= 1) | ((F.col("n_distinct") == 2) & (F.col("has_sentinel") == 1))
    numeric_rule = F.col("std").isNotNull() & ((F.col("std") < min_std) | (F.col("max_count") > max_same))
    return joined.select(
        "column_name", "n_distinct", "has_sentinel", "max_count", "std", (constant | numeric_rule).cast("int").alias("drop")
    )


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """0-based position of a category among the sorted distinct values; null stays null.

    The distinct values are ranked on their own: a hot category is one row by then.
    """
    return df.join(value_positions(df, col, out), col, "left")


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str) -> DataFrame:
    """One 0/1 column per listed category."""
    return df.withColumns({f"{prefix}{v}": (F.col(col) == v).cast("int") for v in values})
