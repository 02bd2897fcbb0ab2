"""Row-level column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal codes of the category letters.
STORE_TYPE_CODES = {"a": 1, "b": 2, "c": 3, "d": 4}
ASSORTMENT_CODES = {"a": 1, "b": 2, "c": 3}
STATE_HOLIDAY_CODES = {"a": 1, "b": 2, "c": 3}


def is_not_zero(col: Column) -> Column:
    """``col <> 0`` that keeps nulls."""
    return ~col.eqNullSafe(F.lit(0))


def ordinal_code(col: Column, codes: dict[str, int]) -> Column:
    """Category letter to its code as a double; text that is already a number is cast."""
    out = col.try_cast("double")
    for letter, code in codes.items():
        out = F.when(col == letter, F.lit(float(code))).otherwise(out)
    return out


def date_part_from_text(col: Column, part: str) -> Column:
    """Year, month or day of a ``yyyy-mm-dd`` text as a double."""
    position = {"year": 0, "month": 1, "day": 2}[part]
    return F.split(col, "-").getItem(position).cast("double")


def log_target(col: Column) -> Column:
    return F.log1p(col)


def unlog_target(col: Column) -> Column:
    return F.expm1(col)


def clip_negative(col: Column) -> Column:
    return F.greatest(col, F.lit(0.0))


def log_of_truncated(col: Column) -> Column:
    """ln(int(x) + 1): the value is truncated to a whole number first."""
    return F.log(col.cast("bigint").cast("double") + F.lit(1.0))


def logit(col: Column) -> Column:
    return F.log(col / (F.lit(1.0) - col))


def sign_label(col: Column) -> Column:
    """0 becomes -1, everything else +1."""
    return F.when(col == 0, F.lit(-1)).otherwise(F.lit(1))


def inverse_square_weight(col: Column) -> Column:
    """1 / y^2, and 0 where y is 0."""
    return F.when(col != 0, F.lit(1.0) / (col * col)).otherwise(F.lit(0.0))


def shift_scale(col: Column, low: Column, high: Column) -> Column:
    """(p - min + |min|) / (max - min + |min|)."""
    return (col - low + F.abs(low)) / (high - low + F.abs(low))


def minmax_if_negative(col: Column, low: Column, high: Column) -> Column:
    """Rescale to 0..1, but only when some value is below zero."""
    return F.when(low < 0, (col - low) / (high - low)).otherwise(col)


def model_key(feat: Column, model: Column, trial: Column) -> Column:
    """``feat_model`` or ``feat_model@trial``."""
    base = F.concat_ws("_", feat, model)
    return F.when(trial.isNull(), base).otherwise(F.concat_ws("@", base, trial.cast("string")))


def model_key_feat(key: Column) -> Column:
    return F.regexp_extract(key, r"^([^_]+)_", 1)


def model_key_model(key: Column) -> Column:
    return F.regexp_extract(key, r"^[^_]+_([^@]+)", 1)


def model_key_trial(key: Column) -> Column:
    return F.regexp_extract(key, r"@(\d+)$", 1).try_cast("int")


def rewrite_model_key(key: Column) -> Column:
    """``name.pred.n`` becomes ``name@n``; other keys stay."""
    return F.regexp_replace(key, r"^(.*)\.pred\.(\d+)$", "$1@$2")


def dense_text(values: Column, digits: int = 6) -> Column:
    """One vector as space-joined numbers."""
    return F.array_join(F.transform(values, lambda v: F.format_string(f"%.{digits}f", v)), " ")


def sparse_text(values: Column, digits: int = 6) -> Column:
    """``index:value`` pairs of the non-zero entries, indices from 0."""
    pairs = F.transform(
        values,
        lambda v, i: F.when(v != 0, F.format_string(f"%d:%.{digits}f", i, v)),
    )
    # array_join leaves null entries out, which drops the zeros
    return F.array_join(pairs, " ")


# Blends of two prediction columns.


def blend_linear(p1: Column, p2: Column, weight: float | Column) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return weight * p1 + (F.lit(1.0) - weight) * p2


def blend_ratio(p1: Column, p2: Column, weight: float) -> Column:
    return (p1 + F.lit(weight) * p2) / F.lit(1.0 + weight)


def blend_harmonic(p1: Column, p2: Column, weight: float) -> Column:
    return F.lit(2.0) / (F.lit(weight) / p1 + F.lit(1.0 - weight) / p2)


def blend_log(p1: Column, p2: Column, weight: float) -> Column:
    return F.lit(weight) * F.log(p1) + F.lit(1.0 - weight) * F.log(p2)


def blend_power(p1: Column, p2: Column, weight: float, pow1: float, pow2: float | None = None) -> Column:
    pow2 = pow1 if pow2 is None else pow2
    return F.lit(weight) * F.pow(p1, F.lit(pow1)) + F.lit(1.0 - weight) * F.pow(p2, F.lit(pow2))


def blend_product_over_sum(p1: Column, p2: Column) -> Column:
    return p1 * p2 / (p1 + p2)


def blend_mean(p1: Column, p2: Column) -> Column:
    return (p1 + p2) / F.lit(2.0)
