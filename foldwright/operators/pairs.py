"""Preference pairs for pairwise ranking: drawn partners, and sums over all pairs of a group.

The exponential pair loss exp(-(s_i - s_j)) of a better row i and a worse row j is a product, so sums over all
pairs follow from running sums of exp(s) and exp(-s) along the labels: a group of n rows costs a ranking of its labels, not
n^2 pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.hashing import hash_uniform
from foldwright.operators.ranking import ranked_by_value
from foldwright.session import materialise, small_side


def preference_pairs(
    df: DataFrame, y: str = "y", row_id: str = "row_id", per_row: int = 1, seed: int = 711, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Each row with ``per_row`` partners drawn uniformly from all rows with a different label.

    Drawing, rather than listing, is the operator: the pairwise objective samples one partner per row
    and round. Rows are ranked by label; a rank outside the row's own run of equal labels is a
    partner, so a draw is an equi-join on a rank and its cost is linear in the rows.

    Output: ``row_id``, ``draw``, ``partner_id``, ``sign`` (+1 when the row has the higher label),
    and ``<c>`` / ``partner_<c>`` for carried columns.
    """
    ranked = ranked_by_value(df.select(row_id, y, *carry), y, True, row_id, rank="_rank", total="_n")
    ranked = materialise(ranked, "pair-ranks")  # used twice below
    runs = ranked.groupBy(y).agg((F.min("_rank") - 1).alias("_start"), F.count(F.lit(1)).alias("_run"))
    draws = ranked.join(small_side(runs), y).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
    free = F.col("_n") - F.col("_run")
    at = F.floor(hash_uniform(seed, F.col(row_id), F.col("draw")) * free).cast("bigint")
    at = F.when(at < F.col("_start"), at).otherwise(at + F.col("_run")) + 1
    picked = draws.filter(free > 0).withColumn("_at", at)
    partner = ranked.select(
        F.col("_rank").alias("_at"),
        F.col(row_id).alias("partner_id"),
        F.col(y).alias("_py"),
        *[F.col(c).alias(f"partner_{c}") for c in carry],
    )
    joined = picked.join(partner, "_at")
    return joined.select(
        row_id,
        "draw",
        "partner_id",
        F.when(F.col(y) > F.col("_py"), F.lit(1)).otherwise(F.lit(-1)).alias("sign"),
        *carry,
        *[f"partner_{c}" for c in carry],
    )


def pair_count(df: DataFrame, y: str = "y") -> DataFrame:
    """Number of ordered preference pairs (y_i > y_j), from label counts alone."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    return counts.agg(((F.pow(F.sum("_c"), F.lit(2.0)) - F.sum(F.col("_c") * F.col("_c"))) / 2).cast("bigint").alias("n_pairs"))


def _label_sums(df: DataFrame, y: str, score: Column, groups: Sequence[str]) -> DataFrame:
    """(groups, y): what lies below and above each label of a group: rows, sums of exp(score) and of exp(-score).

    Rows are first added up per label; labels of a group are then ranked over many tasks.
    """
    sums = df.groupBy(*groups, y).agg(F.count(F.lit(1)).alias("_c"), F.sum(F.exp(score)).alias("_up"), F.sum(F.exp(-score)).alias("_down"))
    names = ["_c", "_up", "_down"]
    ranked = ranked_by_value(sums, y, True, y, groups, rank="_r", running={f"{c}_to": F.col(c) for c in names}, totals={f"{c}_all": F.col(c) for c in names})
    below = {"_below": F.col("_up_to") - F.col("_up"), "_n_below": F.col("_c_to") - F.col("_c"), "_above": F.col("_down_all") - F.col("_down_to"), "_n_above": F.col("_c_all") - F.col("_c_to")}
    # where nothing lies below or above, the difference of sums is exactly nothing
    below["_below"] = F.when(below["_n_below"] > 0, below["_below"]).otherwise(0.0)
    below["_above"] = F.when(below["_n_above"] > 0, below["_above"]).otherwise(0.0)
    return ranked.select(*groups, y, *[e.alias(n) for n, e in below.items()])


def pair_gradients(df: DataFrame, score: Column, y: str = "y", groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``n_pairs`` and ``loss`` over the pairs in which the row is the better one, and ``gradient`` of the loss of
    all pairs of its group by its score. Rows with a null label or score are in no pair."""
    rows = df.withColumn("_s", F.when(F.col(y).isNotNull(), score.cast("double")))
    sums = _label_sums(rows.filter(F.col("_s").isNotNull()), y, F.col("_s"), groups)
    sums = small_side(sums.select(*[F.col(g).alias(f"_g{n}") for n, g in enumerate(groups)], F.col(y).alias("_y"), "_below", "_n_below", "_above"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{n}")) for n, g in enumerate(groups)]
    joined = rows.join(sums, [*on, F.col(y) == F.col("_y"), F.col("_s").isNotNull()] if on else [F.col(y) == F.col("_y"), F.col("_s").isNotNull()], "left")
    loss = F.exp(-F.col("_s")) * F.col("_below")
    gradient = F.exp(F.col("_s")) * F.col("_above") - loss
    told = {"n_pairs": F.coalesce(F.col("_n_below"), F.lit(0)).cast("long"), "loss": F.coalesce(loss, F.lit(0.0)), "gradient": F.coalesce(gradient, F.lit(0.0))}
    return joined.select(*df.columns, *[e.alias(n) for n, e in told.items()])


def _descend(evaluate, n: int, max_iter: int, tolerance: float) -> np.ndarray:
    """Quasi-Newton descent (BFGS) of ``evaluate(w) -> (loss, slope)`` from 0, halving steps that don't bring the loss down."""
    w, inverse = np.zeros(n), np.eye(n)
    loss, slope = evaluate(w)
    for _ in range(max_iter):
        step = -inverse @ slope
        if -(step @ slope) < tolerance:
            break
        for _ in range(20):
            new_loss, new_slope = evaluate(w + step)
            if new_loss <= loss + 1e-4 * (step @ slope):
                break
            step = step / 2
        else:
            break
        change = new_slope - slope
        w, loss, slope = w + step, new_loss, new_slope
        if (bend := change @ step) > 1e-12:
            side = np.eye(n) - np.outer(step, change) / bend
            inverse = side @ inverse @ side.T + np.outer(step, step) / bend
    return w


def linear_ranker(df: DataFrame, features: Sequence[str], y: str = "y", groups: Sequence[str] = (), max_iter: int = 30, l2: float = 1e-3, tolerance: float = 1e-8) -> dict[str, float]:
    """Weights of the linear score with the least log of the mean pair loss, plus ``l2`` / 2 times the squared weights
    of standardised features. A pass over the rows per evaluation; only sums come back."""
    # features are scaled so that scores, and with them exp, stay moderate
    spread = df.agg(*[F.stddev_pop(f).alias(f) for f in features], *[F.avg(f).alias(f"_m{n}") for n, f in enumerate(features)]).first()
    scale = np.array([spread[f] or 1.0 for f in features])
    x = F.array(*[(F.col(f).cast("double") - F.lit(float(spread[f"_m{n}"] or 0.0))) / F.lit(float(s)) for n, (f, s) in enumerate(zip(features, scale, strict=True))])
    rows = materialise(df.filter(F.col(y).isNotNull()).select(*groups, y, x.alias("_x")), "ranker")

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        score = sum((F.lit(float(c)) * F.get("_x", F.lit(n)) for n, c in enumerate(w)), F.lit(0.0))
        found = pair_gradients(rows, score, y, groups)
        slopes = [F.sum(F.col("gradient") * F.get("_x", F.lit(n))).alias(f"g{n}") for n in range(len(w))]
        r = found.agg(F.sum("loss").alias("loss"), F.sum("n_pairs").alias("n"), *slopes).first()
        if not r["n"]:
            return 0.0, np.zeros(len(w))
        slope = np.array([r[f"g{n}"] for n in range(len(w))]) / r["loss"]
        return float(np.log(r["loss"] / r["n"])) + l2 / 2 * float(w @ w), slope + l2 * w

    w = _descend(evaluate, len(features), max_iter, tolerance) / scale
    return dict(zip(features, w.tolist(), strict=True))
