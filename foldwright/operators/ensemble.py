"""Blend weights, greedy ensemble selection, recipes and prefix averages.

For squared-error metrics a blend whose coefficients sum to 1 has the residual ``sum(c_m e_m)``, so
its loss on a fold is ``c' G c`` with ``G_ij = avg(w e_i e_j)``. One aggregation over the rows gives
every G; the search itself then works on models^2 numbers per fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.metrics import METRICS
from foldwright.functions.scalar import inverse_square_weight
from foldwright.operators.bounds import BINS, RankBounds, prune
from foldwright.operators.library import score, to_long, to_wide
from foldwright.operators.ranking import ranked_by_value

# Fixed values of the selection: weights 0, 0.01, ..., 1 and the smallest gain worth a step.
WEIGHT_STEPS = 100
MIN_GAIN = 1e-6
#: Blends that one scoring job tries, as a row travels once per blend; and so few that bounds don't pay.
BLENDS_PER_JOB, FEW = 128, 16
MAX_EXPRESSION_MODELS = 16

GRAM_SCHEMA = "iter int, fold int, i string, j string, g double"


def metric_weight(metric: str, y: Column) -> Column:
    """Row weight that turns a metric into a weighted mean of squared errors."""
    if metric == "rmspe":
        return inverse_square_weight(y)
    if metric == "rmse":
        return F.lit(1.0)
    raise ValueError(f"{metric} is not a root mean square: use greedy_by_scoring")


def gram_matrix(wide: DataFrame, models: Sequence[str], metric: str = "rmspe", y: str = "y") -> DataFrame:
    """(iter, fold, i, j, g) for every ordered pair of models."""
    if len(models) <= MAX_EXPRESSION_MODELS:
        return gram_by_expressions(wide, models, metric, y)
    return gram_by_blocks(wide, models, metric, y)


def gram_by_expressions(wide: DataFrame, models: Sequence[str], metric: str = "rmspe", y: str = "y") -> DataFrame:
    """One aggregate column per pair of models: partial aggregation in the JVM, no row is multiplied."""
    weight = metric_weight(metric, F.col(y))
    errors = wide.select("iter", "fold", weight.alias("_w"), *[(F.col(y) - F.col(m)).alias(f"_e{i}") for i, m in enumerate(models)])
    pairs = [(i, j) for i in range(len(models)) for j in range(i, len(models))]
    stats = errors.groupBy("iter", "fold").agg(
        *[F.avg(F.col("_w") * F.col(f"_e{i}") * F.col(f"_e{j}")).alias(f"_g{i}_{j}") for i, j in pairs]
    )
    cells = []
    for i, j in pairs:
        for a, b in {(i, j), (j, i)}:
            cells.append(F.struct(F.lit(models[a]).alias("i"), F.lit(models[b]).alias("j"), F.col(f"_g{i}_{j}").alias("g")))
    return stats.select("iter", "fold", F.explode(F.array(*cells)).alias("_c")).select("iter", "fold", "_c.*")


def gram_by_blocks(wide: DataFrame, models: Sequence[str], metric: str = "rmspe", y: str = "y") -> DataFrame:
    """The same for a library of hundreds: each task adds up the upper triangle of E'WE per (iter, fold) and emits
    it as one vector. Vectors are added in two rounds, so that no task receives one from every other."""
    names = list(models)
    rows = wide.select(
        "iter",
        "fold",
        metric_weight(metric, F.col(y)).cast("double").alias("w"),
        *[(F.col(y) - F.col(m)).cast("double").alias(f"e{i}") for i, m in enumerate(names)],
    )
    columns = [f"e{i}" for i in range(len(names))]
    upper = np.triu_indices(len(names))

    def add_up(batches):
        sums: dict[tuple[int, int], list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(["iter", "fold"], sort=False):
                errors = part[columns].to_numpy()
                gram = errors.T @ (errors * part["w"].to_numpy()[:, None])
                held = sums.setdefault(key, [np.zeros_like(gram), 0])
                held[0] += gram
                held[1] += len(part)
        import pandas as pd

        for (iteration, fold), (gram, n) in sums.items():
            yield pd.DataFrame({"iter": [iteration], "fold": [fold], "n": [n], "gram": [gram[upper].tolist()]})

    def added(parts: DataFrame, *keys: str) -> DataFrame:
        return parts.groupBy("iter", "fold", *keys).agg(F.sum("n").alias("n"), Summarizer.sum(F.col("gram")).alias("gram"))

    partial = rows.mapInPandas(add_up, "iter int, fold int, n long, gram array<double>")
    partial = partial.select("iter", "fold", "n", array_to_vector("gram").alias("gram"))
    slots = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = added(added(partial.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(slots))), "slot"))
    # from here on one row per fold
    cells = summed.select("iter", "fold", "n", F.posexplode(vector_to_array("gram")).alias("pos", "cell"))
    table = F.array(*[F.lit(n) for n in names])
    ends = F.expr("array(" + ", ".join(map(str, np.cumsum(np.arange(len(names), 0, -1)))) + ")")
    row = F.size(F.filter(ends, lambda e: e <= F.col("pos")))
    cells = cells.withColumn("_i", row).withColumn("_j", F.col("pos") - F.get(ends, F.col("_i")) + F.lit(len(names)))
    one = F.struct(F.get(table, F.col("_i")).alias("i"), F.get(table, F.col("_j")).alias("j"))
    other = F.struct(F.get(table, F.col("_j")).alias("i"), F.get(table, F.col("_i")).alias("j"))
    both = F.when(F.col("_i") == F.col("_j"), F.array(one)).otherwise(F.array(one, other))
    return cells.select("iter", "fold", F.explode(both).alias("_c"), (F.col("cell") / F.col("n")).alias("g")).select("iter", "fold", "_c.*", "g")


def weight_grid(gram: DataFrame, first: str, second: str, steps: int = WEIGHT_STEPS) -> DataFrame:
    """Mean over folds of the metric of ``w * first + (1 - w) * second`` for every weight of the grid.

    Weights multiply aggregated moments (one row per fold), never the rows.
    """
    cell = lambda a, b: F.max(F.when((F.col("i") == a) & (F.col("j") == b), F.col("g")))
    moments = gram.groupBy("iter", "fold").agg(
        cell(first, first).alias("_aa"), cell(second, second).alias("_bb"), cell(first, second).alias("_ab")
    )
    grid = moments.withColumn("weight", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda s: s / F.lit(steps))))
    w, v = F.col("weight"), F.lit(1.0) - F.col("weight")
    loss = w * w * F.col("_aa") + F.lit(2.0) * w * v * F.col("_ab") + v * v * F.col("_bb")
    return grid.withColumn("_s", F.sqrt(F.greatest(loss, F.lit(0.0)))).groupBy("weight").agg(F.avg("_s").alias("score"))


@dataclass(frozen=True)
class Step:
    step: int
    model: str
    weight: float
    score: float


def gram_arrays(gram: DataFrame, models: Sequence[str]) -> np.ndarray:
    """folds x models x models: model-level numbers, whatever the number of rows."""
    cells = gram.toPandas()
    position = {m: p for p, m in enumerate(models)}
    folds = {key: p for p, key in enumerate(sorted(set(zip(cells["iter"], cells["fold"]))))}
    out = np.zeros((len(folds), len(models), len(models)))
    out[
        [folds[k] for k in zip(cells["iter"], cells["fold"])],
        cells["i"].map(position).to_numpy(),
        cells["j"].map(position).to_numpy(),
    ] = cells["g"].to_numpy()
    return out


def candidate_scores(grams: np.ndarray, blend: np.ndarray, steps: int = WEIGHT_STEPS) -> np.ndarray:
    """models x weights: mean over folds of the root loss of ``w * blend + (1 - w) * model``."""
    weights = np.arange(steps + 1) / steps
    own = np.einsum("i,fij,j->f", blend, grams, blend)
    cross = np.einsum("fij,i->fj", grams, blend)
    single = np.einsum("fii->fi", grams)
    w = weights[None, None, :]
    loss = w**2 * own[:, None, None] + 2 * w * (1 - w) * cross[:, :, None] + (1 - w) ** 2 * single[:, :, None]
    return np.sqrt(np.maximum(loss, 0.0)).mean(axis=0)


def greedy_select(gram: DataFrame, models: Sequence[str], steps: int = WEIGHT_STEPS) -> list[Step]:
    """Forward selection with replacement on a loss (lower is better).

    Step 0 is the best single model. Each further step blends in the model and weight with the lowest
    score, as long as that gains at least ``MIN_GAIN``. Models are tried from best to worst, so equal
    scores go to the better model and then to the smaller weight.
    """
    grams = gram_arrays(gram, models)
    singles = np.sqrt(np.maximum(np.einsum("fii->fi", grams), 0.0)).mean(axis=0)
    order = sorted(range(len(models)), key=lambda m: (round(singles[m], 9), models[m]))
    best = float(singles[order[0]])
    blend = np.zeros(len(models))
    blend[order[0]] = 1.0
    recipe = [Step(0, models[order[0]], 1.0, best)]
    for number in count(1):  # every step gains at least MIN_GAIN, so this ends
        scores = np.round(candidate_scores(grams, blend, steps), 9)
        chosen = None
        for m in order:
            at = int(scores[m].argmin())
            if best - scores[m, at] >= MIN_GAIN:
                best, chosen = float(scores[m, at]), (m, at / steps)
        if chosen is None:
            break
        m, weight = chosen
        blend *= weight
        blend[m] += 1.0 - weight
        recipe.append(Step(number, models[m], weight, best))
    return recipe


def greedy_by_scoring(
    wide: DataFrame, models: Sequence[str], metric: str, steps: int = WEIGHT_STEPS
) -> list[Step]:
    """Forward selection for a metric that is not a mean of squares (Gini, AUC, log loss).

    Every step tries all candidates and weights. For Gini and AUC, bounds from counts in ever finer bins leave the few
    that can win (``bounds``), and only these are ranked; for other metrics all are scored. The current blend is kept as
    one coefficient per model, so the plan does not grow from step to step.
    """
    direction = METRICS[metric]
    labels = wide.select("iter", "fold", "row_id", "y")
    sign = 1.0 if direction.higher_is_better else -1.0

    def cv(long: DataFrame, by: Sequence[str]):
        if metric == "gini" and bounds:  # the ordering by truth is known by now
            scored = bounds.exact_gini(long, by)
        else:
            scored = score(long, metric, groups=[*by, "iter", "fold"], labels=labels, label_groups=["iter", "fold"])
        return scored.groupBy(*by).agg(F.avg("score").alias("score")).collect()

    bounds = RankBounds(wide, models, metric) if metric in ("gini", "auc") else None
    singles = {r["model"]: r["score"] for r in cv(to_long(wide, models), ["model"])}
    order = sorted(models, key=lambda m: (-sign * round(singles[m], 9), m))
    best = singles[order[0]]
    blend = dict.fromkeys(models, 0.0)
    blend[order[0]] = 1.0
    recipe = [Step(0, order[0], 1.0, best)]
    for number in count(1):  # every step gains at least MIN_GAIN, so this ends
        # all of the current blend is no step, nor is any blend with a model that orders no row anew
        flat = bounds.flat if bounds else set()
        tries = [(m, s) for m in models if m not in flat for s in range(steps)]
        for bins in BINS if bounds else ():
            if len(tries) <= FEW:
                break
            ends = sign * bounds.bounds(blend, [(m, s / steps) for m, s in tries], bins)
            tries = prune(tries, ends.min(axis=1), ends.max(axis=1), sign * best + MIN_GAIN, MIN_GAIN)
        current = sum((F.lit(c) * F.col(m) for m, c in blend.items() if c), F.lit(0.0))
        found = []
        for low in range(0, len(tries), BLENDS_PER_JOB):
            # a constant list per row, so that the plan does not grow with the blends
            cells = [F.struct(F.lit(m).alias("model"), F.lit(s).alias("at"), F.lit(s / steps).alias("w"), F.lit(1 - s / steps).alias("v"), F.lit(models.index(m)).alias("n")) for m, s in tries[low : low + BLENDS_PER_JOB]]
            tried = wide.select("iter", "fold", "row_id", "y", current.alias("_now"), F.array(*[F.col(m).cast("double") for m in models]).alias("_all"), F.explode(F.array(*cells)).alias("_c"))
            pred = F.col("_c.w") * F.col("_now") + F.col("_c.v") * F.get("_all", F.col("_c.n"))
            found += cv(tried.select("iter", "fold", "row_id", "y", "_c.model", "_c.at", pred.alias("pred")), ["model", "at"])
        per_model: dict[str, tuple[float, int]] = {}
        for r in sorted(found, key=lambda r: (-sign * round(r["score"], 9), r["at"])):
            per_model.setdefault(r["model"], (r["score"], r["at"]))
        chosen = None
        for m in order:
            value, at = per_model.get(m, (best, 0))
            if sign * (value - best) >= MIN_GAIN:
                best, chosen = value, (m, at / steps)
        if chosen is None:
            break
        m, weight = chosen
        blend = {k: c * weight for k, c in blend.items()}
        blend[m] += 1.0 - weight
        recipe.append(Step(number, m, weight, best))
    return recipe


RECIPE_SCHEMA = T.StructType(
    [
        T.StructField("step", T.LongType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("score", T.DoubleType(), True),
    ]
)


def recipe_table(spark, recipe: Sequence[Step]) -> DataFrame:
    return spark.createDataFrame([(s.step, s.model, float(s.weight), float(s.score)) for s in recipe], RECIPE_SCHEMA)


def recipe_steps(table: DataFrame) -> list[Step]:
    """A stored recipe: one row per step."""
    return [Step(r["step"], r["model"], r["weight"], r["score"]) for r in table.orderBy("step").collect()]


def coefficients(recipe: Sequence[Step]) -> dict[str, float]:
    """The recipe folded into one coefficient per model; they sum to 1."""
    out: dict[str, float] = {}
    for s in recipe:
        if s.step == 0:
            out = {s.model: 1.0}
            continue
        out = {m: c * s.weight for m, c in out.items()}
        out[s.model] = out.get(s.model, 0.0) + 1.0 - s.weight
    return out


def replay(predictions: DataFrame, recipe: Sequence[Step], keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Ensemble prediction per row from the long table. Models outside the recipe are never read; a row that
    lacks a model of the recipe, or has one twice, gets null."""
    coefs = coefficients(recipe)
    weights = F.create_map(*[x for m, c in coefs.items() for x in (F.lit(m), F.lit(float(c)))])
    used = predictions.filter(F.col("model").isin(list(coefs)))
    total = F.sum(F.element_at(weights, F.col("model")) * F.col("pred"))
    return used.groupBy(*keys).agg(F.when(F.count("pred") == len(coefs), total).alias("pred"))


PREFIX_MEANS = {
    "arithmetic": (lambda p: p, lambda total, n: total / n),
    "log": (lambda p: F.log(p), lambda total, n: F.exp(total / n)),
    "harmonic": (lambda p: F.lit(1.0) / p, lambda total, n: n / total),
}


def prefix_average(wide: DataFrame, ranked_models: Sequence[str], kind: str = "arithmetic") -> DataFrame:
    """Mean of the best 1, 2, ... models of the ranking, one row per row and prefix length.

    ``log`` averages logarithms, which is the geometric mean.
    """
    into, back = PREFIX_MEANS[kind]
    cells, total = [], None
    for n, m in enumerate(ranked_models, start=1):
        total = into(F.col(m)) if total is None else total + into(F.col(m))
        cells.append(F.struct(F.lit(n).alias("n_models"), back(total, F.lit(float(n))).alias("pred")))
    return wide.select("iter", "fold", "row_id", "y", F.explode(F.array(*cells)).alias("_c")).select(
        "iter", "fold", "row_id", "y", "_c.*"
    )


def prefix_rank_average(predictions: DataFrame, ranked_models: Sequence[str]) -> DataFrame:
    """The same on ranks within model and fold: mean rank share of the best 1, 2, ... models."""
    keys = ["iter", "fold", "row_id", "y"]
    ranks = rank_normalise(predictions).select("model", *keys, F.col("rank_pred").alias("pred"))
    return prefix_average(to_wide(ranks, ranked_models, keys), ranked_models)


def prefix_scores(averages: DataFrame, metric: str) -> DataFrame:
    """CV score per prefix length, with the best length flagged (ties: the shorter one)."""
    scored = score(averages, metric, groups=["n_models", "iter", "fold"])
    summary = scored.groupBy("n_models").agg(F.avg("score").alias("score"))
    key = F.round("score", 9)
    key = -key if METRICS[metric].higher_is_better else key
    # one row per prefix length
    best = summary.agg(F.min_by("n_models", F.struct(key, F.col("n_models"))).alias("n")).scalar()
    return summary.withColumn("is_best", (F.col("n_models") == best).cast("int"))


def rank_normalise(predictions: DataFrame, groups: Sequence[str] = ("model", "iter", "fold")) -> DataFrame:
    """Rank of the prediction over the number of rows, per model and fold; ties by ``row_id``."""
    ranked = ranked_by_value(predictions, "pred", True, "row_id", groups, rank="_rank", total="_n")
    return ranked.withColumn("rank_pred", F.col("_rank") / F.col("_n")).drop("_rank", "_n")


def stored_submission_check(new: DataFrame, stored: DataFrame, known: dict[int, float], id_col: str = "id") -> DataFrame:
    """Gini of a new submission against each stored one, with its known score, and whether each
    (gini, known score) pair is no smaller than the next one."""
    from pyspark.sql import Window

    from foldwright.operators.ordered_metrics import normalised_gini

    both = stored.join(new.select(id_col, F.col("pred").alias("new_pred")), id_col)
    gini = normalised_gini(both, "pred", "new_pred", ["submission"], id_col)
    score_of = F.lit(None).cast("double")
    for number, value in known.items():
        score_of = F.when(F.col("submission") == number, F.lit(float(value))).otherwise(score_of)
    pairs = gini.withColumns({"known_score": score_of, "gini": F.round("gini", 9)})
    order = Window.orderBy("submission")  # one row per stored submission
    here = F.struct("gini", "known_score")
    after = F.lead(here).over(order)
    return pairs.withColumn("in_order", F.when(after.isNull(), F.lit(1)).otherwise((here >= after).cast("int")))
