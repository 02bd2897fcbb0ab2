"""Spark ML learners behind one interface, and out-of-fold fitting.

A learner is ``fit(train, features, params) -> predict``, where ``predict(df)`` adds ``pred``. The
label column is ``y``. Frames carry ``iter``, ``fold`` and ``row_id``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.operators import boosting, coordinates
from foldwright.operators.folds import head_fraction
from foldwright.operators.library import missing_work
from foldwright.operators.neighbours import knn_classify, knn_join, knn_regress
from foldwright.operators.pairs import linear_ranker
from foldwright.session import materialise
from foldwright.sources import files

Predict = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame, Sequence[str], dict], Predict]

SEED = 231
COMMON = {"featuresCol": "_x", "labelCol": "y", "predictionCol": "pred"}


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


def _fit_plain(estimator, train: DataFrame, features: Sequence[str]) -> Predict:
    model = estimator.fit(assemble(train, features))

    def predict(df: DataFrame) -> DataFrame:
        return model.transform(assemble(df, features)).select(*df.columns, F.col("pred").cast("double").alias("pred"))

    return predict


def _fit_probability(estimator, train: DataFrame, features: Sequence[str], output: str = "probability") -> Predict:
    """Probability of class 1, or the predicted class."""
    model = estimator.fit(assemble(train, features))

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(assemble(df, features))
        pred = vector_to_array("probability")[1] if output == "probability" else F.col("pred")
        return out.select(*df.columns, pred.cast("double").alias("pred"))

    return predict


def linear(train, features, params):
    return _fit_plain(R.LinearRegression(**COMMON), train, features)


def ridge(train, features, params):
    """Penalty ``alpha`` on the sum of squares. Spark penalises the loss per row, on a label scaled to
    unit sample deviation, hence the conversion."""
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("s")).first()
    reg = params.get("alpha", 1.0) / stats["n"] * stats["s"]
    model = R.LinearRegression(
        **COMMON, elasticNetParam=0.0, regParam=reg, standardization=False, solver="l-bfgs", tol=1e-12, maxIter=500
    )
    return _fit_plain(model, train, features)


def lasso(train, features, params):
    model = R.LinearRegression(
        **COMMON, elasticNetParam=1.0, regParam=params.get("alpha", 0.01), standardization=False, tol=1e-12, maxIter=500
    )
    return _fit_plain(model, train, features)


def boosted_linear(train, features, params):
    """Linear booster: with ``num_rounds``, that many rounds of coordinate updates; else their limit. Penalties ``alpha`` on absolute values and ``lambda`` on half the squares, beside half the
    sum of squared errors. In the limit only the L2 part is converted to Spark's scaled label, as in ``ridge``."""
    if "num_rounds" in params:
        return coordinates.fit_rows(train, features, params)
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("s")).first()
    l1, l2 = params.get("alpha", 0.0), params.get("lambda", 0.0) * (stats["s"] or 0.0)
    mix = l1 / (l1 + l2) if l1 + l2 else 0.0
    model = R.LinearRegression(
        **COMMON, regParam=(l1 + l2) / stats["n"], elasticNetParam=mix, standardization=False, solver="l-bfgs", tol=1e-12, maxIter=500
    )
    return _fit_plain(model, train, features)


def huber(train, features, params):
    """Robust linear regression, in place of an epsilon-insensitive one. ``C`` weighs the losses against half the
    squared coefficients."""
    epsilon = 1.0 + params.get("epsilon", 0.1)
    reg = 1.0 / (params["C"] * train.count()) if "C" in params else 0.0
    model = R.LinearRegression(
        **COMMON, loss="huber", epsilon=epsilon, regParam=reg, standardization=False, maxIter=params.get("max_iter", 100)
    )
    return _fit_plain(model, train, features)


def logistic(train, features, params):
    reg = 0.0
    if "C" in params:
        reg = 1.0 / (params["C"] * train.count())
    elif "alpha" in params or "lambda" in params:
        reg = (params.get("alpha", 0.0) + params.get("lambda", 0.0)) / train.count()
    total = params.get("alpha", 0.0) + params.get("lambda", 0.0)
    mix = params.get("alpha", 0.0) / total if total else 0.0
    # penalties are on the coefficients of the features as they are
    model = C.LogisticRegression(
        **COMMON, regParam=reg, elasticNetParam=mix, standardization=False, tol=1e-8, maxIter=params.get("max_iter", 200)
    )
    return _fit_probability(model, train, features, params.get("output", "probability"))


def multinomial(train, features, params):
    """Softmax over classes 1..n; labels are shifted to start at 0 and shifted back."""
    l1, l2 = params.get("alpha", 0.0), params.get("lambda", 0.0)
    model = C.LogisticRegression(
        **COMMON, family="multinomial", regParam=(l1 + l2) / train.count(), elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0,
        standardization=False, maxIter=params.get("max_iter", 30),
    )
    predict = _fit_plain(model, train.withColumn("y", F.col("y") - 1), features)
    return lambda df: predict(df).withColumn("pred", F.col("pred") + 1)


def _forest(cls, params, depth: int):
    return cls(
        **COMMON,
        numTrees=int(params.get("n_estimators", 300)),
        featureSubsetStrategy=str(params.get("max_features", 0.7)),
        maxDepth=int(params.get("max_depth", depth)),
        seed=SEED,
    )


def forest(train, features, params):
    return _fit_plain(_forest(R.RandomForestRegressor, params, 5), train, features)


def forest_class(train, features, params):
    return _fit_probability(_forest(C.RandomForestClassifier, params, 5), train, features)


def forest_deep(train, features, params):
    """Deep forest with a feature share per split, in place of randomised thresholds."""
    return _fit_plain(_forest(R.RandomForestRegressor, params, 20), train, features)


def forest_deep_class(train, features, params):
    return _fit_probability(_forest(C.RandomForestClassifier, params, 20), train, features)


@dataclass(frozen=True)
class Boosting:
    """How a family of boosted trees reads its parameters: loss, watched metric, default penalty and depth, label scale."""

    objective: str = "squared"
    metric: str = "rmse"
    lam: float = 1.0
    max_depth: int = 6
    log_target: bool = False

    def settings(self, params: dict) -> boosting.Settings:
        objective = "rmspe" if params.get("weighted") else self.objective
        return boosting.Settings(
            num_rounds=int(params.get("num_rounds", params.get("n_estimators", 100))),
            max_depth=int(params.get("max_depth", self.max_depth)),
            eta=float(params.get("eta", params.get("learning_rate", 0.1))),
            lam=float(params.get("lambda", self.lam)),
            alpha=float(params.get("alpha", 0.0)),
            gamma=float(params.get("gamma", 0.0)),
            min_child_weight=float(params.get("min_child_weight", 1.0)),
            subsample=float(params.get("subsample", 1.0)),
            colsample=float(params.get("colsample_bytree", params.get("max_features", 1.0))),
            max_bin=int(params.get("max_bin", 64)),
            objective=objective,
            metric=params.get("eval_metric", "rmspe" if params.get("weighted") else self.metric),
            patience=int(params.get("early_stopping_rounds", 0)),
            seed=int(params.get("seed", SEED)),
        )

    def label(self) -> Column:
        return F.log1p("y") if self.log_target else F.col("y").cast("double")

    def back(self, pred: Column) -> Column:
        """On the scale of the label; predictions of logs are clipped at 0 before going back."""
        return F.expm1(F.greatest(pred, F.lit(0.0))) if self.log_target else pred


# The families of boosted trees; ``gbf`` and ``gbfC`` have no penalty of their own and depth 3 unless told.
BOOSTED = {
    "gbf": Boosting(lam=0.0, max_depth=3),
    "gbfC": Boosting("logistic", "logloss", lam=0.0, max_depth=3),
    "xgb_tree": Boosting(),
    "xgb_log_target": Boosting(metric="rmspe_log", log_target=True),
    "xgb_linear_fix": Boosting(),
    "xgb_linear_fix_log": Boosting(),
    "xgb_fix": Boosting("logistic", "logloss"),
    "xgb_fix_log": Boosting("logistic", "logloss"),
    "xgb_tree_auc": Boosting("logistic", "auc"),
    "xgb_tree_log": Boosting("logistic", "logloss"),
}


def boosted(train, features, params, family: Boosting = BOOSTED["xgb_tree"]):
    """Boosted trees. A 0/1 column ``is_valid`` in the training frame marks the watch set: its rows teach nothing, and
    with ``early_stopping_rounds`` the rounds up to its best loss are kept."""
    watched = F.when(F.col("is_valid") == 1, 0).otherwise(-1) if "is_valid" in train.columns else F.lit(-1)
    rows = train.select(watched.alias("part"), family.label().alias("y"), F.xxhash64("row_id").alias("key"), *features)
    made = boosting.boost(rows, features, family.settings(params))
    return lambda df: made.predict(df).withColumn("pred", family.back(F.col("pred")))


def two_direction(train, features, params):
    """1.5 times a model of y plus 8.5 times a model of ln(y).

    The first holds out the head of the rows for early stopping, the second the tail (rows reversed).
    """
    fraction = params.get("valid_size", 0.07843291)
    ahead = boosted(head_fraction(train, "row_id", fraction), features, params)
    behind = boosted(head_fraction(train.withColumn("y", F.log("y")), "row_id", fraction, ascending=False), features, params)

    def predict(df: DataFrame) -> DataFrame:
        both = behind(ahead(df).withColumnRenamed("pred", "_first"))
        blended = F.lit(1.5) * F.col("_first") + F.lit(8.5) * F.col("pred")
        return both.select(*df.columns, blended.alias("pred"))

    return predict


def poisson(train, features, params):
    model = R.GeneralizedLinearRegression(**COMMON, family="poisson", link="log", regParam=params.get("lambda", 0.0))
    return _fit_plain(model, train, features)


def svc(train, features, params):
    """Linear support vector classification; ``pred`` is the signed margin."""
    n = train.count()
    reg = 1.0 / (params.get("C", 1.0) * n)
    fitted = C.LinearSVC(**COMMON, regParam=reg, standardization=False, maxIter=params.get("max_iter", 30)).fit(assemble(train, features))

    def predict(df: DataFrame) -> DataFrame:
        out = fitted.transform(assemble(df, features))
        return out.select(*df.columns, vector_to_array("rawPrediction")[1].alias("pred"))

    return predict


def factorisation(train, features, params):
    model = R.FMRegressor(
        **COMMON,
        factorSize=int(params.get("rank", 8)),
        maxIter=int(params.get("max_iter", 100)),
        stepSize=float(params.get("learn_rate", 0.01)),
        regParam=float(params.get("regular", 0.01)),
        solver=params.get("solver", "gd"),
        seed=SEED,
    )
    return _fit_plain(model, train, features)


def pairwise(train, features, params):
    """Pairwise ranking: the linear score with the least exponential loss over all preference pairs, inside ``groups`` if
    these columns are named. ``pred`` is the score."""
    weights = linear_ranker(train, features, "y", tuple(params.get("groups", ())), int(params.get("max_iter", 30)), float(params.get("l2", 1e-3)))

    def predict(df: DataFrame) -> DataFrame:
        return df.withColumn("pred", sum((F.lit(c) * F.col(f) for f, c in weights.items()), F.lit(0.0)))

    return predict


def adaboost(train, features, params):
    """Boosted ensemble of depth-8 regression trees with reweighted rows (linear loss).

    Each round writes the new weights, so the plan of a round does not contain the earlier ones.
    """
    rounds = int(params.get("n_estimators", 20))
    rows = materialise(assemble(train, features).select("row_id", "_x", "y", F.lit(1.0).alias("_w")), "boost")
    trees, says = [], []
    for number in range(rounds):
        tree = R.DecisionTreeRegressor(**COMMON, maxDepth=int(params.get("max_depth", 8)), weightCol="_w", seed=SEED + number)
        fitted = tree.fit(rows)
        errors = fitted.transform(rows).withColumn("_e", F.abs(F.col("y") - F.col("pred")))
        # the loss is a share of the largest error, so its mean needs no second pass
        total = errors.agg(F.max("_e").alias("top"), F.sum(F.col("_w") * F.col("_e")).alias("we"), F.sum("_w").alias("w")).first()
        top = total["top"]
        if not top:
            trees.append(fitted)
            says.append(1.0)
            break
        loss = F.col("_e") / F.lit(top)
        mean_loss = total["we"] / top / total["w"]
        if mean_loss >= 0.5 and trees:
            break
        beta = mean_loss / max(1.0 - mean_loss, 1e-12)
        trees.append(fitted)
        says.append(-math.log(beta) if beta > 0 else 1.0)
        if mean_loss >= 0.5 or number == rounds - 1:
            break
        reweighted = errors.select("row_id", "_x", "y", (F.col("_w") * F.pow(F.lit(beta), F.lit(1.0) - loss)).alias("_w"))
        rows = materialise(reweighted, "boost")

    def predict(df: DataFrame) -> DataFrame:
        out = assemble(df, features)
        for t, fitted in enumerate(trees):
            out = fitted.transform(out).withColumnRenamed("pred", f"_t{t}")
        votes = F.array_sort(F.array(*[F.struct(F.col(f"_t{t}").alias("p"), F.lit(abs(s)).alias("s")) for t, s in enumerate(says)]))
        half = sum(abs(s) for s in says) / 2
        # weighted median: the first value at which the running weight reaches half
        state = F.aggregate(
            votes,
            F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p")),
            lambda acc, v: F.struct(
                (acc["w"] + v["s"]).alias("w"),
                F.when(acc["p"].isNull() & (acc["w"] + v["s"] >= half - 1e-12), v["p"]).otherwise(acc["p"]).alias("p"),
            ),
        )
        return out.withColumn("pred", state["p"]).select(*df.columns, "pred")

    return predict


def _neighbours_of(decide, default_k: int) -> Fit:
    """A learner that keeps its training rows and asks ``decide`` about the nearest of them."""

    def fit(train, features, params):
        vector = F.array(*[F.col(f).cast("double") for f in features]).alias("vector")
        refs = train.select(F.col("row_id").alias("ref_id"), vector)
        k, weights = int(params.get("n_neighbors", default_k)), params.get("weights", "distance")

        def predict(df: DataFrame) -> DataFrame:
            near = knn_join(df.select(F.col("row_id").alias("query_id"), vector), refs, k, probes=params.get("probes"))
            preds = decide(near, train.select("row_id", "y"), weights=weights)
            return df.join(preds.select(F.col("query_id").alias("row_id"), F.col("pred").cast("double").alias("pred")), "row_id").select(*df.columns, "pred")

        return predict

    return fit


# Names under which parameter spaces and recipes refer to learners.
LEARNERS: dict[str, Fit] = {
    "linear": linear,
    "ridge": ridge,
    "lasso": lasso,
    "logistic": logistic,
    "svr": huber,
    "svc": svc,
    "rf": forest,
    "rfC": forest_class,
    "extratree": forest_deep,
    "extratreeC": forest_deep_class,
    **{name: partial(boosted, family=family) for name, family in BOOSTED.items()},
    "xgb_linear": boosted_linear,
    "xgb_binary": logistic,
    "xgb_log": logistic,
    "xgb_auc": logistic,
    "xgb_rank": pairwise,
    "xgb_count": poisson,
    "xgb_multi": multinomial,
    "xgb_art": two_direction,
    "fm": factorisation,
    "adaboost": adaboost,
    "knn": _neighbours_of(knn_regress, 50),
    "knnC": _neighbours_of(knn_classify, 50),
}

# Learners whose watch set is the validation fold itself.
WATCHED = {"xgb_tree", "xgb_linear_fix", "xgb_linear_fix_log", "xgb_fix", "xgb_fix_log", "xgb_tree_auc", "xgb_tree_log", "xgb_log_target"}


def fold_table(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The feature table, written once, partitioned by (iter, fold): a fit on the other folds is a
    partition-pruned scan and no fold is copied."""
    columns = ["iter", "fold", "row_id", "y", *keep, *features]
    return materialise(df.select(*columns), "features", ("iter", "fold"))


def out_of_fold(
    table: DataFrame,
    learner: str,
    features: Sequence[str],
    k: int,
    iters: int = 1,
    params: dict | None = None,
    threads: int = 3,
    fail_to_zero: bool = False,
    model: str | None = None,
    parts: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Predictions (model, iter, fold, row_id, y, pred) for every row by a model that was not fitted on it.

    ``parts`` names the (iter, fold) to do, all by default. The learners in ``WATCHED`` choose their number of
    trees on the very fold that they predict.

    Folds are independent Spark jobs, submitted a few at a time; boosted trees of all folds grow in the same passes. With
    ``fail_to_zero`` a fold whose fit raises gets 0 and ``failed`` = 1 instead of ending the run.
    """
    fit = LEARNERS[learner]
    params = dict(params or {})
    if learner in BOOSTED and parts is None and not fail_to_zero:
        family = BOOSTED[learner]
        out, _ = boosting.out_of_fold_boosting(table, features, k, family.settings(params), iters, model or learner, family.label())
        return out.withColumn("pred", family.back(F.col("pred")))
    if learner == "xgb_linear" and "num_rounds" in params and parts is None and not fail_to_zero:
        wanted = table.filter(F.col("iter") < iters)
        return coordinates.out_of_fold_linear(wanted, features, params, model or learner)

    def one(part: tuple[int, int]) -> DataFrame:
        iteration, fold = part
        rows = table.filter(F.col("iter") == iteration)
        valid = rows.filter(F.col("fold") == fold)
        if learner in WATCHED:
            train = rows.withColumn("is_valid", (F.col("fold") == fold).cast("int"))
        else:
            train = rows.filter(F.col("fold") != fold)
        out = F.lit(model or learner)
        try:
            predicted = fit(train, features, params)(valid)
            failed = 0
        except Exception:
            if not fail_to_zero:
                raise
            predicted, failed = valid.withColumn("pred", F.lit(0.0)), 1
        columns = [out.alias("model"), "iter", "fold", "row_id", "y", "pred"]
        return predicted.select(*columns, *([F.lit(failed).alias("failed")] if fail_to_zero else []))

    parts = [(i, f) for i in range(iters) for f in range(k)] if parts is None else list(parts)
    with ThreadPool(min(threads, len(parts))) as pool:
        pieces = pool.map(inheritable_thread_target(table.sparkSession)(one), parts)
    return reduce(DataFrame.unionByName, pieces)


def train_missing(
    table: DataFrame, path: str, models: dict[str, dict], features: Sequence[str], k: int, iters: int = 1, forced: Sequence[str] = ()
) -> DataFrame:
    """The prediction table at ``path`` after training what it lacks of ``models`` (learner to parameters).

    Only (model, iter, fold) parts that are not there, or belong to a ``forced`` model, are fitted; they take the
    place of what was there. A complete library is returned as it is.
    """
    spark, key = table.sparkSession, table.schema["row_id"].dataType.simpleString()
    cells = [(m, i, f) for m in models for i in range(iters) for f in range(k)]
    wanted = spark.createDataFrame(cells, "model string, iter int, fold int")
    try:
        todo = missing_work(wanted, files.read_predictions(spark, path, key), forced).collect()  # names only
    except AnalysisException:  # no table yet
        todo = wanted.collect()
    for m, params in models.items():
        parts = sorted((r["iter"], r["fold"]) for r in todo if r["model"] == m)
        if parts:
            files.append_predictions(out_of_fold(table, m, features, k, iters, params, parts=parts), path)
    return files.read_predictions(spark, path, key)


def refit(train: DataFrame, test: DataFrame, learner: str, features: Sequence[str], params: dict | None = None) -> DataFrame:
    """Fit on all training rows and predict the test rows."""
    return LEARNERS[learner](train, features, dict(params or {}))(test)


def isotonic_calibration(scores: DataFrame) -> DataFrame:
    """Calibrated probabilities: each fold is calibrated on the out-of-fold scores of the others.

    Equal scores become one weighted point. Spark's fit pools adjacent violators inside ranges of the
    score on the executors; only the pooled blocks meet on the driver.
    """
    binned = scores.withColumn("_p", F.col("pred") + F.lit(0.0))
    points = materialise(binned.groupBy("iter", "fold", "_p").agg(F.sum("y").alias("_y"), F.count(F.lit(1)).alias("_n")), "points")
    pieces = []
    for part in points.select("iter", "fold").distinct().orderBy("iter", "fold").collect():  # one row per fold
        others = points.filter((F.col("iter") == part["iter"]) & (F.col("fold") != part["fold"]))
        pooled = others.groupBy("_p").agg((F.sum("_y") / F.sum("_n")).alias("_l"), F.sum("_n").cast("double").alias("_n"))
        model = R.IsotonicRegression(featuresCol="_p", labelCol="_l", weightCol="_n", predictionCol="calibrated").fit(pooled)
        own = scores.filter((F.col("iter") == part["iter"]) & (F.col("fold") == part["fold"])).withColumn("_p", F.col("pred"))
        pieces.append(model.transform(own).drop("_p"))
    return reduce(DataFrame.unionByName, pieces)
