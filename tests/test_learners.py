"""Invariants of fitted learners: coverage, no leakage of the own fold, calibration, stacking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import features as X
from foldwright.operators import learners as LE
from foldwright.operators import library as L
from foldwright.operators import search as SE
from foldwright.operators import stacking as ST
from foldwright.operators.folds import stratified_folds

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 2))
    y = 5 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 300)
    return x, y


@pytest.fixture(scope="module")
def table(spark, points):
    x, y = points
    rows = [(i, str(i % 2), float(a), float(b), float(t), float(t > 5)) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id bigint, s string, a double, b double, y double, c double")
    return LE.fold_table(stratified_folds(df, "s", 3, 1), FEATURES, keep=["c"])


@pytest.fixture(scope="module")
def labelled(table):
    return table.withColumn("y", F.col("c"))


def closed_form(table, alpha):
    rows = table.toPandas()
    out = {}
    for f in range(3):
        train, valid = rows[rows.fold != f], rows[rows.fold == f]
        xm, ym = train[FEATURES].mean(), train.y.mean()
        xc = (train[FEATURES] - xm).to_numpy()
        beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ (train.y - ym).to_numpy())
        pred = ym + (valid[FEATURES] - xm).to_numpy() @ beta
        out.update(dict(zip(valid.row_id, pred)))
    return out


@pytest.mark.parametrize("learner, alpha", [("linear", 0.0), ("ridge", 50.0)])
def test_linear_models_match_closed_form(table, learner, alpha):
    got = LE.out_of_fold(table, learner, FEATURES, 3, 1, {"alpha": alpha}).toPandas()
    want = closed_form(table, alpha)
    assert len(got) == 300
    assert np.allclose(got.pred, got.row_id.map(want), atol=1e-5)


CHEAP = {"n_estimators": 3, "num_rounds": 3, "max_depth": 3, "max_iter": 10}


@pytest.mark.parametrize("learner", ["lasso", "rf", "extratree", "gbf", "xgb_tree", "xgb_linear", "svr", "xgb_count", "xgb_rank", "xgb_art", "fm", "adaboost", "xgb_log_target"])
def test_regressors_cover_every_row_once(table, learner):
    got = LE.out_of_fold(table.withColumn("y", F.greatest("y", F.lit(0.1))), learner, FEATURES, 3, 1, CHEAP).toPandas()
    assert sorted(got.row_id) == list(range(300))
    assert np.isfinite(got.pred).all()


@pytest.mark.parametrize("learner", ["logistic", "rfC", "extratreeC", "gbfC", "xgb_fix", "xgb_binary", "svc"])
def test_classifiers_rank_well(labelled, learner):
    out = LE.out_of_fold(labelled, learner, FEATURES, 3, 1, CHEAP)
    assert out.count() == 300
    aucs = [r["score"] for r in L.score(out, "auc").collect()]
    assert len(aucs) == 3 and min(aucs) > 0.8


def test_multinomial_keeps_labels_from_one(table):
    three = table.withColumn("y", F.when(F.col("a") > 0.5, 3.0).when(F.col("a") > -0.5, 2.0).otherwise(1.0))
    got = LE.out_of_fold(three, "xgb_multi", FEATURES, 3, 1, CHEAP).toPandas()
    assert set(got.pred) <= {1.0, 2.0, 3.0} and (got.pred == got.y).mean() > 0.8


def test_pairwise_orders_like_the_label(table):
    got = LE.out_of_fold(table, "xgb_rank", FEATURES, 3, 1, {"pairs_per_row": 2}).toPandas()
    assert got.pred.rank().corr(got.y.rank()) > 0.9


def test_failing_fit_gives_zeros(table):
    out = LE.out_of_fold(table, "xgb_count", FEATURES, 3, 1, {"lambda": -1.0}, fail_to_zero=True)
    assert out.agg(F.min("failed"), F.max(F.abs("pred"))).first() == (1, 0.0)
    with pytest.raises(Exception):
        LE.out_of_fold(table, "xgb_count", FEATURES, 3, 1, {"lambda": -1.0})


def test_isotonic_is_monotone(labelled):
    scores = LE.out_of_fold(labelled, "logistic", FEATURES, 3, 1, {"C": 1.0})
    out = LE.isotonic_calibration(scores).toPandas()
    assert len(out) == 300
    for _, part in out.groupby("fold"):
        assert (part.sort_values("pred").calibrated.diff().dropna() >= -1e-9).all()


def test_standardise_uses_other_folds_only(table):
    got = X.standardise_by_fold(table, ["a"]).toPandas().set_index("row_id").a
    rows = table.toPandas().set_index("row_id")
    for f in range(3):
        other, own = rows[rows.fold != f].a, rows[rows.fold == f].a
        assert np.allclose(got[own.index], (own - other.mean()) / other.std(ddof=0))


def test_constant_column_is_centred_only(table):
    out = X.standardise_by_fold(table.withColumn("k", F.lit(4.0)), ["k"])
    assert out.agg(F.max(F.abs("k"))).first()[0] == 0.0


def test_trials_and_best(spark, table):
    from foldwright.functions.sampling import Uniform

    trials = SE.trial_table(spark, {"alpha": Uniform(0, 500, 100)}, 3)
    predictions, summary = SE.evaluate_trials(table, "ridge", FEATURES, trials, "rmse", 3)
    assert predictions.count() == 900
    best = SE.best_trial(summary, "rmse").first()
    assert best["cv_mean"] == pytest.approx(summary.agg(F.min("cv_mean")).first()[0])
    assert best["family"] == "stand_ridge"


def test_stacking_over_two_models(spark, table):
    long = LE.out_of_fold(table, "linear", FEATURES, 3, 1).unionByName(LE.out_of_fold(table, "rf", FEATURES, 3, 1, CHEAP))
    names = ST.models_to_stack(long, "rmse", 100.0)
    assert names == ["linear", "rf"]
    matrix = ST.stack_matrix(long, names)
    assert matrix.count() == 300
    meta = LE.fold_table(matrix.join(table.select("row_id", "fold", "y", "a"), "row_id"), [*names, "a"])
    out = ST.stack_cv(meta, [*names, "a"], "ridge", 3, 1)
    assert out.count() == 300
    assert L.score(out, "rmse").agg(F.avg("score")).first()[0] < 0.2
    test = matrix.select("row_id", *names)
    averaged = ST.stack_test(meta, test, names, "linear", 1)
    assert averaged.count() == 300 and averaged.filter(F.col("pred").isNull()).count() == 0


def test_metrics_serve_spark_model_selection(table):
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from foldwright.functions.evaluator import MetricEvaluator

    rows = LE.assemble(table, FEATURES)
    model = LinearRegression(featuresCol="_x", labelCol="y", predictionCol="pred")
    grid = ParamGridBuilder().addGrid(model.regParam, [0.0, 10.0]).build()
    chosen = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MetricEvaluator("rmse"), numFolds=2, seed=1).fit(rows)
    assert chosen.avgMetrics[0] < chosen.avgMetrics[1]
    assert MetricEvaluator("gini").evaluate(chosen.transform(rows)) > 0.9
    assert MetricEvaluator("gini").isLargerBetter() and not MetricEvaluator("rmspe").isLargerBetter()
