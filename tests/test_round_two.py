"""Penalties against direct solutions, replaced parts, strict replay, and inputs that used to fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import ensemble as E
from foldwright.operators import learners as LE
from foldwright.operators.boosting import Watch
from foldwright.operators.features import feature_drop_list
from foldwright.operators.ranking import CODE, ordering_buckets, ranked_by_value
from foldwright.sources import files


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(0, 5, 400)
    y = 3 * x + draw.normal(0, 2, 400)
    return x, y, (y > 1).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id bigint, x double, y double")


def slope(spark, learner, params, x, y):
    asked = spark.createDataFrame([(0.0,), (0.01,)], "x double")
    at = {r.x: r.pred for r in LE.LEARNERS[learner](frame(spark, x, y), ["x"], params)(asked).collect()}
    return (at[0.01] - at[0.0]) / 0.01, at[0.0]


@pytest.mark.parametrize("l1, l2", [(0.0, 20000.0), (5000.0, 0.0), (5000.0, 20000.0)])
def test_linear_booster_penalties(spark, points, l1, l2):
    x, y, _ = points
    sp, ss = ((x - x.mean()) * (y - y.mean())).sum(), ((x - x.mean()) ** 2).sum()
    made, _ = slope(spark, "xgb_linear", {"alpha": l1, "lambda": l2}, x, y)
    assert made == pytest.approx(np.sign(sp) * max(abs(sp) - l1, 0) / (ss + l2), rel=1e-4)


def test_logistic_penalty(spark, points):
    x, _, z = points
    c, w = 0.001, np.zeros(2)
    for _ in range(100):  # Newton steps on C * losses + half the squared slope
        p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        gradient = np.array([c * ((p - z) * x).sum() + w[0], c * (p - z).sum()])
        h = c * p * (1 - p)
        w = w - np.linalg.solve([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum()]], gradient)
    predict = LE.LEARNERS["logistic"](frame(spark, x, z), ["x"], {"C": c})
    got = predict(spark.createDataFrame([(2.0,)], "x double")).first().pred
    assert np.log(got / (1 - got)) == pytest.approx(2 * w[0] + w[1], rel=1e-3)


def test_robust_fit_uses_its_penalty(spark, points):
    x, y, _ = points
    loose, tight = (slope(spark, "svr", {"C": c}, x, y)[0] for c in (1e6, 1e-5))
    assert loose == pytest.approx(3, abs=0.1)
    assert abs(tight) < 0.7 * abs(loose)


def test_depth_is_not_cut(spark, points):
    with pytest.raises(ValueError):
        LE.LEARNERS["gbf"](frame(spark, points[0], points[1]), ["x"], {"max_depth": 31})


def test_parts_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    for value in (1.0, 2.0):
        files.append_predictions(spark.createDataFrame([("a", 0, 0, 1, value)], files.PREDICTION_SCHEMA), path)
    assert [r.pred for r in files.read_predictions(spark, path).collect()] == [2.0]


def test_replay_wants_every_model(spark):
    rows = spark.createDataFrame([(1, "a", 10.0), (2, "a", 10.0), (2, "b", 20.0), (3, "b", None), (3, "a", 1.0)], "row_id bigint, model string, pred double")
    recipe = [E.Step(0, "a", 1.0, 0.0), E.Step(1, "b", 0.5, 0.0)]
    assert {r.row_id: r.pred for r in E.replay(rows, recipe).collect()} == {1: None, 2: 15.0, 3: None}


def test_drop_list_of_text_only(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z")], "one string, many string")
    assert {r.column_name: r["drop"] for r in feature_drop_list(rows, rows.columns).collect()} == {"one": 1, "many": 0}


@pytest.mark.parametrize("keys", ["concat('doc-', id)", "cast(id as string)", "md5(cast(id as string))"])
def test_text_ties_over_many_tasks(spark, keys):
    rows = spark.range(20000).select(F.lit(1.0).alias("v"), F.expr(keys).alias("key"))
    made = [r.key for r in ranked_by_value(rows, "v", True, "key", buckets=16).orderBy("rank").collect()]
    assert made == sorted(made)
    most = ordering_buckets(rows, "v", True, "key", 16).groupBy(CODE).count().agg(F.max("count")).first()[0]
    assert most < 8000


def kept_rounds(losses, patience):
    watch = Watch(patience)
    for rounds, loss in enumerate(losses, 1):
        if not watch.goes_on(rounds, loss):
            break
    return watch.rounds


def test_patience():
    losses = [5, 4, 4.5, 4.2, 3, 3.5, 3.6, 3.7, 2]
    assert kept_rounds(losses, 2) == 2  # the third and fourth bring nothing
    assert kept_rounds(losses, 3) == 5  # the fifth does, the three after it do not
    assert kept_rounds(losses, 4) == 9
    assert kept_rounds([5, 4, 3], 10) == 3
    assert kept_rounds(losses, 0) == 9  # no patience asked for: nothing ends


@pytest.mark.parametrize("learner", ["xgb_tree", "xgb_fix"])
def test_boosting_keeps_the_best_rounds(spark, points, learner):
    x, y, z = points
    rows = frame(spark, x, z if learner == "xgb_fix" else y).withColumn("is_valid", (F.col("row_id") % 3 == 0).cast("int"))
    params = {"num_rounds": 8, "max_depth": 2, "eta": 0.5}
    patient = LE.LEARNERS[learner](rows, ["x"], params | {"early_stopping_rounds": 8})
    watch = rows.filter("is_valid = 1").select("row_id", "x", "y")
    made = {r.row_id: r.pred for r in patient(watch).collect()}
    # the same as the best of all shorter fits on the rows that are not watched
    plain = {n: LE.LEARNERS[learner](rows.filter("is_valid = 0").drop("is_valid"), ["x"], params | {"num_rounds": n}) for n in range(9)}
    same = [n for n, fit in plain.items() if {r.row_id: r.pred for r in fit(watch).collect()} == pytest.approx(made)]
    assert same
