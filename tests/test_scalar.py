"""Golden values of row-level functions and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from foldwright.functions import scalar as S
from foldwright.functions.metrics import METRICS, register_metric, rmspe
from foldwright.operators import library as L
from foldwright.operators.ordered_metrics import normalised_gini, roc_auc
from foldwright.operators.search import SPACES, trial_table, upsert_params


def frame(spark, y, pred):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, pred))]
    return spark.createDataFrame(rows, "row_id bigint, y double, pred double")


def test_gini_golden(spark):
    df = frame(spark, range(1, 9), (2, 4, 8, 6, 10, 12, 14, 16))
    assert normalised_gini(df, groups=[]).first()["gini"] == pytest.approx(59 / 60)


def test_gini_of_perfect_order(spark):
    assert normalised_gini(frame(spark, range(1, 9), range(1, 9)), groups=[]).first()["gini"] == pytest.approx(1.0)


def test_rmspe_with_zero_target(spark):
    df = frame(spark, (0, 2, 4), (5, 1, 4))
    assert df.agg(rmspe(F.col("pred"), F.col("y")).alias("s")).first()["s"] == pytest.approx(math.sqrt(0.25 / 3))


def test_auc_with_ties_and_one_class(spark):
    df = frame(spark, (0, 1, 0, 1), (0.5, 0.5, 0.1, 0.9))
    assert roc_auc(df, groups=[]).first()["auc"] == pytest.approx(0.875)
    assert roc_auc(frame(spark, (1, 1), (0.1, 0.2)), groups=[]).first()["auc"] is None


@pytest.mark.parametrize(
    "how, pred, expected",
    [
        (S.minmax_if_negative, (-1, 0, 3), (0, 0.25, 1)),
        (S.minmax_if_negative, (0, 1, 3), (0, 1, 3)),
        (S.shift_scale, (-1, 0, 3), (0.2, 0.4, 1.0)),
        (lambda p, low, high: p / high, (1, 2, 4), (0.25, 0.5, 1)),
    ],
)
def test_rescaling(spark, how, pred, expected):
    df = frame(spark, pred, pred).withColumn("model", F.lit("m"))
    got = [r["pred"] for r in L.rescale(df, how).orderBy("row_id").collect()]
    assert got == pytest.approx(expected)


def test_text_exports(spark):
    df = spark.createDataFrame([(1.0, [0.0, 2.5, 0.0]), (0.0, [0.0, 0.0, 0.0])], "y double, v array<double>")
    from foldwright.sources.files import labelled_lines, sign_lines, sparse_lines

    out = df.select(
        sparse_lines(F.col("y"), F.col("v"), 1).alias("s"), labelled_lines(F.col("y"), F.col("v"), 1).alias("l"), sign_lines(F.col("y")).alias("g")
    ).collect()
    assert [r["s"] for r in out] == ["1.0 1:2.5", "0.0"]
    assert out[0]["l"] == "1.0,0.0 2.5 0.0"
    assert [r["g"] for r in out] == ["+1", "-1"]


def test_model_keys(spark):
    df = spark.createDataFrame([("label", "xgb_fix", 6), ("stand", "rf", None)], "feat string, model string, trial int")
    key = S.model_key(F.col("feat"), F.col("model"), F.col("trial"))
    out = df.select(key.alias("k")).select("k", S.model_key_model(F.col("k")).alias("m"), S.model_key_trial(F.col("k")).alias("t")).collect()
    assert [tuple(r) for r in out] == [("label_xgb_fix@6", "xgb_fix", 6), ("stand_rf", "rf", None)]
    old = spark.createDataFrame([("label_rf.pred.3",), ("label_rf",)], "k string")
    assert [r[0] for r in old.select(S.rewrite_model_key(F.col("k"))).collect()] == ["label_rf@3", "label_rf"]


def test_null_open_is_kept_and_zero_dropped(spark):
    from foldwright.operators.features import default_open, drop_closed

    df = spark.createDataFrame([(1, 0, 5.0), (2, 1, 0.0), (3, None, 5.0), (4, 1, 5.0)], "row_id int, open int, sales double")
    kept = drop_closed(df)
    assert sorted(r["row_id"] for r in kept.collect()) == [3, 4]
    assert [r["open"] for r in default_open(kept).orderBy("row_id").collect()] == [1, 1]


def test_registered_metric_carries_direction(spark):
    register_metric("bias", lambda p, y: F.abs(F.avg(p - y)), higher_is_better=False)
    df = frame(spark, (1, 2), (2, 3)).withColumns({"model": F.lit("m"), "iter": F.lit(0), "fold": F.lit(0)})
    assert L.score(df, "bias").first()["score"] == pytest.approx(1.0)
    assert METRICS["bias"].better(0.1, 0.2, 1e-6) and METRICS["gini"].better(0.2, 0.1, 1e-6)


def test_every_parameter_space_can_be_sampled(spark):
    for name, space in SPACES.items():
        rows = trial_table(spark, space, 5).collect()
        assert [r["trial"] for r in rows] == [1, 2, 3, 4, 5], name
        for param, value in space.items():
            if hasattr(value, "low"):
                assert all(value.low - 1e-9 <= r[param] <= value.high + 1e-9 for r in rows), (name, param)


def test_upsert_keeps_latest(spark):
    schema = "model string, version int, params map<string,double>"
    stored = spark.createDataFrame([("a", 1, {"x": 1.0}), ("b", 1, {"x": 1.0})], schema)
    new = spark.createDataFrame([("a", 2, {"x": 2.0}), ("c", 2, {"x": 3.0})], schema)
    out = {r["model"]: (r["version"], r["params"]["x"]) for r in upsert_params(stored, new).collect()}
    assert out == {"a": (2, 2.0), "b": (1, 1.0), "c": (2, 3.0)}
