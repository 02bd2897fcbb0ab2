"""Sinks, versions, skipping of finished work and scratch space."""

import pytest
from pyspark.sql import functions as F

from foldwright import session as SS
from foldwright.operators import library as L
from foldwright.operators.features import feature_drop_list
from foldwright.sources import files


def test_versions_count_up(spark, tmp_path):
    root = str(tmp_path / "sub")
    assert files.next_version(spark, root) == 1
    df = spark.createDataFrame([(1, 2.0)], "row_id bigint, pred double")
    assert [files.write_submission(df, root) for _ in range(3)] == [1, 2, 3]
    assert files.read_submission(spark, root, "model_library", 3).collect() == [(1, 2.0)]


def test_predictions_append_and_missing_work(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [("a", 0, f, i, 1.0) for f in range(3) for i in range(5)]
    files.append_predictions(spark.createDataFrame(rows, files.PREDICTION_SCHEMA), path)
    files.append_predictions(spark.createDataFrame([("b", 0, 0, 1, 2.0)], files.PREDICTION_SCHEMA), path)
    have = files.read_predictions(spark, path)
    assert have.count() == 16
    wanted = spark.createDataFrame([(m, 0, f) for m in "ab" for f in range(3)], "model string, iter int, fold int")
    left = lambda **kw: sorted((r["model"], r["fold"]) for r in L.missing_work(wanted, have, **kw).collect())
    assert left() == [("b", 1), ("b", 2)]
    assert left(forced=["a"]) == [("a", 0), ("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    complete = {r["model"]: r["complete"] for r in L.completeness(have, 3, 1).collect()}
    assert complete == {"a": 1, "b": 0}


def test_duplicate_keys_are_refused(spark):
    df = spark.createDataFrame([(1,), (1,)], "row_id int")
    with pytest.raises(ValueError):
        files.assert_unique(df, ["row_id"])
    assert files.assert_unique(df.distinct(), ["row_id"]).count() == 1


def test_small_side_is_checked(spark):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(SS.small_side(spark.range(5), 10))
    assert not hinted(SS.small_side(spark.range(50), 10))


class FakeSession:
    """A session as far as the choice of a scratch folder is concerned."""

    def __init__(self, named, master):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master
        self.chosen = None

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, path):
        self.chosen = path


def test_checkpoint_dir_of_the_session_is_used():
    assert SS.scratch_path(FakeSession("/shared/x", "spark://h:7077"), "t").startswith("/shared/x/t-")


def test_scratch_is_chosen_locally_only_where_unset():
    with pytest.raises(ValueError):
        SS.scratch_root(FakeSession(None, "spark://h:7077"))
    local = FakeSession(None, "local[2]")
    assert SS.scratch_root(local) == SS.scratch_root(local) == local.chosen


def test_drop_list_rules(spark):
    rows = [(1, i, -1 if i % 2 else 5, 0.01 * (i % 3), "x" if i else "y") for i in range(50)]
    df = spark.createDataFrame(rows, "same int, fine int, sentinel int, flat double, text string").withColumn(
        "nulls", F.when(F.col("fine") > 25, 5)
    )
    out = {r["column_name"]: r["drop"] for r in feature_drop_list(df, df.columns).collect()}
    assert out == {"same": 1, "fine": 0, "sentinel": 1, "flat": 1, "text": 0, "nulls": 1}
    capped = {r["column_name"]: r["drop"] for r in feature_drop_list(df, ["fine", "text"], max_same=0).collect()}
    assert capped == {"fine": 1, "text": 0}
