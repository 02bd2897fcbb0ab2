"""Findings of the third round, on rows of their own."""

import contextlib
import io

from pyspark.sql import functions as F

from foldwright.operators import library as L
from foldwright.operators import ranking
from foldwright.plans import baseline, blends, learned, metric
from foldwright.sources import files


def plan_of(df):
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        df.explain()
    return told.getvalue()


def test_wide_table_groups_once_after_dealing(spark):
    rows = [("a", 0, 1, 0.0, 1.5), ("b", 0, 1, -0.0, 2.5), ("a", 0, 2, 3.0, None), ("c", 0, 3, 1.0, 9.0), ("b", 0, None, 1.0, 4.0)]
    long = spark.createDataFrame(rows, "model string, iter int, row_id long, y double, pred double")
    wide = L.to_wide(long, ["a", "b"], ["iter", "row_id", "y"])
    plan = plan_of(wide)
    assert plan.count("Exchange hashpartitioning") == 1 and "pivotfirst" not in plan.lower()
    assert plan.rindex("Aggregate") < plan.index("Exchange hashpartitioning")  # nothing is held before the rows are dealt
    found = {(r["row_id"], r["a"], r["b"]) for r in wide.collect()}
    assert found == {(1, 1.5, 2.5), (2, None, None), (3, None, None), (None, None, 4.0)}
    assert {tuple(r) for r in L.to_wide(long, [], ["iter", "row_id"]).collect()} == {(0, 1), (0, 2), (0, 3), (0, None)}


def test_stack_matrix_of_a_query_is_made_once(spark, data):
    assert "Generate explode" not in plan_of(learned.stack_test(spark, data))


def test_long_tables_are_sorted_in_more_tasks(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id AS row_id", "id % 7 AS v", "CAST(id % 3 AS INT) AS fold")
    few = {tuple(r) for r in ranking.ranked_by_value(rows, "v", True, "row_id", ["fold"]).collect()}
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 100)
    ranked = ranking.ranked_by_value(rows, "v", True, "row_id", ["fold"])
    assert ", 10), REPARTITION_BY_NUM" in plan_of(ranked)
    assert {tuple(r) for r in ranked.collect()} == few


def test_rank_average_deals_rows_before_it_groups(spark, data):
    plan = plan_of(blends.rank_average(spark, data))
    top = plan[: plan.index("Exchange hashpartitioning")]
    assert top.count("Aggregate") == 2 and "REPARTITION_BY_COL" in plan


def test_predictions_are_written_where_they_are(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "OPEN_PARTS", 2)  # the other parts are sorted
    rows = [(f"m{n % 5}", 0, n % 3, n, float(n)) for n in range(60)]
    first = spark.createDataFrame(rows, files.PREDICTION_SCHEMA)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    files.append_predictions(first, f"{tmp_path}/p")
    files.append_predictions(first.filter("model = 'm1' AND fold = 2").withColumn("pred", -F.col("pred")), f"{tmp_path}/p")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before
    found = {tuple(r) for r in files.read_predictions(spark, f"{tmp_path}/p").select("model", "iter", "fold", "row_id", "pred").collect()}
    assert found == {(m, i, f, n, -p if (m, f) == ("m1", 2) else p) for m, i, f, n, p in rows}


def test_keys_of_a_listing_are_taken_apart_once_per_part(spark, data):
    plan = plan_of(metric.library_listing(spark, data))
    assert plan.rindex("regexp_extract") < plan.rindex("HashAggregate")


def test_folds_of_items_hold_what_is_fitted(spark, data):
    assert set(baseline._item_folds(spark, data).columns) == {"row_id", "y", "stratum", "l_quantity", "iter", "fold"}
