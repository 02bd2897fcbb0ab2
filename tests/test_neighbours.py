"""Exact neighbour joins against brute force: both paths, skewed cells, duplicates, skipping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import neighbours as N


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(9)
    dense = rng.normal(0, 0.01, (500, 6))  # one third and more in a single spot
    spread = rng.normal(0, 3, (600, 6)) + rng.integers(-2, 3, (600, 1)) * 10
    copies = np.repeat(rng.normal(5, 1, (1, 6)), 100, axis=0)
    return np.vstack([dense, spread, copies])


@pytest.fixture(scope="module")
def df(spark, points):
    rows = [(i, i % 3, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "row_id bigint, fold int, vector array<double>").repartition(5)


def brute(points, k, skip):
    out = {}
    for i, p in enumerate(points):
        d2 = ((points - p) ** 2).sum(axis=1)
        ids = [j for j in range(len(points)) if not skip or j % 3 != i % 3]
        order = sorted(ids, key=lambda j: (d2[j], j))[:k]
        out[i] = [(j, np.sqrt(d2[j])) for j in order]
    return out


@pytest.mark.parametrize("skip", [None, "fold"])
@pytest.mark.parametrize("block_rows", [5000, 90])
def test_join_is_exact(df, points, skip, block_rows):
    q = df.withColumnRenamed("row_id", "query_id")
    r = df.withColumnRenamed("row_id", "ref_id")
    got = {}
    for row in N.knn_join(q, r, 4, skip=skip, block_rows=block_rows, chunk_rows=250).collect():
        got.setdefault(row["query_id"], {})[row["neighbour_rank"]] = (row["ref_id"], row["distance"])
    want = brute(points, 4, skip)
    assert set(got) == set(want)
    for i, near in want.items():
        assert [got[i][n][0] for n in range(1, 5)] == [j for j, _ in near]
        assert [got[i][n][1] for n in range(1, 5)] == pytest.approx([d for _, d in near], abs=1e-9)


def test_fewer_references_than_k(spark, df):
    few = df.limit(3).withColumnRenamed("row_id", "ref_id")
    out = N.knn_join(df.withColumnRenamed("row_id", "query_id"), few, 5)
    assert out.groupBy("query_id").count().agg(F.min("count"), F.max("count")).first() == (3, 3)


def test_zero_distance_wins(spark):
    near = spark.createDataFrame([(1, 10, 0.0, 1), (1, 11, 1.0, 2), (1, 12, 2.0, 3)], "query_id bigint, ref_id bigint, distance double, neighbour_rank bigint")
    targets = spark.createDataFrame([(10, 10.0), (11, 20.0), (12, 30.0)], "row_id bigint, y double")
    assert N.knn_regress(near, targets).first()["pred"] == 10.0
    assert N.knn_classify(near, targets).first()["pred"] == 10.0


def test_weighted_mean_and_vote(spark):
    near = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 2.0, 2), (1, 12, 2.0, 3)], "query_id bigint, ref_id bigint, distance double, neighbour_rank bigint")
    targets = spark.createDataFrame([(10, 4.0), (11, 8.0), (12, 8.0)], "row_id bigint, y double")
    assert N.knn_regress(near, targets).first()["pred"] == pytest.approx((4 + 4 + 4) / 2)
    assert N.knn_classify(near, targets).first()["pred"] == 4.0  # equal votes: the smaller class


@pytest.mark.parametrize("mode, minority_only", [("away", False), ("interpolate", True)])
def test_smote_counts_and_modes(df, points, mode, minority_only):
    rows = df.withColumn("y", (F.col("row_id") % 6 == 0).cast("int"))
    out = N.smote(rows, mode=mode, minority_only=minority_only)
    n1 = rows.filter("y = 1").count()
    copies = (len(points) - n1) // n1
    assert out.filter("synthetic = 1").count() == copies * n1
    assert out.filter("synthetic = 0").count() == len(points)
    one = out.filter("synthetic = 1").first()
    x, nb, made = points[one["row_id"]], points[one["neighbour_id"]], np.array(one["vector"])
    direction = (x - nb) if mode == "away" else (nb - x)
    step = made - x
    if np.abs(direction).max() > 1e-9:
        u = step @ direction / (direction @ direction)
        assert 0 <= u < 1 and np.allclose(step, u * direction)
    if minority_only:
        assert out.filter("synthetic = 1 and neighbour_id % 6 <> 0").count() == 0


def test_text_keys_and_ties(spark, points):
    """Equal distances are ordered by the text key, in both forms."""
    rows = [(f"doc-{i}", [float(v) for v in p]) for i, p in enumerate(points[-300:])]
    df = spark.createDataFrame(rows, "row_id string, vector array<double>")
    q, r = df.withColumnRenamed("row_id", "query_id"), df.withColumnRenamed("row_id", "ref_id")
    sent = sorted(N.knn_join(q, r, 3).collect())
    assert sorted(N.knn_join(q, r, 3, block_rows=40, chunk_rows=70).collect()) == sent
    copies = sorted(name for name, p in rows if p == rows[-1][1])
    assert [row["ref_id"] for row in sent if row["query_id"] == copies[0]] == copies[:3]


def test_structure_is_pruned(spark):
    """Far clusters are not compared: few blocks are visited, and the result is the exact one."""
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (2000, 8)) + np.repeat(np.arange(20), 100)[:, None] * 40
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id bigint, vector array<double>")
    q, r = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "ref_id")
    exact = sorted(N.knn_join(q, r, 5).collect())
    assert sorted(N.knn_join(q, r, 5, block_rows=50, chunk_rows=100).collect()) == exact
    some = set(N.knn_join(q, r, 5, block_rows=50, chunk_rows=100, probes=4).select("query_id", "ref_id").collect())
    assert len(some & {(row["query_id"], row["ref_id"]) for row in exact}) >= 0.9 * len(exact)


def test_weights_uniform(spark):
    near = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 2.0, 2), (1, 12, 9.0, 3)], "query_id bigint, ref_id bigint, distance double, neighbour_rank bigint")
    targets = spark.createDataFrame([(10, 4.0), (11, 8.0), (12, 8.0)], "row_id bigint, y double")
    assert N.knn_regress(near, targets, weights="uniform").first()["pred"] == pytest.approx(20 / 3)
    assert N.knn_classify(near, targets, weights="uniform").first()["pred"] == 8.0


def test_searches_ask_for_every_row_against_all(spark, tmp_path):
    """Registered searches ask for every row; their neighbours come from all rows."""
    from foldwright.plans.registry import QUERIES

    draw = np.random.default_rng(8)
    rows = [(i, [float(v) for v in draw.normal(0, 1, 64)], i % 3) for i in range(200)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    points = np.array([v for _, v, _ in rows], np.float32).astype(float)
    for name, k in (("self_knn", 5), ("knn_join", 50), ("knn_join_scanned", 50), ("knn_join_blocked", 50)):
        found = QUERIES[name](spark, str(tmp_path)).collect()
        assert {r["query_id"] for r in found} == set(range(200)) and len(found) == 200 * k
        assert len({r["ref_id"] for r in found if r["ref_id"] % 20}) > 10
    near = {(r["query_id"], r["neighbour_rank"]): r["ref_id"] for r in QUERIES["self_knn"](spark, str(tmp_path)).collect()}
    for i in range(200):
        order = np.argsort(((points - points[i]) ** 2).sum(axis=1), kind="stable")[:5]
        assert [near[i, n] for n in range(1, 6)] == order.tolist()
    for name in ("knn_regress", "knn_classify", "knn_target_features"):
        assert {r["query_id"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == set(range(200))
    assert sum(r["n_queries"] for r in QUERIES["knn_recall_measured"](spark, str(tmp_path)).collect()) == 200


def test_scan_of_any_number_of_queries_stores_k_rows_each(df, points, monkeypatch):
    """Without a limit all queries go by scan, and of what the tasks find k rows per query are written."""
    stored = []
    monkeypatch.setattr(N, "materialise", lambda rows, label, *a: stored.append((label, rows.count())) or rows)
    found = N.knn_join(df.withColumnRenamed("row_id", "query_id"), df.withColumnRenamed("row_id", "ref_id"), 4, block_rows=1, scanned=None, query_rows=500)
    assert found.count() == 4 * len(points)
    assert sum(n for label, n in stored if label == "knn-scanned") == 4 * len(points)


def test_crowded_cells_are_scanned(spark, monkeypatch):
    """Where cells rule nothing out, references are not sent to the chunks; the result is the same."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(rng.normal(0, 1, (400, 24)))]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    q, r = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "ref_id")
    want = sorted(N.knn_join(q, r, 3, block_rows=40, chunk_rows=50, scanned=0).collect())
    scans = []
    scan = N._join_by_scan
    monkeypatch.setattr(N, "_join_by_scan", lambda *a: scans.append(1) or scan(*a))
    assert sorted(N.knn_join(q, r, 3, block_rows=40, chunk_rows=50, scanned=10).collect()) == want and scans
