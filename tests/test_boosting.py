"""Boosted trees, linear booster, pair sums, metric bounds and coded neighbours against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import boosting as B
from foldwright.operators import bounds as BO
from foldwright.operators import codes as C
from foldwright.operators import coordinates as CO
from foldwright.operators import ensemble as E
from foldwright.operators import heavy as H
from foldwright.operators import learners as LE
from foldwright.operators import neighbours as N
from foldwright.operators import pairs as P
from foldwright.operators import search as SE
from foldwright.sources import files

SETTINGS = B.Settings(num_rounds=5, max_depth=3, eta=0.4, lam=0.7, alpha=0.3, gamma=0.05, min_child_weight=2, max_bin=16)


def grown(x, y, w, grad, s):
    """Plain boosting over all thresholds at the values of ``x``: margins after every round."""
    margin = np.full(len(y), (w * y).sum() / w.sum()) if grad is B._squared else np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    soft = lambda g: np.sign(g) * max(abs(g) - s.alpha, 0)
    worth = lambda g, h: soft(g) ** 2 / (h + s.lam)
    out = [margin.copy()]
    for _ in range(s.num_rounds):
        g, h = grad(margin, y, w)
        leaves, nodes = [], [(np.ones(len(y), bool), 0)]
        while nodes:
            rows, depth = nodes.pop()
            best = None
            for f in range(x.shape[1]) if depth < s.max_depth else ():
                for v in np.unique(x[rows, f])[:-1]:
                    left = rows & (x[:, f] <= v)
                    right = rows & ~left
                    if h[left].sum() < s.min_child_weight or h[right].sum() < s.min_child_weight:
                        continue
                    gain = (worth(g[left].sum(), h[left].sum()) + worth(g[right].sum(), h[right].sum()) - worth(g[rows].sum(), h[rows].sum())) / 2 - s.gamma
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, left, right
            if best:
                nodes += [(best[1], depth + 1), (best[2], depth + 1)]
            else:
                leaves.append(rows)
        for rows in leaves:
            margin[rows] -= s.eta * soft(g[rows].sum()) / (h[rows].sum() + s.lam)
        out.append(margin.copy())
    return out


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(4)
    x = np.c_[draw.integers(0, 12, 300), draw.integers(0, 5, 300), draw.integers(0, 9, 300) / 4]
    y = 3 + x[:, 0] * (x[:, 1] > 2) - x[:, 2] ** 2 + draw.normal(0, 1, 300)
    return x, y


def table(spark, x, y, part=-1):
    rows = [(part if isinstance(part, int) else int(part[i]), float(y[i]), i, *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "part int, y double, key long, a double, b double, c double")


@pytest.mark.parametrize("objective", ["squared", "rmspe", "logistic"])
def test_boosting_is_the_plain_search(spark, data, objective):
    x, y = data
    y = np.abs(y) + 1 if objective == "rmspe" else (y > np.median(y)).astype(float) if objective == "logistic" else y
    s = B.Settings(**{**SETTINGS.__dict__, "objective": objective})
    w = (y.max() / y) ** 2 if objective == "rmspe" else np.ones(len(y))
    made = B.boost(table(spark, x, y), ["a", "b", "c"], s)
    got = {r.key: r.pred for r in made.predict(table(spark, x, y)).collect()}
    want = grown(x, y, w, B.OBJECTIVES[objective][0], s)[-1]
    want = B.OBJECTIVES[objective][1](want)
    assert np.allclose([got[i] for i in range(len(y))], want)


def test_models_of_folds_grow_alone(spark, data, monkeypatch):
    """Side by side as each by itself, with predictions written on the way and levels in several passes."""
    x, y = data
    part = np.arange(len(y)) % 3
    monkeypatch.setattr(B, "FRESH", 2)
    monkeypatch.setattr(B, "MAX_CELLS", 200)
    made = B.boost(table(spark, x, y, part), ["a", "b", "c"], SETTINGS, 3)
    for m in range(3):
        rest = part != m
        alone = B.boost(table(spark, x[rest], y[rest]), ["a", "b", "c"], SETTINGS)
        assert [t.feature for t in made.trees[m]] == [t.feature for t in alone.trees[0]]
        assert np.allclose(np.concatenate([t.value for t in made.trees[m]]), np.concatenate([t.value for t in alone.trees[0]]))
    losses = {(m, r): v for m, r, v in made.history}
    bins = B.cut(__import__("pyarrow").array(x.tolist()), made.edges)
    for m in range(3):
        own = bins[part == m]
        made.kept[m] = 3
        assert losses[m, 3] == pytest.approx(np.sqrt(np.mean((made.margins(own, m) - y[part == m]) ** 2)))


def test_binned_table_is_spread_over_the_cores(spark, data):
    """A table in one piece is binned into pieces for all cores, in blocks of rows, and read back as it was."""
    x, y = data
    made = B.Booster(table(spark, x, y).coalesce(1), ["a", "b", "c"], [B.Model(0, SETTINGS)])
    assert made.rows.rdd.getNumPartitions() >= min(8, spark.sparkContext.defaultParallelism)
    blocks = made.rows.toArrow().to_batches()
    read = [rows for batch in blocks for rows in made._reader()(batch)]
    assert sum(b.num_rows for b in blocks) < len(y) / 4
    part, label, w, key, bins, margin = (np.concatenate(c) for c in zip(*read, strict=True))
    at = np.argsort(key)
    assert (key[at] == np.arange(len(y))).all() and (part == -1).all() and (w == 1).all()
    assert (label[at] == y).all() and np.allclose(margin, y.mean())
    assert (bins[at] == B.cut(__import__("pyarrow").array(x.tolist()), made.edges)).all()


@pytest.mark.parametrize("depth", [3, 9])
def test_trees_of_any_size_place_rows(depth):
    """Node by node or row by row, a row ends in the leaf that its values lead to."""
    draw = np.random.default_rng(depth)
    bins = draw.integers(0, 40, (500, 3)).astype(np.uint8)
    tree = B.Tree(depth=depth)
    ends = [tree.add(0.0)]
    for _ in range(depth):
        ends = [c for n in ends for c in tree.split(n, int(draw.integers(3)), int(draw.integers(40)), 0.0, 0.0)]
    want = []
    for row in bins:
        n = 0
        while tree.feature[n] >= 0:
            n = tree.left[n] if row[tree.feature[n]] <= tree.bin[n] else tree.right[n]
        want.append(n)
    assert tree.leaves(bins).tolist() == want


def test_awkward_features_and_draws(spark, data):
    x, y = data
    rows = table(spark, x, y).withColumns({"a": F.when(F.col("a") > 3, F.col("a")), "b": F.when(F.col("b") == 2, F.lit(float("nan"))).otherwise(F.col("b")), "c": F.lit(None).cast("double")})
    s = B.Settings(num_rounds=6, max_depth=4, subsample=0.6, colsample=0.5, max_bin=4)
    made = [sorted((r.key, r.pred) for r in B.boost(rows.repartition(n), ["a", "b", "c"], s).predict(rows).collect()) for n in (1, 7)]
    assert made[0] == [(k, pytest.approx(p)) for k, p in made[1]]
    constant = B.boost(rows.withColumn("y", F.lit(2.5)), ["a", "b", "c"], s).predict(rows)
    assert {r.pred for r in constant.select("pred").distinct().collect()} == {2.5}
    none = B.boost(rows.limit(0), ["a", "b", "c"], s).predict(rows.limit(3))
    assert [r.pred for r in none.collect()] == [0.0] * 3


@pytest.mark.parametrize("metric", ["auc", "logloss"])
def test_patience_on_any_metric(spark, data, metric):
    """The kept rounds have the best loss of those seen, which end ``patience`` rounds later."""
    x, y = data
    label = (y + np.random.default_rng(1).normal(0, 6, len(y)) > np.median(y)).astype(float)
    part = np.where(np.arange(len(y)) % 4 == 0, 0, -1)
    s = B.Settings(num_rounds=30, max_depth=4, eta=1.0, objective="logistic", metric=metric, patience=3)
    made = B.boost(table(spark, x, label, part), ["a", "b", "c"], s)
    losses = [v for _, _, v in made.history]
    best = int(np.argmax(losses) if metric == "auc" else np.argmin(losses))
    assert made.kept == [best] and len(losses) == best + 4 < 30


def test_text_keys_in_two_directions(spark, data):
    x, y = data
    rows = table(spark, x, np.abs(y) + 1).withColumn("row_id", F.md5(F.col("key").cast("string"))).drop("part", "key")
    predict = LE.LEARNERS["xgb_art"](rows, ["a", "b", "c"], {"num_rounds": 3, "max_depth": 2, "early_stopping_rounds": 2})
    assert predict(rows).filter("pred is null").count() == 0


def test_linear_booster_converges_to_ridge(spark, data):
    x, y = data
    rows = table(spark, x, y).withColumn("row_id", F.col("key"))
    predict = LE.LEARNERS["xgb_linear"](rows, ["a", "b", "c"], {"num_rounds": 3000, "eta": 1.0, "lambda": 20.0})
    got = np.array([r.pred for r in predict(rows).orderBy("key").collect()])
    a = np.c_[np.ones(len(y)), x]
    w = np.linalg.solve(a.T @ a + np.diag([0, 20.0, 20.0, 20.0]), a.T @ y)
    assert np.allclose(got, a @ w)
    parts = CO.moments(rows.withColumn("part", F.col("key") % 2), ["a", "b", "c"], by=["part"])
    whole = np.c_[a, y]
    assert np.allclose(parts[0,], whole[::2].T @ whole[::2]) and np.allclose(parts[1,], whole[1::2].T @ whole[1::2])
    assert CO.loss(parts[0,], w) == pytest.approx(np.sqrt(np.mean((a[::2] @ w - y[::2]) ** 2)))
    kept, seen = CO.fit(parts[1,], parts[0,], 200, 0.5, alpha=30.0, patience=5)
    assert CO.loss(parts[0,], kept) == pytest.approx(min(seen))


def test_pair_sums(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["u", "v", None]), draw.choice([None, 1.0, 2.0, 2.0, 5.0]), draw.choice([None, *[draw.uniform(-2, 2)] * 9])) for i in range(120)]
    frame = spark.createDataFrame(rows, "row_id long, g string, y double, s double")
    made = {r.row_id: r for r in P.pair_gradients(frame, F.col("s"), "y", ["g"]).collect()}
    for i, g, y, s in rows:
        mates = [(b, t) for _, h, b, t in rows if h == g and b is not None and t is not None]
        known = y is not None and s is not None
        below = [t for b, t in mates if known and b < y]
        above = [t for b, t in mates if known and b > y]
        loss = sum(math.exp(t - s) for t in below)
        assert (made[i].n_pairs, made[i].loss) == (len(below), pytest.approx(loss))
        assert made[i].gradient == pytest.approx(sum(math.exp(s - t) for t in above) - loss)


def test_linear_ranker_orders_within_groups(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(0, [1, 50], (400, 2))
    group = draw.integers(0, 4, 400)
    y = np.round(2 * x[:, 0] + 0.02 * x[:, 1] + 100 * group)  # groups differ by far more than features do
    frame = spark.createDataFrame([(i, int(group[i]), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(400)], "row_id long, g int, y double, a double, b double")
    w = P.linear_ranker(frame, ["a", "b"], groups=["g"])
    assert w["a"] > 0 and w["a"] / w["b"] == pytest.approx(100, rel=0.2)


@pytest.mark.parametrize("metric", ["gini", "auc"])
def test_bounds_hold_and_close_in(spark, metric):
    draw = np.random.default_rng(7)
    n = 900
    y = draw.integers(0, 2, n).astype(float) if metric == "auc" else draw.gamma(2, 3, n)
    cols = {"m": y + draw.normal(0, 2, n), "t": np.round(y + draw.normal(0, 1, n)), "c": np.zeros(n)}
    rows = [(0, i % 2, i, float(y[i]), *[float(c[i]) for c in cols.values()]) for i in range(n)]
    wide = spark.createDataFrame(rows, "iter int, fold int, row_id long, y double, m double, t double, c double")
    bounds = BO.RankBounds(wide, list(cols), metric)
    now = {"m": 0.7, "t": 0.3}
    blends = [(m, w) for m in cols for w in (0.0, 0.37, 1.0)]
    parts = []
    for m, w in blends:
        pred = F.lit(w) * (F.lit(0.7) * F.col("m") + F.lit(0.3) * F.col("t")) + F.lit(1 - w) * F.col(m)
        parts.append(E.score(wide.select("iter", "fold", "row_id", "y", pred.alias("pred")), metric, ["iter", "fold"]).agg(F.avg("score")).first()[0])
    gaps = []
    for bins in (8, 64, 512):
        low, high = bounds.bounds(now, blends, bins).T
        assert (low <= np.array(parts) + 1e-9).all() and (np.array(parts) <= high + 1e-9).all()
        gaps.append((high - low)[[0, 1, 2]].max())
    assert gaps[0] > 4 * gaps[1] > 16 * gaps[2]


def test_selection_by_bounds_is_selection_by_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(9)
    n = 400
    y = draw.gamma(2, 3, n)
    models = {f"m{k}": y + draw.normal(0, 2 + k / 4, n) for k in range(4)}
    rows = [(0, i % 2, i, float(y[i]), *[float(c[i]) for c in models.values()]) for i in range(n)]
    wide = spark.createDataFrame(rows, "iter int, fold int, row_id long, y double, " + ", ".join(f"{m} double" for m in models))
    quick = E.greedy_by_scoring(wide, list(models), "gini", steps=20)
    monkeypatch.setattr(E, "BINS", ())  # no bounds: all are ranked
    whole = E.greedy_by_scoring(wide, list(models), "gini", steps=20)
    assert [(s.step, s.model, s.weight, round(s.score, 9)) for s in whole] == [(s.step, s.model, s.weight, round(s.score, 9)) for s in quick] and len(quick) > 2


@pytest.mark.parametrize("text", [False, True])
def test_scan_and_codes_find_neighbours(spark, text):
    draw = np.random.default_rng(3)
    v = draw.normal(0, 1, (700, 24))
    v[5] = v[6]
    key = (lambda i: f"k{i:04d}") if text else int
    rows = spark.createDataFrame([(key(i), [float(x) for x in v[i]], i % 3) for i in range(700)], f"id {'string' if text else 'long'}, vector array<double>, fold int")
    q, r = rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "ref_id")
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    d[(np.arange(700) % 3)[:, None] == (np.arange(700) % 3)[None, :]] = np.inf
    want = {(key(i), key(j)): n for i in range(700) for n, j in enumerate(np.lexsort((np.arange(700), d[i]))[:7], 1)}
    exact = N.knn_join(q, r.repartition(5), 7, skip="fold", block_rows=100, query_rows=300)
    assert {(x.query_id, x.ref_id): x.neighbour_rank for x in exact.collect()} == want
    coded = C.knn_by_codes(q, r.repartition(5), 7, skip="fold", query_rows=300).collect()
    assert len(coded) == 4900 and sum((x.query_id, x.ref_id) in want for x in coded) > 0.9 * 4900
    assert C.knn_by_codes(q, r.limit(0), 7).count() == 0 and C.knn_by_codes(q.limit(0), r, 7).count() == 0


@pytest.mark.parametrize("counters", [4, 1000])
def test_frequent_values(spark, counters):
    draw = random.Random(5)
    rows = [(float(i), draw.choice([None, 1.0, 1.0, 7.5]), draw.choice("aab") if i % 2 else f"x{i}", 3) for i in range(4000)]
    rows += [(-1.0, None, None, 3)] * 300
    frame = spark.createDataFrame(rows, "many double, few double, mixed string, one int").repartition(6)
    found, seen = H.frequent_values(frame, frame.columns, 250, counters)
    want = {}
    for i, name in enumerate(frame.columns):
        text = [("-1" if r[i] is None else r[i] if isinstance(r[i], str) else f"{r[i]:g}") for r in rows]
        want |= {(name, v): text.count(v) for v in set(text) if text.count(v) > 250}
    assert {(r.column_name, r.value): r.n for r in found.collect()} == want
    told = {r.column_name: r.n_distinct for r in seen.collect()}
    assert told["one"] == 1 and told["few"] == 3 and told["many"] == (None if counters == 4 else 4001)
    dropped = {r.column_name: r["drop"] for r in H.drop_summary(frame, frame.columns, max_same=2500, counters=counters).collect()}
    assert dropped == {"many": 0, "few": 0, "mixed": 0, "one": 1}


def test_trials_are_halved_and_survivors_stored(spark, data, tmp_path):
    x, y = data
    rows = table(spark, x, y).withColumns({"row_id": F.col("key"), "iter": F.lit(0), "fold": (F.col("key") % 3).cast("int")}).drop("part", "key")
    trials = spark.createDataFrame([(t, 0.02 * t, float(1 + t % 3)) for t in range(1, 9)], "trial long, learning_rate double, max_depth double")
    told = SE.race_trials(rows, "gbf", ["a", "b", "c"], trials, "rmse", 3, (1, 2), 4, str(tmp_path / "trials")).collect()
    assert sorted(r.rounds for r in told) == [1] * 4 + [2] * 2 + [4] * 2
    kept = {r.model for r in told if r.survived}
    stored = files.read_predictions(spark, str(tmp_path / "trials"))
    assert {(r.model, r["count"]) for r in stored.groupBy("model").count().collect()} == {(m, 300) for m in kept}
    for r in told:
        if r.survived:
            t = int(r.model.split("@")[1])
            alone = LE.out_of_fold(rows, "gbf", ["a", "b", "c"], 3, 1, {"n_estimators": 4, "learning_rate": 0.02 * t, "max_depth": 1 + t % 3})
            both = alone.join(stored.filter(F.col("model") == r.model).withColumnRenamed("pred", "other"), ["fold", "row_id"])
            assert both.filter(F.abs(F.col("pred") - F.col("other")) > 1e-9).count() == 0


def test_random_forest_averages_its_trees(spark, data, monkeypatch):
    x, y = data
    rows = table(spark, x, y).withColumns({"row_id": F.col("key"), "iter": F.lit(0), "fold": (F.col("key") % 2).cast("int")}).drop("part", "key")
    monkeypatch.setattr(B, "MODELS", 4)
    s = B.Settings(max_depth=4, lam=0.0, split_features=0.7, random_splits=True)
    parts = B.random_forest(rows, ["a", "b", "c"], 2, 5, s)
    assert [len(p.trees) for p in parts] == [4, 4, 2]
    shapes = {tuple(t[0].feature) + tuple(t[0].bin) for p in parts for t in p.trees}
    assert len(shapes) > 5  # draws differ
    made = {r.row_id: r.pred for r in B.out_of_fold_forest(rows, ["a", "b", "c"], 2, 5, s).collect()}
    bins = B.cut(__import__("pyarrow").array(x.tolist()), parts[0].edges)
    for f in (0, 1):
        own = np.mean([p.margins(bins, m) for p in parts for m in range(f, len(p.trees), 2)], axis=0)
        assert all(made[i] == pytest.approx(own[i]) for i in range(f, len(y), 2))
    assert np.corrcoef([made[i] for i in range(len(y))], y)[0, 1] > 0.6


def test_folds_of_order_lines_hold_the_features_that_are_fitted(spark, tmp_path):
    from foldwright.plans import boosted
    from foldwright.plans.registry import QUERIES

    lines = [(o, o % 4, o % 2, n, 100.0 * o + n, "AN"[o % 2], 1.0 + n, 0.01 * n, 0.02) for o in range(20) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, p + 1, 9.5 * p) for p in range(4)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert {"row_id", "y", "fold", *boosted.ITEM_FEATURES} <= set(boosted._items(spark, str(tmp_path)).columns)
    assert QUERIES["boosted_stump"](spark, str(tmp_path)).count() == 60
    assert QUERIES["linear_booster_rounds"](spark, str(tmp_path)).count() == 60


def test_margins_are_written_only_when_they_are_refreshed(spark, data, monkeypatch):
    """A race of many models stores bins and labels, not a number per row and model; so does a forest, once for all its trees."""
    x, y = data
    rows = table(spark, x, y, np.arange(len(y)) % 2)
    made = B.Booster(rows, ["a", "b", "c"], [B.Model(m % 2, B.replace(SETTINGS, seed=m)) for m in range(40)])
    assert made.rows.agg(F.sum(F.length("margin")), F.sum(F.length("bins"))).first() == (0, 3 * len(y))
    made._refresh()
    assert made.rows.agg(F.sum(F.length("margin"))).first()[0] == 8 * 40 * len(y)
    stored, own = [], B.Booster._stored
    monkeypatch.setattr(B.Booster, "_stored", lambda *a: stored.append(1) or own(*a))
    monkeypatch.setattr(B, "MODELS", 4)
    folds = rows.withColumns({"row_id": F.col("key"), "iter": F.lit(0), "fold": F.col("part")}).drop("part", "key")
    assert len(B.random_forest(folds, ["a", "b", "c"], 2, 6, B.Settings(max_depth=2, lam=0.0, random_splits=True))) == 3 and len(stored) == 1


def test_one_shot_chain_grows_as_many_and_as_deep_trees_as_the_original():
    from foldwright.plans import learned

    s = LE.BOOSTED["xgb_tree"].settings(learned.ONE_SHOT)
    assert (s.num_rounds, s.max_depth, s.patience, s.eta, s.min_child_weight) == (1100, 22, 100, 0.015, 3) and s.max_depth <= B.MAX_DEPTH
