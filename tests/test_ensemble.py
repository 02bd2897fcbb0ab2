"""Gram matrix, greedy selection, recipes and sampled pairs against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import ensemble as E
from foldwright.operators import library as L
from foldwright.operators.pairs import pair_count, preference_pairs

MODELS = [f"m{i}" for i in range(5)]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        y = float(rng.uniform(1, 10))
        rows.append((0, i % 3, i, y, *[float(y + rng.normal(0, 1 + m / 3) + (m - 2) / 4) for m in range(5)]))
    return rows


@pytest.fixture(scope="module")
def wide(spark, table):
    schema = "iter int, fold int, row_id bigint, y double, " + ", ".join(f"{m} double" for m in MODELS)
    return spark.createDataFrame(table, schema).repartition(7)


def loss(table, coefs):
    arr = np.array([r[1:] for r in table], dtype=float)
    scores = []
    for f in range(3):
        part = arr[arr[:, 0] == f]
        y, p = part[:, 2], part[:, 3:] @ coefs
        scores.append(np.sqrt(np.mean(((y - p) / y) ** 2)))
    return float(np.mean(scores))


def test_gram_forms_agree_and_match_brute_force(wide, table):
    a = E.gram_arrays(E.gram_by_expressions(wide, MODELS), MODELS)
    b = E.gram_arrays(E.gram_by_blocks(wide, MODELS), MODELS)
    assert np.allclose(a, b, rtol=1e-12)
    for c in np.random.default_rng(1).dirichlet(np.ones(5), 20):
        assert np.sqrt(np.einsum("i,fij,j->f", c, a, c)).mean() == pytest.approx(loss(table, c), abs=1e-12)


def greedy_by_force(table):
    singles = [loss(table, np.eye(5)[m]) for m in range(5)]
    order = sorted(range(5), key=lambda m: singles[m])
    blend, best, steps = np.eye(5)[order[0]], singles[order[0]], [(MODELS[order[0]], 1.0)]
    while True:
        chosen = None
        for m in order:
            tried = [(round(loss(table, w / 100 * blend + (1 - w / 100) * np.eye(5)[m]), 9), w / 100) for w in range(101)]
            score, w = min(tried)
            if best - score >= 1e-6:
                best, chosen = score, (m, w)
        if chosen is None:
            return steps, best
        m, w = chosen
        blend = w * blend + (1 - w) * np.eye(5)[m]
        steps.append((MODELS[m], w))


def test_greedy_matches_brute_force(wide, table):
    recipe = E.greedy_select(E.gram_matrix(wide, MODELS), MODELS)
    steps, best = greedy_by_force(table)
    assert [(s.model, s.weight) for s in recipe] == steps
    assert recipe[-1].score == pytest.approx(best, abs=1e-9)
    assert all(a.score - b.score >= E.MIN_GAIN for a, b in zip(recipe, recipe[1:]))
    assert sum(E.coefficients(recipe).values()) == pytest.approx(1.0)


def test_replay_equals_coefficients(wide, table):
    recipe = E.greedy_select(E.gram_matrix(wide, MODELS), MODELS)
    got = {r["row_id"]: r["pred"] for r in E.replay(L.to_long(wide, MODELS), recipe).collect()}
    coefs = E.coefficients(recipe)
    for r in table[:50]:
        assert got[r[2]] == pytest.approx(sum(coefs.get(m, 0) * r[4 + i] for i, m in enumerate(MODELS)))


def test_recipe_is_kept_when_nothing_improves(spark):
    rows = [(0, f, f * 10 + i, float(i + 1), float(i + 1), float(i + 5)) for f in range(2) for i in range(10)]
    wide = spark.createDataFrame(rows, "iter int, fold int, row_id bigint, y double, good double, bad double")
    recipe = E.greedy_select(E.gram_matrix(wide, ["good", "bad"]), ["good", "bad"])
    assert [(s.step, s.model) for s in recipe] == [(0, "good")]
    assert E.recipe_steps(E.recipe_table(spark, recipe)) == recipe


def test_greedy_by_scoring_agrees_with_gram_on_a_loss(wide):
    direct = E.greedy_by_scoring(wide, MODELS[:3], "rmspe", steps=10)
    gram = E.greedy_select(E.gram_matrix(wide, MODELS[:3]), MODELS[:3], steps=10)
    assert [(s.model, s.weight) for s in direct] == [(s.model, s.weight) for s in gram]


def test_greedy_by_scoring_maximises_gini(wide):
    recipe = E.greedy_by_scoring(wide, MODELS[:3], "gini", steps=4)
    assert all(b.score - a.score >= E.MIN_GAIN for a, b in zip(recipe, recipe[1:]))


def test_greedy_by_scoring_tries_hundredths(wide):
    direct = E.greedy_by_scoring(wide, MODELS[:2], "rmspe")
    gram = E.greedy_select(E.gram_matrix(wide, MODELS[:2]), MODELS[:2])
    assert [(s.model, s.weight) for s in direct] == [(s.model, s.weight) for s in gram]
    assert any(round(100 * s.weight) % 10 for s in direct)


def test_long_and_wide_round_trip(wide):
    back = L.to_wide(L.to_long(wide, MODELS), MODELS)
    assert back.exceptAll(wide.select("iter", "fold", "row_id", *MODELS)).count() == 0


def test_preference_pairs(spark):
    # one label holds two thirds of the rows
    df = spark.range(900).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id") % 4 + 1.0).alias("y"))
    pairs = preference_pairs(df, per_row=3)
    assert pairs.count() == 2700
    y = {r["row_id"]: r["y"] for r in df.collect()}
    for r in pairs.collect():
        assert y[r["row_id"]] != y[r["partner_id"]]
        assert r["sign"] == (1 if y[r["row_id"]] > y[r["partner_id"]] else -1)
    counts = {}
    for v in y.values():
        counts[v] = counts.get(v, 0) + 1
    assert pair_count(df).first()["n_pairs"] == (900**2 - sum(c * c for c in counts.values())) // 2


def test_no_pairs_among_equal_labels(spark):
    assert preference_pairs(spark.range(5).select(F.col("id").alias("row_id"), F.lit(1.0).alias("y"))).count() == 0
