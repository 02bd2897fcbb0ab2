"""Queries: boosters and pair sums whose every split, update and pair SQL can go through again."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.evaluator import MetricEvaluator
from foldwright.operators import boosting as B
from foldwright.operators import learners as LE
from foldwright.operators import pairs as P
from foldwright.plans import sql as Q
from foldwright.plans.baseline import _item_folds
from foldwright.plans.common import predictions, tidy
from foldwright.plans.registry import query
from foldwright.session import materialise
from foldwright.sources import tables

ITEM_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size"]


def random_cte(t: int, d: int, features: list[str], s: B.Settings) -> list[str]:
    """The drawn split of every node and feature."""
    if not s.random_splits:
        return []
    draw = lambda what: Q.uniform(s.seed, f"'{s.seed}'", "node", "f", f"'{what}'")
    return [
        f"""d{t}_{d} AS (SELECT * FROM (SELECT *, max(v) FILTER (v <= low + {draw("at")} * (high - low)) OVER n AS drawn FROM (
    SELECT *, min(v) OVER (PARTITION BY m, node, f) AS low, max(v) OVER (PARTITION BY m, node, f) AS high FROM c{t}_{d})
  WINDOW n AS (PARTITION BY m, node, f)) WHERE v = drawn AND {draw("in")} < {s.split_features}::DOUBLE)"""
    ]


def boosted_sql(rows: str, features: list[str], rounds: int, depth: int, s: B.Settings, weight: str = "1.0::DOUBLE", unit: str = "1.0::DOUBLE") -> str:
    """CTEs up to ``r{rounds}`` (m, fold, row_id, y, w, features, p): margins of every row under each fold's model.

    ``rows`` has fold, row_id, y and the features. ``weight`` is in terms of y and of ``top``, the largest y.
    """
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {s.alpha}::DOUBLE, 0))"
    worth = lambda g, h: f"pow({soft(g)}, 2) / ({h} + {s.lam}::DOUBLE)"
    names = ", ".join(features)
    parts = [
        f"u AS (SELECT ({unit}) AS unit FROM {rows})",
        f"w0 AS (SELECT fold, row_id, CAST(y AS DOUBLE) AS y, {weight} AS w, {names} FROM {rows}, (SELECT max(abs(y)) AS top FROM {rows}))",
        "ms AS (SELECT f.m, sum(w * y) / sum(w) AS base FROM (SELECT DISTINCT fold AS m FROM w0) f JOIN w0 ON fold <> m GROUP BY 1)",
        f"r0 AS (SELECT m, fold, row_id, y, w, {names}, base AS p FROM ms, w0)",
    ]
    for t in range(rounds):
        parts.append(f"a{t}_0 AS (SELECT *, 1 AS node FROM r{t})")
        for d in range(depth):
            value = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(features))
            parts += [
                f"""s{t}_{d} AS (SELECT m, node, f, CASE f {value} END AS v, sum(w * (p - y)) AS g, sum(w) AS h
  FROM a{t}_{d}, range({len(features)}) q(f) WHERE fold <> m AND node >= {2**d} GROUP BY ALL)""",
                f"""c{t}_{d} AS (SELECT m, node, f, v, sum(g) OVER k AS gl, sum(h) OVER k AS hl, sum(g) OVER n AS ga, sum(h) OVER n AS ha, lead(v) OVER k AS further
  FROM s{t}_{d} WINDOW k AS (PARTITION BY m, node, f ORDER BY v), n AS (PARTITION BY m, node, f))""",
                *random_cte(t, d, features, s),
                f"""b{t}_{d} AS (SELECT m AS bm, node AS bn, arg_max(f, (round(gain / unit, 12), -f, -v)) AS bf, arg_max(v, (round(gain / unit, 12), -f, -v)) AS bv FROM (
  SELECT *, ({worth("gl", "hl")} + {worth("(ga - gl)", "(ha - hl)")} - {worth("ga", "ha")}) / 2 - {s.gamma}::DOUBLE AS gain FROM {"d" if s.random_splits else "c"}{t}_{d}, u)
  WHERE further IS NOT NULL AND hl >= {s.min_child_weight} AND ha - hl >= {s.min_child_weight} AND gain > 1e-12 * unit GROUP BY ALL)""",
                f"""a{t}_{d + 1} AS (SELECT a.* REPLACE (CASE WHEN bf IS NULL THEN node WHEN CASE bf {value} END <= bv THEN 2 * node ELSE 2 * node + 1 END AS node)
  FROM a{t}_{d} a LEFT JOIN b{t}_{d} ON bm = m AND bn = node)""",
            ]
        parts += [
            f"e{t} AS (SELECT m AS em, node AS en, -{s.eta}::DOUBLE * {soft('sum(w * (p - y))')} / (sum(w) + {s.lam}::DOUBLE) AS leaf FROM a{t}_{depth} WHERE fold <> m GROUP BY ALL)",
            f"r{t + 1} AS (SELECT m, fold, row_id, y, w, {names}, p + coalesce(leaf, 0) AS p FROM a{t}_{depth} LEFT JOIN e{t} ON em = m AND en = node)",
        ]
    return ",\n".join(parts)


def _items(spark, folder, features=ITEM_FEATURES):
    return _item_folds(spark, folder, features)


ITEM_ROWS = f"WITH {Q.ITEMS}, {Q.stratified('items', iters=1)}"
VARIANCE = "count(*) * var_pop(y)"


def item_query(name: str, settings: B.Settings, weight: str = "1.0::DOUBLE", unit: str = VARIANCE):
    sql = f"""{ITEM_ROWS},
{boosted_sql("folded", ITEM_FEATURES, settings.num_rounds, settings.max_depth, settings, weight, unit)}
SELECT CAST(fold AS BIGINT) AS fold, row_id, round(p, 2) AS pred FROM r{settings.num_rounds} WHERE m = fold"""

    @query(name, sql)
    def build(spark, folder):
        out, _ = B.out_of_fold_boosting(_items(spark, folder), ITEM_FEATURES, Q.K, settings)
        return tidy(out.select("fold", "row_id", "pred"), 2)

    return build


item_query("boosted_stump", B.Settings(num_rounds=1, max_depth=1, eta=0.3, lam=100.0, alpha=1e6, gamma=1e8, min_child_weight=50))
item_query("boosted_two_levels", B.Settings(num_rounds=1, max_depth=2, eta=0.3, lam=100.0, alpha=1e6, gamma=1e9, min_child_weight=50))
item_query("boosted_rounds", B.Settings(num_rounds=4, max_depth=2, eta=0.5, lam=1.0, gamma=1e10))
item_query("boosted_rmspe", B.Settings(num_rounds=2, max_depth=2, eta=0.5, lam=1.0, objective="rmspe"), "CASE WHEN y <> 0 THEN pow(top / y, 2) ELSE 0 END")


def _extra_query(name: str, settings: B.Settings):
    sql = f"""{ITEM_ROWS},
{boosted_sql("folded", ITEM_FEATURES, 1, settings.max_depth, settings, unit=VARIANCE)}
SELECT CAST(fold AS BIGINT) AS fold, row_id, round(p, 2) AS pred FROM r1 WHERE m = fold"""

    @query(name, sql)
    def build(spark, folder):
        """One tree whose thresholds are drawn, with the draws written out in SQL."""
        out = B.out_of_fold_forest(_items(spark, folder), ITEM_FEATURES, Q.K, 1, settings)
        return tidy(out.select("fold", "row_id", "pred"), 2)


_extra_query("random_split_tree", B.Settings(num_rounds=1, max_depth=2, eta=1.0, lam=0.0, seed=19, random_splits=True, split_features=0.8))

WATCHED = B.Settings(num_rounds=8, max_depth=1, eta=1.0, lam=1.0, metric="rmse", patience=2)


def _history_sql() -> str:
    """Loss of every prefix of rounds, the round at which patience ends, and the prefix that is kept."""
    parts = [ITEM_ROWS, boosted_sql("folded", ITEM_FEATURES, WATCHED.num_rounds, WATCHED.max_depth, WATCHED, unit=VARIANCE)]
    losses = " UNION ALL ".join(f"SELECT fold, {t} AS rounds, sqrt(avg(pow(y - p, 2))) AS loss FROM r{t} WHERE m = fold GROUP BY fold" for t in range(WATCHED.num_rounds + 1))
    parts += [
        f"losses AS ({losses})",
        "sofar AS (SELECT *, arg_min(rounds, (loss, rounds)) OVER (PARTITION BY fold ORDER BY rounds ROWS UNBOUNDED PRECEDING) AS best FROM losses)",
        f"ends AS (SELECT fold, coalesce(min(rounds) FILTER (rounds - best >= {WATCHED.patience}), {WATCHED.num_rounds}) AS stop FROM sofar GROUP BY fold)",
        "seen AS (SELECT s.* FROM sofar s JOIN ends e ON s.fold = e.fold AND rounds <= stop)",
    ]
    return ",\n".join(parts) + """
SELECT CAST(fold AS BIGINT) AS fold, CAST(rounds AS BIGINT) AS rounds, round(loss, 4) AS loss,
       CAST(rounds = arg_min(rounds, (loss, rounds)) OVER (PARTITION BY fold) AS BIGINT) AS kept FROM seen"""


@query("boosted_history", _history_sql())
def boosted_history(spark, folder):
    """Watch loss round by round and the rounds that are kept: full steps overshoot, so patience ends some folds early."""
    _, history = B.out_of_fold_boosting(_items(spark, folder), ITEM_FEATURES, Q.K, WATCHED)
    return tidy(history.select("fold", "rounds", "loss", "kept"), 4)


def _kept_sql() -> str:
    cases = " ".join(f"WHEN {t} THEN r{t}.p" for t in range(WATCHED.num_rounds + 1))
    joins = " ".join(f"JOIN r{t} ON r{t}.m = r0.m AND r{t}.row_id = r0.row_id" for t in range(1, WATCHED.num_rounds + 1))
    history = _history_sql()
    at = history.rindex("\nSELECT CAST(fold")
    return f"""{history[:at]},
kept AS (SELECT fold AS kf, arg_min(rounds, (loss, rounds)) AS n FROM seen GROUP BY fold)
SELECT CAST(r0.fold AS BIGINT) AS fold, r0.row_id, round(CASE n {cases} END, 2) AS pred FROM r0 JOIN kept ON kf = r0.fold {joins} WHERE r0.m = r0.fold"""


@query("boosted_kept_prefix", _kept_sql())
def boosted_kept_prefix(spark, folder):
    """Predictions of the kept rounds alone, from the trees that were grown while watching."""
    out, _ = B.out_of_fold_boosting(_items(spark, folder), ITEM_FEATURES, Q.K, WATCHED)
    return tidy(out.select("fold", "row_id", "pred"), 2)


LINEAR = {"num_rounds": 4, "eta": 0.7, "lambda": 2000.0, "alpha": 1e6, "lambda_bias": 10.0}


def _linear_sql() -> str:
    """Every coordinate update as a CTE over the moments of the other folds."""
    names = ("l_quantity", "p_size")
    sums = ", ".join([f"sum({a}) AS s{a}" for a in names] + [f"sum({a} * {b}) AS s{a}{b}" for i, a in enumerate(names) for b in names[i:]] + [f"sum({a} * y) AS s{a}y" for a in names])
    cross = lambda a, b: f"s{a}{b}" if names.index(a) <= names.index(b) else f"s{b}{a}"
    e, lam, alpha, bias = (f"{LINEAR[k]}::DOUBLE" for k in ("eta", "lambda", "alpha", "lambda_bias"))
    parts = [f"w0 AS (SELECT *, sy / n AS b, {', '.join(f'0.0::DOUBLE AS w{a}' for a in names)} FROM mo)"]
    last = "w0"
    for t in range(LINEAR["num_rounds"]):
        slope = " + ".join(f"s{a} * w{a}" for a in names)
        parts.append(f"b{t} AS (SELECT * REPLACE (b - {e} * (n * b + {slope} - sy + {bias} * b) / (n + {bias}) AS b) FROM {last})")
        last = f"b{t}"
        for k, a in enumerate(names):
            rest = " + ".join(f"{cross(a, o)} * w{o}" for o in names if o != a)
            parts += [
                f"f{t}_{k} AS (SELECT *, (s{a}y - s{a} * b - ({rest})) / ({cross(a, a)} + {lam}) AS free FROM {last})",
                f"u{t}_{k} AS (SELECT * EXCLUDE (free) REPLACE (w{a} + {e} * (sign(free) * greatest(abs(free) - {alpha} / ({cross(a, a)} + {lam}), 0) - w{a}) AS w{a}) FROM f{t}_{k})",
            ]
            last = f"u{t}_{k}"
    return f"""{ITEM_ROWS}, mo AS (SELECT v.iter, v.fold, count(*) AS n, sum(y) AS sy, {sums}
  FROM folded t JOIN (SELECT DISTINCT iter, fold FROM folded) v ON t.iter = v.iter AND t.fold <> v.fold GROUP BY ALL),
{", ".join(parts)}
SELECT CAST(f.fold AS BIGINT) AS fold, row_id, round(b + {" + ".join(f"w{a} * f.{a}" for a in names)}, 2) AS pred FROM folded f JOIN {last} l ON f.fold = l.fold"""


@query("linear_booster_rounds", _linear_sql())
def linear_booster_rounds(spark, folder):
    """Four rounds of coordinate updates on two features, all folds from one aggregation."""
    names = ["l_quantity", "p_size"]
    out = LE.out_of_fold(_items(spark, folder, names), "xgb_linear", names, Q.K, 1, LINEAR)
    return tidy(out.select("fold", "row_id", "pred"), 2)


@query(
    "pair_gradients",
    f"""WITH {Q.SALES}, v AS (SELECT row_id, kind, stratum, CAST(floor(y / 20000) AS BIGINT) AS y, x / 5000.0::DOUBLE AS s FROM sales)
    SELECT a.row_id, count(*) FILTER (b.y < a.y) AS n_pairs, round(coalesce(sum(exp(-(a.s - b.s))) FILTER (b.y < a.y), 0), 4) AS loss,
    round(coalesce(sum(exp(-(b.s - a.s))) FILTER (b.y > a.y), 0) - coalesce(sum(exp(-(a.s - b.s))) FILTER (b.y < a.y), 0), 4) + 0.0 AS gradient
    FROM v a JOIN v b ON a.kind = b.kind AND a.stratum = b.stratum GROUP BY a.row_id""",
)
def pair_gradients(spark, folder):
    """Loss and gradient of every row over all better-worse pairs of its group, against the self-join of all pairs."""
    rows = tables.sales(spark, folder).select("row_id", "kind", "stratum", F.floor(F.col("y") / 20000).alias("y"), (F.col("x") / 5000).alias("s"))
    out = P.pair_gradients(rows, F.col("s"), "y", ["kind", "stratum"])
    return tidy(out.select("row_id", "n_pairs", "loss", "gradient"), 4)


@query("metric_evaluator", f"WITH {Q.LIBRARY} SELECT model, round({Q.RMSPE}, 6) AS rmspe, round(sqrt(avg(pow(y - pred, 2))), 4) AS rmse FROM preds WHERE iter = 0 GROUP BY model")
def metric_evaluator(spark, folder):
    """Registered metrics called the way Spark ML's model selection calls an evaluator, one model after the other."""
    long = materialise(predictions(spark, folder).filter("iter = 0"), "predictions")
    rows = [(m, *(MetricEvaluator(metric).evaluate(long.filter(F.col("model") == m)) for metric in ("rmspe", "rmse"))) for m in Q.MODELS]
    scored = spark.createDataFrame(rows, "model string, rmspe double, rmse double")
    return tidy(scored.select("model", "rmspe", F.round("rmse", 4).alias("rmse")))
