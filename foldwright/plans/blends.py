"""Queries: blends, weight grids, greedy selection, recipes, prefix averages, search, stored submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions import scalar as S
from foldwright.functions.hashing import hash_uniform
from foldwright.functions.sampling import Choice, LogUniform, Uniform, whole
from foldwright.operators import ensemble as E
from foldwright.operators import library as L
from foldwright.operators import search as SE
from foldwright.operators import stacking as ST
from foldwright.operators.features import leave_fold_out_moments
from foldwright.operators.pairs import pair_count, preference_pairs
from foldwright.plans import sql as Q
from foldwright.plans.common import folded_sales, library, predictions, tidy
from foldwright.plans.registry import query
from foldwright.session import materialise, scratch_path, small_side
from foldwright.sources import files, tables

IF = "CAST(iter AS BIGINT) AS iter, CAST(fold AS BIGINT) AS fold"


@query("two_model_blend", f"WITH {Q.LIBRARY} SELECT {IF}, row_id, y, round(0.3 * by_kind + 0.7 * ols, 3) AS pred FROM wide")
def two_model_blend(spark, folder):
    """Two models of the long table side by side, blended."""
    wide = L.to_wide(predictions(spark, folder), ["by_kind", "ols"], ["iter", "fold", "row_id", "y"])
    blend = S.blend_linear(F.col("by_kind"), F.col("ols"), 0.3)
    return tidy(wide.select("iter", "fold", "row_id", "y", blend.alias("pred")), 3)


@query("blend_linear", f"WITH {Q.LIBRARY} SELECT {IF}, row_id, round(0.25 * log_mean + 0.75 * ridge, 3) AS pred FROM wide")
def blend_linear(spark, folder):
    blend = S.blend_linear(F.col("log_mean"), F.col("ridge"), 0.25)
    return tidy(library(spark, folder).select("iter", "fold", "row_id", blend.alias("pred")), 3)


@query(
    "blend_variants",
    f"""WITH {Q.LIBRARY} SELECT {IF}, row_id, round((log_mean + 0.4 * ols) / 1.4, 3) AS ratio, round(2.0::DOUBLE / (0.4 / log_mean + 0.6 / ols), 3) AS harmonic,
    round(0.4 * ln(log_mean) + 0.6 * ln(ols), 6) AS log, round(log_mean * ols / (log_mean + ols), 3) AS product_over_sum, round((log_mean + ols) / 2, 3) AS mean,
    round(0.7 * pow(log_mean, 0.01) + 0.3 * pow(ols, 0.01), 6) AS power FROM wide""",
)
def blend_variants(spark, folder):
    a, b = F.col("log_mean"), F.col("ols")
    wide = library(spark, folder)
    return wide.select(
        F.col("iter").cast("bigint").alias("iter"),
        F.col("fold").cast("bigint").alias("fold"),
        "row_id",
        F.round(S.blend_ratio(a, b, 0.4), 3).alias("ratio"),
        F.round(S.blend_harmonic(a, b, 0.4), 3).alias("harmonic"),
        F.round(S.blend_log(a, b, 0.4), 6).alias("log"),
        F.round(S.blend_product_over_sum(a, b), 3).alias("product_over_sum"),
        F.round(S.blend_mean(a, b), 3).alias("mean"),
        F.round(S.blend_power(a, b, 0.7, 0.01), 6).alias("power"),
    )


# Four prior models, weight 0.463 and powers 0.01 .. 0.04.
PRIOR_WEIGHT = 0.463
PRIOR_POWERS = {f"xgboost-art@{i}": 0.01 * i for i in range(1, 5)}


@query(
    "power_blend",
    f"WITH {Q.LIBRARY} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS model, {IF}, row_id, round({PRIOR_WEIGHT} * pow(by_kind, {p}) + {1 - PRIOR_WEIGHT} * pow(ols, {p}), 6) AS pred FROM wide"
        for m, p in PRIOR_POWERS.items()
    ),
)
def power_blend(spark, folder):
    wide = library(spark, folder)
    wide = wide.withColumns({m: S.blend_power(F.col("by_kind"), F.col("ols"), PRIOR_WEIGHT, p) for m, p in PRIOR_POWERS.items()})
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("pred")) for m in PRIOR_POWERS])
    long = wide.select("iter", "fold", "row_id", F.explode(cells).alias("_c")).select("_c.model", "iter", "fold", "row_id", "_c.pred")
    return tidy(long)


@query(
    "append_models",
    f"""WITH {Q.LIBRARY}, more AS (SELECT 'prior@1' AS model, iter, fold, row_id, y, {PRIOR_WEIGHT} * by_kind + {1 - PRIOR_WEIGHT} * ols AS pred FROM wide),
    al AS (SELECT * FROM preds UNION ALL SELECT * FROM more) SELECT model, count(*) AS n, round(avg(pred), 3) AS mean_pred FROM al GROUP BY model""",
)
def append_models(spark, folder):
    """Prior models join the library as further rows."""
    wide = library(spark, folder)
    prior = wide.select(
        F.lit("prior@1").alias("model"), "iter", "fold", "row_id", "y", S.blend_linear(F.col("by_kind"), F.col("ols"), PRIOR_WEIGHT).alias("pred")
    )
    both = L.to_long(wide, Q.MODELS).unionByName(prior)
    return tidy(both.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred")), 3)


@query(
    "gram_matrix",
    f"""WITH {Q.LIBRARY}, e AS (SELECT model, iter, fold, row_id, (y - pred) / y AS e FROM preds)
    SELECT CAST(a.iter AS BIGINT) AS iter, CAST(a.fold AS BIGINT) AS fold, a.model AS i, b.model AS j, round(avg(a.e * b.e), 6) AS g
    FROM e a JOIN e b ON a.iter = b.iter AND a.fold = b.fold AND a.row_id = b.row_id GROUP BY 1, 2, 3, 4""",
)
def gram_matrix(spark, folder):
    return tidy(E.gram_matrix(library(spark, folder), Q.MODELS, "rmspe"))


@query("gram_matrix_blocks", f"""WITH {Q.LIBRARY}, e AS (SELECT model, iter, fold, row_id, (y - pred) / y AS e FROM preds)
    SELECT CAST(a.iter AS BIGINT) AS iter, CAST(a.fold AS BIGINT) AS fold, a.model AS i, b.model AS j, round(avg(a.e * b.e), 6) AS g
    FROM e a JOIN e b ON a.iter = b.iter AND a.fold = b.fold AND a.row_id = b.row_id GROUP BY 1, 2, 3, 4""")
def gram_matrix_blocks(spark, folder):
    """The form for libraries of hundreds of models."""
    return tidy(E.gram_by_blocks(library(spark, folder), Q.MODELS, "rmspe"))


@query(
    "blend_weight_grid",
    f"""WITH {Q.LIBRARY}, w AS (SELECT unnest(range(101)) / 100.0::DOUBLE AS weight),
    s AS (SELECT weight, iter, fold, sqrt(avg(pow((y - (weight * ols + (1 - weight) * log_mean)) / y, 2))) AS score FROM wide, w GROUP BY ALL)
    SELECT weight, round(avg(score), 6) AS score FROM s GROUP BY weight""",
)
def blend_weight_grid(spark, folder):
    gram = E.gram_matrix(library(spark, folder), ["ols", "log_mean"], "rmspe")
    return tidy(E.weight_grid(gram, "ols", "log_mean"))


STEP1 = Q.SCORES + """,
seed AS (SELECT model FROM ranking WHERE model_rank = 1),
e AS (SELECT model, iter, fold, row_id, (y - pred) / y AS e FROM preds),
cross_g AS (SELECT b.model, a.iter, a.fold, avg(a.e * a.e) AS aa, avg(a.e * b.e) AS ab, avg(b.e * b.e) AS bb
  FROM e a JOIN seed ON a.model = seed.model JOIN e b ON a.iter = b.iter AND a.fold = b.fold AND a.row_id = b.row_id GROUP BY ALL),
w AS (SELECT unnest(range(101)) / 100.0::DOUBLE AS weight),
tried AS (SELECT model, weight, round(avg(sqrt(greatest(weight * weight * aa + 2 * weight * (1 - weight) * ab + (1 - weight) * (1 - weight) * bb, 0))), 9) AS score FROM cross_g, w GROUP BY ALL)"""


@query(
    "greedy_step1",
    f"WITH {STEP1} SELECT model, min_by(weight, (score, weight)) AS weight, round(min(score), 6) AS score FROM tried GROUP BY model",
)
def greedy_step1(spark, folder):
    """Best weight of every candidate next to the seed."""
    gram = materialise(E.gram_matrix(library(spark, folder), Q.MODELS, "rmspe"), "gram")
    singles = gram.filter(F.col("i") == F.col("j")).groupBy("i").agg(F.avg(F.sqrt("g")).alias("cv"))
    seed = singles.orderBy("cv", "i").limit(1).first()["i"]
    pieces = []
    for m in Q.MODELS:
        grid = E.weight_grid(gram, seed, m).withColumn("score", F.round("score", 9))
        best = grid.agg(F.min_by("weight", F.struct("score", "weight")).alias("weight"), F.min("score").alias("score"))
        pieces.append(best.select(F.lit(m).alias("model"), "weight", "score"))
    return tidy(reduce(DataFrame.unionByName, pieces))


# Members that differ from the label by independent noise, so that blending them gains.
NOISE = {f"noisy{i}": 0.2 + 0.05 * i for i in range(5)}
GREEDY_MODELS = [*Q.MODELS, *NOISE]
# The SQL twin writes every step out; selection itself ends when nothing gains, well before.
SQL_STEPS = 30


def noisy_library(spark, folder) -> DataFrame:
    rows = library(spark, folder)
    draw = {m: F.lit(2.0) * hash_uniform(i, F.col("row_id")) - F.lit(1.0) for i, m in enumerate(NOISE)}
    return rows.withColumns({m: F.col("y") * (F.lit(1.0) + F.lit(a) * draw[m]) for m, a in NOISE.items()})


def _greedy_parts() -> list[str]:
    """CTEs of greedy selection, step by step on the Gram matrix, over the whole noisy library."""
    noisy = " UNION ALL ".join(
        f"SELECT '{m}' AS model, iter, fold, row_id, y, y * (1 + {a!r}::DOUBLE * (2 * {Q.uniform(i, 'row_id')} - 1)) AS pred FROM wide"
        for i, (m, a) in enumerate(NOISE.items())
    )
    parts = [
        Q.LIBRARY,
        f"""e AS MATERIALIZED (SELECT model, iter, fold, row_id, (y - pred) / y AS e FROM (SELECT * FROM preds UNION ALL {noisy}))""",
        """g AS MATERIALIZED (SELECT a.iter, a.fold, a.model AS i, b.model AS j, avg(a.e * b.e) AS g FROM e a JOIN e b ON a.iter = b.iter AND a.fold = b.fold AND a.row_id = b.row_id GROUP BY ALL)""",
        "w AS MATERIALIZED (SELECT unnest(range(101)) / 100.0::DOUBLE AS weight)",
        "single AS MATERIALIZED (SELECT i AS model, avg(sqrt(g)) AS score FROM g WHERE i = j GROUP BY i)",
        "best0 AS MATERIALIZED (SELECT 0 AS step, model, 1.0::DOUBLE AS weight, score FROM single ORDER BY round(score, 9), model LIMIT 1)",
        "c0 AS MATERIALIZED (SELECT s.model, CASE WHEN s.model = b.model THEN 1.0::DOUBLE ELSE 0 END AS c FROM single s, best0 b)",
    ]
    for s in range(1, SQL_STEPS + 1):
        p = s - 1
        parts += [
            f"own{s} AS (SELECT iter, fold, sum(a.c * b.c * g) AS own FROM g JOIN c{p} a ON a.model = i JOIN c{p} b ON b.model = j GROUP BY ALL)",
            f"cross{s} AS (SELECT iter, fold, j AS model, sum(a.c * g) AS cx FROM g JOIN c{p} a ON a.model = i GROUP BY ALL)",
            f"""try{s} AS (SELECT x.model, weight, round(avg(sqrt(greatest(weight * weight * own + 2 * weight * (1 - weight) * cx + (1 - weight) * (1 - weight) * g.g, 0))), 9) AS score
            FROM cross{s} x JOIN own{s} o USING (iter, fold) JOIN g ON g.iter = x.iter AND g.fold = x.fold AND g.i = x.model AND g.j = x.model, w GROUP BY ALL)""",
            f"top{s} AS (SELECT model, min_by(weight, (score, weight)) AS weight, min(score) AS score FROM try{s} GROUP BY model)",
            f"""best{s} AS MATERIALIZED (SELECT {s} AS step, t.model, t.weight, t.score FROM top{s} t, best{p} b WHERE b.score - t.score >= 0.000001::DOUBLE ORDER BY t.score, t.model LIMIT 1)""",
            f"c{s} AS MATERIALIZED (SELECT c.model, c.c * b.weight + CASE WHEN c.model = b.model THEN 1 - b.weight ELSE 0 END AS c FROM c{p} c, best{s} b)",
        ]
    return parts


def _greedy_sql() -> str:
    picks = " UNION ALL ".join(f"SELECT * FROM best{s}" for s in range(SQL_STEPS + 1))
    return f"WITH {', '.join(_greedy_parts())} SELECT CAST(step AS BIGINT) AS step, model, weight, round(score, 6) AS score FROM ({picks})"


@query("greedy_full", _greedy_sql())
def greedy_full(spark, folder):
    """Selection over the whole library until no candidate gains."""
    gram = E.gram_matrix(noisy_library(spark, folder), GREEDY_MODELS, "rmspe")
    return tidy(E.recipe_table(spark, E.greedy_select(gram, GREEDY_MODELS)))


@query("recipe_round_trip", _greedy_sql())
def recipe_round_trip(spark, folder):
    """The recipe as a stored table."""
    gram = E.gram_matrix(noisy_library(spark, folder), GREEDY_MODELS, "rmspe")
    table = E.recipe_table(spark, E.greedy_select(gram, GREEDY_MODELS))
    return tidy(files.round_trip(table, "recipe"))


def _test_matrix(spark, folder) -> DataFrame:
    """Every model of the noisy library, fitted on all rows, on the test rows: one column per model."""
    rows = tables.sales(spark, folder)
    lines = {n: (F.col("my") + F.col("sp") / (F.col("ss") + F.lit(penalty)) * (F.col("x") - F.col("mx"))) for n, penalty in (("ols", 0.0), ("ridge", Q.RIDGE))}
    whole = rows.agg(
        F.avg("y").alias("mean"), F.expm1(F.avg(F.log1p("y"))).alias("log_mean"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        (F.covar_pop("x", "y") * F.count(F.lit(1))).alias("sp"), (F.var_pop("x") * F.count(F.lit(1))).alias("ss"),
    )
    out = rows.crossJoin(F.broadcast(whole))  # one row
    for model, group in (("by_kind", "kind"), ("by_stratum", "stratum")):
        out = out.join(small_side(rows.groupBy(group).agg(F.avg("y").alias(model))), group)
    draw = {m: F.lit(2.0) * hash_uniform(100 + i, F.col("row_id")) - F.lit(1.0) for i, m in enumerate(NOISE)}
    noisy = {m: F.col("y") * (F.lit(1.0) + F.lit(a) * draw[m]) for m, a in NOISE.items()}
    return out.withColumns({**lines, **noisy}).select("row_id", *GREEDY_MODELS)


def _selected_sql() -> str:
    cells = {m: f"y * (1 + {a!r}::DOUBLE * (2 * {Q.uniform(100 + i, 'row_id')} - 1))" for i, (m, a) in enumerate(NOISE.items())}
    cells |= {"mean": "my", "log_mean": "log_mean", "by_kind": "avg(y) OVER (PARTITION BY kind)", "by_stratum": "avg(y) OVER (PARTITION BY stratum)"}
    cells |= {n: f"my + sp / (ss + {penalty}::DOUBLE) * (x - mx)" for n, penalty in (("ols", 0.0), ("ridge", Q.RIDGE))}
    steps = " UNION ALL ".join(f"SELECT {s} AS step, * FROM c{s}" for s in range(SQL_STEPS + 1))
    long = " UNION ALL ".join(f"SELECT row_id, '{m}' AS model, {m} AS pred FROM tested" for m in ('"mean"' if m == "mean" else m for m in GREEDY_MODELS))
    long = long.replace("""'"mean"'""", "'mean'")
    return f"""WITH {', '.join(_greedy_parts())}, steps AS ({steps}), coefs AS (SELECT model, c FROM steps WHERE step = (SELECT max(step) FROM steps)),
    fitted AS (SELECT avg(y) AS my, exp(avg(ln(y + 1))) - 1 AS log_mean, avg(x) AS mx, covar_pop(x, y) * count(*) AS sp, var_pop(x) * count(*) AS ss FROM sales),
    tested AS (SELECT row_id, {", ".join(f'{e} AS "{m}"' for m, e in cells.items())} FROM sales, fitted),
    blended AS (SELECT row_id, sum(c * pred) AS p FROM ({long}) JOIN coefs USING (model) GROUP BY row_id)
    SELECT row_id AS "Id", round(CASE WHEN (SELECT min(p) FROM blended) < 0 THEN (p - (SELECT min(p) FROM blended)) / (SELECT max(p) - min(p) FROM blended) ELSE p END, 3) AS "Sales" FROM blended"""


@query("selected_submission", _selected_sql())
def selected_submission(spark, folder):
    """The whole chain: select over the out-of-fold library, store the recipe, replay it on test predictions, submit."""
    gram = E.gram_matrix(noisy_library(spark, folder), GREEDY_MODELS, "rmspe")
    recipe = E.recipe_steps(files.round_trip(E.recipe_table(spark, E.greedy_select(gram, GREEDY_MODELS)), "recipe"))
    tested = L.to_long(_test_matrix(spark, folder), GREEDY_MODELS, keep=("row_id",))
    blended = materialise(E.replay(tested, recipe).withColumn("model", F.lit("ensemble")), "ensemble")
    root = scratch_path(spark, "submissions")
    version = files.write_submission(L.rescale(blended, S.minmax_if_negative), root)
    return tidy(files.read_submission(spark, root, "model_library", version), 3)


RECIPE = [E.Step(0, "log_mean", 1.0, 0.0), E.Step(1, "by_kind", 0.6, 0.0), E.Step(2, "ridge", 0.75, 0.0), E.Step(3, "log_mean", 0.9, 0.0)]


@query(
    "recipe_replay",
    f"""WITH {Q.LIBRARY}, a AS (SELECT *, 0.6 * log_mean + 0.4 * by_kind AS p1 FROM wide), b AS (SELECT *, 0.75 * p1 + 0.25 * ridge AS p2 FROM a)
    SELECT CAST(iter AS BIGINT) AS iter, row_id, round(0.9 * p2 + 0.1 * log_mean, 3) AS pred FROM b""",
)
def recipe_replay(spark, folder):
    """A recipe applied step by step equals one weighted sum per row."""
    return tidy(E.replay(predictions(spark, folder), RECIPE, ["iter", "row_id"]), 3)


def _prefix_sql(into: str, back: str) -> str:
    order = ["log_mean", "by_kind", "by_stratum", "mean", "ridge", "ols"]
    place = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(order, 1))
    return f"""WITH {Q.LIBRARY}, r AS (SELECT *, CASE model {place} END AS n_models FROM preds),
    a AS (SELECT iter, fold, row_id, y, n_models, {back.format(f"avg({into}) OVER (PARTITION BY iter, fold, row_id ORDER BY n_models ROWS UNBOUNDED PRECEDING)")} AS pred FROM r)"""


PREFIX_ORDER = ["log_mean", "by_kind", "by_stratum", "mean", "ridge", "ols"]


@query("prefix_average", _prefix_sql("pred", "{}") + f" SELECT {IF}, row_id, CAST(n_models AS BIGINT) AS n_models, round(pred, 3) AS pred FROM a")
def prefix_average(spark, folder):
    averaged = E.prefix_average(library(spark, folder), PREFIX_ORDER)
    return tidy(averaged.select("iter", "fold", "row_id", "n_models", "pred"), 3)


@query("prefix_average_log", _prefix_sql("ln(pred)", "exp({})") + f" SELECT {IF}, row_id, CAST(n_models AS BIGINT) AS n_models, round(pred, 3) AS pred FROM a")
def prefix_average_log(spark, folder):
    averaged = E.prefix_average(library(spark, folder), PREFIX_ORDER, "log")
    return tidy(averaged.select("iter", "fold", "row_id", "n_models", "pred"), 3)


@query("prefix_average_harmonic", _prefix_sql("1 / pred", "1 / ({})") + f" SELECT {IF}, row_id, CAST(n_models AS BIGINT) AS n_models, round(pred, 3) AS pred FROM a")
def prefix_average_harmonic(spark, folder):
    averaged = E.prefix_average(library(spark, folder), PREFIX_ORDER, "harmonic")
    return tidy(averaged.select("iter", "fold", "row_id", "n_models", "pred"), 3)


@query(
    "prefix_best",
    f"""WITH {Q.SCORES}, r AS (SELECT p.*, model_rank AS n_models FROM preds p JOIN ranking USING (model)),
    a AS (SELECT iter, fold, row_id, y, n_models, avg(pred) OVER (PARTITION BY iter, fold, row_id ORDER BY n_models ROWS UNBOUNDED PRECEDING) AS pred FROM r),
    s AS (SELECT n_models, iter, fold, {Q.RMSPE} AS score FROM a GROUP BY ALL), c AS (SELECT n_models, avg(score) AS score FROM s GROUP BY 1)
    SELECT n_models, round(score, 6) AS score, CAST(n_models = (SELECT min_by(n_models, (round(score, 9), n_models)) FROM c) AS BIGINT) AS is_best FROM c""",
)
def prefix_best(spark, folder):
    wide = library(spark, folder)
    summary = L.cv_summary(L.score(L.to_long(wide, Q.MODELS), "rmspe"))
    order = [r["model"] for r in L.ranking(summary, "rmspe").orderBy("model_rank").collect()]  # one row per model
    return tidy(E.prefix_scores(E.prefix_average(wide, order), "rmspe"))


@query(
    "rank_average",
    f"""WITH {Q.LIBRARY}, r AS (SELECT iter, fold, row_id, row_number() OVER (PARTITION BY model, iter, fold ORDER BY pred, row_id) / CAST(count(*) OVER (PARTITION BY model, iter, fold) AS DOUBLE) AS rp
    FROM preds) SELECT {IF}, row_id, round(avg(rp), 6) AS pred FROM r GROUP BY iter, fold, row_id""",
)
def rank_average(spark, folder):
    keys = ["iter", "fold", "row_id"]
    ranked = L.dealt_by(E.rank_normalise(predictions(spark, folder).drop("y")).select(*keys, "rank_pred"), keys)
    return tidy(ranked.groupBy("iter", "fold", "row_id").agg(F.avg("rank_pred").alias("pred")))


@query(
    "prefix_rank_average",
    f"""WITH {Q.SCORES}, r AS (SELECT p.iter, p.fold, p.row_id, model_rank AS n_models, row_number() OVER (PARTITION BY model, iter, fold ORDER BY pred, row_id) / CAST(count(*) OVER (PARTITION BY model, iter, fold) AS DOUBLE) AS rp
    FROM preds p JOIN ranking USING (model)) SELECT {IF}, row_id, n_models, round(avg(rp) OVER (PARTITION BY iter, fold, row_id ORDER BY n_models ROWS UNBOUNDED PRECEDING), 6) AS pred FROM r""",
)
def prefix_rank_average(spark, folder):
    """Mean rank of the best 1, 2, ... models, best by score."""
    wide = library(spark, folder)
    long = L.to_long(wide, Q.MODELS)
    order = L.ranking(L.cv_summary(L.score(long, "rmspe")), "rmspe").orderBy("model_rank").collect()  # one row per model
    averaged = E.prefix_rank_average(long, [r["model"] for r in order])
    return tidy(averaged.select("iter", "fold", "row_id", "n_models", "pred"))


# Known scores of eight stored submissions.
KNOWN = {1: 0.391206, 2: 0.391175, 3: 0.391161, 4: 0.391131, 5: 0.391122, 6: 0.383670, 7: 0.381138, 8: 0.328270}
_NOISE = Q.uniform(17, "s", "row_id")


@query(
    "submission_monotone",
    f"""WITH {Q.SALES}, n AS (SELECT row_id AS id, y * (1 + ({Q.uniform(99, "row_id")} - 0.5) / 4) AS new_pred FROM sales),
    st AS (SELECT s AS submission, row_id AS id, y * (1 + ({_NOISE} - 0.5) * s / 8) AS pred FROM sales, range(1, 9) t(s)),
    r AS (SELECT submission, pred, row_number() OVER (PARTITION BY submission ORDER BY new_pred DESC, st.id) AS rp, row_number() OVER (PARTITION BY submission ORDER BY pred DESC, st.id) AS rt,
      count(*) OVER (PARTITION BY submission) AS n FROM st JOIN n ON st.id = n.id),
    g AS (SELECT submission, round((max(n) / 2.0::DOUBLE - sum(pred * (n - rp + 1)) / sum(pred)) / (max(n) / 2.0::DOUBLE - sum(pred * (n - rt + 1)) / sum(pred)), 9) AS gini FROM r GROUP BY 1),
    k AS (SELECT g.*, v.score AS known_score FROM g JOIN (VALUES {", ".join(f"({i}, {s}::DOUBLE)" for i, s in KNOWN.items())}) v(submission, score) USING (submission)),
    o AS (SELECT *, lead(gini) OVER (ORDER BY submission) AS g2, lead(known_score) OVER (ORDER BY submission) AS k2 FROM k)
    SELECT submission, round(gini, 6) AS gini, known_score, CAST(g2 IS NULL OR gini > g2 OR (gini = g2 AND known_score >= k2) AS BIGINT) AS in_order FROM o""",
)
def submission_monotone(spark, folder):
    """A new submission against eight stored ones of decreasing quality."""
    rows = tables.sales(spark, folder).select(F.col("row_id").alias("id"), "y")
    new = rows.select("id", (F.col("y") * (F.lit(1.0) + (hash_uniform(99, F.col("id")) - F.lit(0.5)) / F.lit(4.0))).alias("pred"))
    numbered = rows.withColumn("submission", F.explode(F.sequence(F.lit(1), F.lit(8))))
    noise = hash_uniform(17, F.col("submission"), F.col("id")) - F.lit(0.5)
    stored = numbered.select("submission", "id", (F.col("y") * (F.lit(1.0) + noise * F.col("submission") / F.lit(8.0))).alias("pred"))
    return tidy(E.stored_submission_check(new, stored, KNOWN))


PAIRS = 2


@query(
    "rank_pairs",
    f"""WITH {Q.SALES}, v AS (SELECT row_id, CAST(substr(stratum, 1, 1) AS BIGINT) * 10 + length(kind) AS y FROM sales),
    r AS (SELECT *, row_number() OVER (ORDER BY y, row_id) AS rk, count(*) OVER () AS n, count(*) OVER (PARTITION BY y) AS run FROM v),
    s AS (SELECT *, min(rk) OVER (PARTITION BY y) - 1 AS start FROM r),
    d AS (SELECT s.*, draw, CAST(floor({Q.uniform(711, "row_id", "draw")} * (n - run)) AS BIGINT) AS t FROM s, range({PAIRS}) q(draw)),
    p AS (SELECT *, CASE WHEN t < start THEN t ELSE t + run END + 1 AS pick FROM d)
    SELECT p.row_id, CAST(p.draw AS BIGINT) AS draw, b.row_id AS partner_id, CAST(CASE WHEN p.y > b.y THEN 1 ELSE -1 END AS BIGINT) AS sign FROM p JOIN r b ON b.rk = p.pick""",
)
def rank_pairs(spark, folder):
    label = F.substring("stratum", 1, 1).cast("bigint") * 10 + F.length("kind")
    rows = tables.sales(spark, folder).select("row_id", label.alias("y"))
    return tidy(preference_pairs(rows, "y", per_row=PAIRS))


@query(
    "rank_pair_count",
    f"""WITH {Q.SALES}, c AS (SELECT stratum, count(*) AS c FROM sales GROUP BY 1), t AS (SELECT sum(c) AS n, sum(c * c) AS q FROM c)
    SELECT CAST((n * n - q) // 2 AS BIGINT) AS n_pairs FROM t""",
)
def rank_pair_count(spark, folder):
    return pair_count(tables.sales(spark, folder), "stratum")


TRIALS = 100
SPACE = {"alpha": LogUniform(1e8, 1e13), "rounds": whole(10, 500, 10), "rate": Uniform(0.01, 0.5, 0.01), "weights": Choice(("uniform", "distance"))}


def _draw(name: str) -> str:
    return Q.uniform(711, "trial", f"'{name}'")


TRIAL_SQL = f"""trials AS (SELECT trial, exp(ln(1e8::DOUBLE) + {_draw("alpha")} * (ln(1e13::DOUBLE) - ln(1e8::DOUBLE))) AS alpha,
  round((10 + {_draw("rounds")} * 490) / 10) * 10.0::DOUBLE AS rounds, round((0.01 + {_draw("rate")} * 0.49) / 0.01::DOUBLE) * 0.01::DOUBLE AS rate,
  CASE CAST(floor({_draw("weights")} * 2) AS INT) WHEN 0 THEN 'uniform' ELSE 'distance' END AS weights FROM range(1, {TRIALS + 1}) t(trial))"""

SEARCH = Q.LIBRARY + f""", {TRIAL_SQL},
fits AS (SELECT t.trial, t.alpha, t.rounds, t.rate, t.weights, f.iter, f.fold, sqrt(avg(pow(f.y - (o.my + o.sp / (o.ss + alpha) * (f.x - o.mx)), 2))) AS score
  FROM folded f JOIN overall o USING (iter, fold), trials t GROUP BY ALL),
cv AS (SELECT trial, alpha, rounds, rate, weights, avg(score) AS score FROM fits GROUP BY ALL)"""


def _searched(spark, folder):
    rows = folded_sales(spark, folder)
    train = leave_fold_out_moments(rows, ["x", "y"], [("x", "y")])
    valid = rows.groupBy("iter", "fold").agg(
        F.avg("x").alias("v_mx"), F.avg("y").alias("v_my"), F.var_pop("x").alias("v_vx"), F.var_pop("y").alias("v_vy"), F.covar_pop("x", "y").alias("v_cxy")
    )
    moments = train.join(F.broadcast(valid), ["iter", "fold"])  # one row per fold
    trials = SE.trial_table(spark, SPACE, TRIALS)
    scores = SE.ridge_trials(moments, trials.select("trial", "alpha"), Q.K, Q.ITERS, "x", "y")
    return scores.join(F.broadcast(trials.drop("alpha")), "trial")  # one row per trial


@query("trial_grid", f"WITH {SEARCH} SELECT trial, round(ln(alpha), 6) AS log_alpha, rounds, round(rate, 6) AS rate, weights, round(score, 4) AS score FROM cv")
def trial_grid(spark, folder):
    """Sampled parameters and the CV error of every sampled penalty, from one pass over the rows."""
    scored = _searched(spark, folder)
    return tidy(scored.select("trial", F.round(F.log("alpha"), 6).alias("log_alpha"), "rounds", "rate", "weights", F.round("score", 4).alias("score")))


@query("search_best", f"WITH {SEARCH} SELECT trial, round(ln(alpha), 6) AS log_alpha, round(score, 4) AS score FROM cv ORDER BY round(cv.score, 6), trial LIMIT 1")
def search_best(spark, folder):
    best = _searched(spark, folder).orderBy(F.round("score", 6), "trial").limit(1)
    return tidy(best.select("trial", F.round(F.log("alpha"), 6).alias("log_alpha"), F.round("score", 4).alias("score")))


STARTED = 20


def _proposal_sql() -> str:
    """The densities written out: 24 candidates of three parameters against the first trials."""
    high, low = "ln(1e13::DOUBLE)", "ln(1e8::DOUBLE)"
    names = {
        "alpha": (f"exp({low} + u * ({high} - {low}))", "ln(value)", "ln(alpha)", f"({high} - {low})"),
        "rounds": ("round((10 + u * 490) / 10) * 10.0::DOUBLE", "value", "rounds", "490.0::DOUBLE"),
        "rate": ("round((0.01 + u * 0.49) / 0.01::DOUBLE) * 0.01::DOUBLE", "value", "rate", "0.49::DOUBLE"),
    }
    points = " UNION ALL ".join(f"SELECT good, '{n}' AS name, {p} AS p FROM ranked" for n, (_, _, p, _) in names.items())
    draws = " UNION ALL ".join(
        f"SELECT '{n}' AS name, id, value, {x} AS x, {span} AS span FROM (SELECT id, {v} AS value FROM (SELECT id, {Q.uniform(711, str(STARTED + 1), 'id', chr(39) + n + chr(39))} AS u FROM range(24) t(id)))"
        for n, (v, x, _, span) in names.items()
    )
    return f"""WITH {SEARCH}, ranked AS (SELECT *, row_number() OVER (ORDER BY score, trial) <= greatest(ceil(0.25 * count(*) OVER ()), 1) AS good FROM cv WHERE trial <= {STARTED}),
    points AS ({points}), counts AS (SELECT name, good, count(*) AS n FROM points GROUP BY ALL), draws AS ({draws}),
    near AS (SELECT d.name, d.id, d.value, p.good, exp(-0.5 * pow((x - p) / (span / sqrt(n)), 2)) AS k FROM points p JOIN counts c USING (name, good) JOIN draws d USING (name)),
    dense AS (SELECT name, id, value, round(avg(k) FILTER (good) / (coalesce(avg(k) FILTER (NOT good), 0) + 1e-9), 9) AS r FROM near GROUP BY ALL)
    SELECT name, round(ln(arg_max(value, (r, -id))), 6) + 0.0 AS log_value FROM dense GROUP BY name"""


@query("search_proposal", _proposal_sql())
def search_proposal(spark, folder):
    """What trial 21 tries, given the errors of trials 1 to 20."""
    scored = _searched(spark, folder).filter(F.col("trial") <= STARTED)
    return tidy(SE.propose(scored, SPACE, STARTED + 1).select("name", F.log("value").alias("log_value")))


# Stored best parameters of seven models.
STORED_PARAMS = {
    "standard_logistic": {"C": 0.002656192975371555},
    "standard_knn": {"n_neighbors": 150.0},
    "standard_ridge": {"alpha": 19.865153638453595},
    "standard_lasso": {"alpha": 0.09918358854815801},
    "standard_xgb_rank": {"lambda_bias": 0.2, "alpha": 0.24, "eta": 0.06, "lambda": 5.0},
    "standard_xgb_linear": {"lambda_bias": 1.8, "alpha": 0.22, "eta": 0.01, "lambda": 3.15},
    "standard_xgb_tree": {"subsample": 0.9, "eta": 0.01, "max_depth": 2.0, "gamma": 0.8, "min_child_weight": 2.0},
}


def _stored_sql() -> str:
    rows = [f"('{m}', 1, '{n}', {v}::DOUBLE)" for m, ps in STORED_PARAMS.items() for n, v in ps.items()]
    return "stored AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(model, version, param, value))"


@query(
    "best_params_upsert",
    f"""WITH {SEARCH}, {_stored_sql()}, found AS (SELECT 'standard_ridge' AS model, 2 AS version, 'alpha' AS param, alpha AS value FROM cv ORDER BY round(score, 6), trial LIMIT 1)
    SELECT model, CAST(version AS BIGINT) AS version, param, round(ln(value), 6) + 0.0 AS log_value FROM (SELECT * FROM stored WHERE model <> 'standard_ridge' UNION ALL SELECT * FROM found)""",
)
def best_params_upsert(spark, folder):
    """The searched penalty replaces the stored one."""
    stored = spark.createDataFrame([(m, 1, p) for m, p in STORED_PARAMS.items()], "model string, version int, params map<string,double>")
    best = _searched(spark, folder).orderBy(F.round("score", 6), "trial").limit(1)
    new = best.select(F.lit("standard_ridge").alias("model"), F.lit(2).alias("version"), F.create_map(F.lit("alpha"), F.col("alpha")).alias("params"))
    latest = files.round_trip(SE.upsert_params(stored, new), "best-params")
    long = latest.select("model", "version", F.explode("params").alias("param", "value"))
    return tidy(long.select("model", "version", "param", F.log("value").alias("log_value")))


@query(
    "scatter_oof",
    f"WITH {Q.LIBRARY} SELECT row_id, CAST(iter AS BIGINT) AS iter, " + ", ".join(f'round("{m}", 3) AS "{m}"' for m in Q.MODELS) + " FROM wide",
)
def scatter_oof(spark, folder):
    """Out-of-fold predictions of all models back in row order: by key, whatever fold a row was predicted in."""
    return tidy(ST.stack_matrix(predictions(spark, folder), Q.MODELS), 3)


THRESHOLD = 20.0


@query(
    "stack_matrix",
    f"""WITH {Q.SCORES}, kept AS (SELECT model FROM summary WHERE cv_mean < (SELECT avg(cv_mean) FROM summary) + 1)
    SELECT row_id, CAST(iter AS BIGINT) AS iter, count(*) AS n_models, round(sum(pred), 3) AS total, round(max(CASE WHEN model = 'log_mean' THEN pred END), 3) AS log_mean,
    round(max(CASE WHEN model = 'ridge' THEN pred END), 3) AS ridge FROM preds JOIN kept USING (model) GROUP BY row_id, iter""",
)
def stack_matrix(spark, folder):
    """Models that pass the threshold as columns, one row per row and repeat."""
    long = predictions(spark, folder)
    summary = small_side(L.cv_summary(L.score(long, "rmspe")))
    threshold = summary.agg(F.avg("cv_mean")).first()[0] + 1.0
    kept = sorted(r["model"] for r in L.passing(summary, "rmspe", threshold).collect())  # one row per model
    matrix = ST.stack_matrix(long, kept)
    total = sum((F.col(f"`{m}`") for m in kept), F.lit(0.0))
    shown = [F.col(m) if m in kept else F.lit(None).cast("double").alias(m) for m in ("log_mean", "ridge")]
    return tidy(matrix.select("row_id", "iter", F.lit(len(kept)).alias("n_models"), total.alias("total"), *shown), 3)


@query("raw_plus_meta", f"""WITH {Q.LIBRARY} SELECT row_id, CAST(iter AS BIGINT) AS iter, round(log_mean, 3) AS log_mean, round(ols, 3) AS ols, x, kind FROM wide""")
def raw_plus_meta(spark, folder):
    meta = ST.stack_matrix(predictions(spark, folder), ["log_mean", "ols"])
    return tidy(ST.with_raw_features(meta, tables.sales(spark, folder), ["x", "kind"]), 3)


# The SQL twin writes so many steps out, one more than the selection takes at any of the given sizes.
GINI_STEPS = 7


def _gini_sql() -> str:
    """Selection by Gini, step by step: every model and weight, every row ranked."""
    quoted = {m: f'"{m}"' for m in GREEDY_MODELS}
    noisy = ", ".join(f"y * (1 + {a!r}::DOUBLE * (2 * {Q.uniform(i, 'row_id')} - 1)) AS {m}" for i, (m, a) in enumerate(NOISE.items()))
    area = "(max(n) / 2.0::DOUBLE - sum(y * a) / sum(y))"
    parts = [
        Q.LIBRARY,
        f"rows AS MATERIALIZED (SELECT iter, fold, row_id, y, {', '.join(quoted[m] for m in Q.MODELS)}, {noisy} FROM wide)",
        f"""truth AS MATERIALIZED (SELECT iter, fold, {area} AS g FROM (SELECT *, count(*) OVER (PARTITION BY iter, fold) AS n,
            row_number() OVER (PARTITION BY iter, fold ORDER BY y, row_id DESC) AS a FROM rows) GROUP BY ALL)""",
    ]

    def scored(name: str, blends: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT model, wt, avg(s) AS score FROM (
            SELECT model, wt, r.iter, r.fold, {area} / max(g) AS s FROM (
              SELECT *, count(*) OVER k AS n, row_number() OVER (k ORDER BY p, row_id DESC) AS a FROM ({blends}) WINDOW k AS (PARTITION BY model, wt, iter, fold)) r
            JOIN truth t ON t.iter = r.iter AND t.fold = r.fold GROUP BY ALL) GROUP BY ALL)"""

    models = " UNION ALL ".join(f"SELECT '{m}' AS model, iter, fold, row_id, y, {c} AS q, cur FROM now{{s}}" for m, c in quoted.items())
    single = " UNION ALL ".join(f"SELECT '{m}' AS model, 100 AS wt, iter, fold, row_id, y, {c} AS p FROM rows" for m, c in quoted.items())
    parts += [
        scored("single", single),
        "best0 AS MATERIALIZED (SELECT 0 AS step, model, 1.0::DOUBLE AS weight, score FROM single ORDER BY round(score, 9) DESC, model LIMIT 1)",
        "c0 AS MATERIALIZED (SELECT " + ", ".join(f"CASE WHEN model = '{m}' THEN 1.0::DOUBLE ELSE 0 END AS c{n}" for n, m in enumerate(GREEDY_MODELS)) + " FROM best0)",
    ]
    for s in range(1, GINI_STEPS + 1):
        now = " + ".join(f"c{n} * {c}" for n, c in enumerate(quoted.values()))
        parts += [
            f"now{s} AS MATERIALIZED (SELECT rows.*, {now} AS cur FROM rows, c{s - 1})",
            scored(f"try{s}", f"SELECT model, wt, iter, fold, row_id, y, wt / 100.0::DOUBLE * cur + (1 - wt / 100.0::DOUBLE) * q AS p FROM ({models.format(s=s)}), range(101) w(wt)"),
            f"top{s} AS (SELECT model, arg_max(wt, (round(score, 9), -wt)) AS wt, arg_max(score, (round(score, 9), -wt)) AS score FROM try{s} GROUP BY model)",
            f"""best{s} AS MATERIALIZED (SELECT {s} AS step, t.model, t.wt / 100.0::DOUBLE AS weight, t.score FROM top{s} t, best{s - 1} b
            WHERE t.score - b.score >= 0.000001::DOUBLE ORDER BY t.score DESC, t.model LIMIT 1)""",
            f"c{s} AS MATERIALIZED (SELECT " + ", ".join(f"c{n} * weight + CASE WHEN model = '{m}' THEN 1 - weight ELSE 0 END AS c{n}" for n, m in enumerate(GREEDY_MODELS)) + f" FROM c{s - 1}, best{s})",
        ]
    picks = " UNION ALL ".join(f"SELECT * FROM best{s}" for s in range(GINI_STEPS + 1))
    return f"WITH {', '.join(parts)} SELECT CAST(step AS BIGINT) AS step, model, weight, round(score, 6) AS score FROM ({picks})"


@query("greedy_by_gini", _gini_sql())
def greedy_by_gini(spark, folder):
    """Selection under a metric that is no mean of squares: bounds leave few of all models and weights to be ranked."""
    wide = materialise(noisy_library(spark, folder).select("iter", "fold", "row_id", "y", *GREEDY_MODELS), "wide")
    return tidy(E.recipe_table(spark, E.greedy_by_scoring(wide, GREEDY_MODELS, "gini")))
