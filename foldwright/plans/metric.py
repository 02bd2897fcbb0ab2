"""Queries: folds, holdouts, metrics, and what is read off a scored model library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.metrics import METRICS, rmspe, rmspe_of_logs
from foldwright.functions.scalar import model_key, model_key_feat, model_key_model, model_key_trial
from foldwright.operators import folds as FO
from foldwright.operators import library as L
from foldwright.operators import ordered_metrics as O
from foldwright.operators.ranking import ranked_by_value
from foldwright.plans import sql as Q
from foldwright.plans.common import folded_sales, library, predictions, tidy
from foldwright.plans.registry import query
from foldwright.session import scratch_path
from foldwright.sources import files, tables

IF = "CAST(iter AS BIGINT) AS iter, CAST(fold AS BIGINT) AS fold"


@query("stratified_folds", f"WITH {Q.SALES}, {Q.stratified('sales')} SELECT row_id, stratum, {IF} FROM folded")
def stratified_folds(spark, folder):
    return tidy(folded_sales(spark, folder).select("row_id", "stratum", "iter", "fold"))


BINS = 30


@query(
    "stratified_folds_continuous",
    f"""WITH {Q.SALES}, ranked AS (SELECT row_id, y, row_number() OVER (ORDER BY y, row_id) AS r, count(*) OVER () AS n FROM sales),
    binned AS (SELECT row_id, y, ((r - 1) * {BINS}) // n AS stratum FROM ranked), {Q.stratified('binned')}
    SELECT row_id, CAST(stratum AS BIGINT) AS stratum, {IF} FROM folded""",
)
def stratified_folds_continuous(spark, folder):
    """Folds stratified on the target itself, cut into equal-count bins first."""
    binned = FO.value_strata(tables.sales(spark, folder).select("row_id", "y"), "y", BINS)
    return tidy(FO.stratified_folds(binned, "stratum", Q.K, Q.ITERS).select("row_id", "stratum", "iter", "fold"))


BLOCK_K = 7
BLOCKS = f"""{Q.SALES}, dealt AS (
  SELECT s.*, iter, row_number() OVER (PARTITION BY iter ORDER BY md5(concat_ws('|', seed, row_id)), row_id) AS r, count(*) OVER (PARTITION BY iter) AS n
  FROM sales s, {Q.seeds(Q.ITERS)}),
blocks AS (SELECT *, CASE WHEN (r - 1) // (n // {BLOCK_K}) < {BLOCK_K} THEN (r - 1) // (n // {BLOCK_K}) ELSE -1 END AS fold FROM dealt)"""


@query("block_folds", f"WITH {BLOCKS} SELECT row_id, {IF} FROM blocks")
def block_folds(spark, folder):
    return tidy(FO.block_folds(tables.sales(spark, folder), BLOCK_K, Q.ITERS).select("row_id", "iter", "fold"))


@query(
    "concat_blocks",
    f"""WITH {BLOCKS} SELECT CAST(b.iter AS BIGINT) AS iter, CAST(v.fold AS BIGINT) AS fold, count(*) AS n_train, round(sum(y) / 1000000, 4) AS y_train
    FROM blocks b JOIN (SELECT unnest(range({BLOCK_K})) AS fold) v ON b.fold <> v.fold GROUP BY 1, 2""",
)
def concat_blocks(spark, folder):
    """All blocks but one, with the never-validated remainder, as training rows of each fold."""
    spread = FO.membership(FO.block_folds(tables.sales(spark, folder), BLOCK_K, Q.ITERS), BLOCK_K)
    train = spread.filter(F.col("part") == "train")
    return tidy(train.groupBy("iter", "fold").agg(F.count(F.lit(1)).alias("n_train"), (F.sum("y") / 1e6).alias("y_train")), 4)


@query(
    "feature_matrix_scan",
    f"""WITH {Q.SALES}, {Q.stratified('sales')}, parts AS (SELECT DISTINCT iter AS i, fold AS f FROM folded)
    SELECT CAST(i AS BIGINT) AS iter, CAST(f AS BIGINT) AS fold, CASE WHEN fold = f THEN 'valid' ELSE 'train' END AS part, count(*) AS n, CAST(sum(CAST(round(y * 100) AS BIGINT)) AS BIGINT) AS y_cents, CAST(sum(CAST(round(x * 100) AS BIGINT)) AS BIGINT) AS x_cents
    FROM folded JOIN parts ON iter = i GROUP BY 1, 2, 3""",
)
def feature_matrix_scan(spark, folder):
    spread = FO.membership(folded_sales(spark, folder), Q.K)
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint")).alias(f"{c}_cents")
    return tidy(spread.groupBy("iter", "fold", "part").agg(F.count(F.lit(1)).alias("n"), cents("y"), cents("x")))


@query(
    "fold_membership",
    f"""WITH {Q.SALES}, {Q.stratified('sales', iters=1)}, parts AS (SELECT DISTINCT fold AS f FROM folded)
    SELECT row_id, CAST(f AS BIGINT) AS fold, CASE WHEN fold = f THEN 'valid' ELSE 'train' END AS part FROM folded, parts""",
)
def fold_membership(spark, folder):
    rows = folded_sales(spark, folder, 1)
    pieces = []
    for f in range(Q.K):
        for part, pick in (("valid", FO.in_validation), ("train", FO.in_training)):
            pieces.append(pick(rows, f).select("row_id", F.lit(f).alias("fold"), F.lit(part).alias("part")))
    return tidy(reduce(DataFrame.unionByName, pieces))


FRACTION = 0.07843291


@query(
    "head_fraction_split",
    f"""WITH {Q.SALES}, r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS r, count(*) OVER () AS n FROM sales)
    SELECT row_id, CAST(r <= CAST(floor({FRACTION}::DOUBLE * n) AS BIGINT) + 1 AS BIGINT) AS is_valid FROM r""",
)
def head_fraction_split(spark, folder):
    return tidy(FO.head_fraction(tables.sales(spark, folder).select("row_id"), "row_id", FRACTION))


HOLDOUT = 1000


@query(
    "tail_holdout",
    f"""WITH {Q.SALES}, r AS (SELECT row_id, y, row_number() OVER (ORDER BY row_id DESC) AS r FROM sales)
    SELECT row_id, y, CAST(r <= {HOLDOUT} AS BIGINT) AS is_valid FROM r""",
)
def tail_holdout(spark, folder):
    return tidy(FO.tail_holdout(tables.sales(spark, folder).select("row_id", "y"), "row_id", HOLDOUT))


@query("last_row", f"WITH {Q.TRAIN} SELECT row_id, date_text FROM train ORDER BY date_text DESC, row_id DESC LIMIT 1")
def last_row(spark, folder):
    rows = tables.train(spark, folder).select("row_id", "date_text")
    return rows.orderBy(F.col("date_text").desc(), F.col("row_id").desc()).limit(1)


@query("rmspe_by_fold", f"WITH {Q.SCORES} SELECT model, {IF}, round(score, 6) AS score FROM scores")
def rmspe_by_fold(spark, folder):
    return tidy(L.score(predictions(spark, folder), "rmspe").drop("metric"))


@query(
    "rmspe_weighted_by_prediction",
    f"WITH {Q.LIBRARY} SELECT model, {IF}, round(sqrt(avg(CASE WHEN pred <> 0 THEN pow((y - pred) / pred, 2) ELSE 0 END)), 6) AS score FROM preds GROUP BY model, iter, fold",
)
def rmspe_weighted_by_prediction(spark, folder):
    """The variant whose weights come from the prediction."""
    agg = rmspe(F.col("pred"), F.col("y"), weight_by="pred").alias("score")
    return tidy(predictions(spark, folder).groupBy("model", "iter", "fold").agg(agg))


@query(
    "rmspe_log_space",
    f"""WITH {Q.LIBRARY}, logs AS (SELECT model, iter, fold, exp(ln(y + 1)) - 1 AS y, exp(ln(pred + 1)) - 1 AS pred FROM preds)
    SELECT model, {IF}, round({Q.RMSPE}, 6) AS score FROM logs GROUP BY model, iter, fold""",
)
def rmspe_log_space(spark, folder):
    logs = predictions(spark, folder).select("model", "iter", "fold", F.log1p("y").alias("y"), F.log1p("pred").alias("pred"))
    return tidy(logs.groupBy("model", "iter", "fold").agg(rmspe_of_logs(F.col("pred"), F.col("y")).alias("score")))


@query(
    "gini_by_fold",
    f"""WITH {Q.LIBRARY}, ranked AS (SELECT model, iter, fold, y, row_number() OVER (PARTITION BY model, iter, fold ORDER BY pred DESC, row_id) AS rp,
      row_number() OVER (PARTITION BY model, iter, fold ORDER BY y DESC, row_id) AS rt, count(*) OVER (PARTITION BY model, iter, fold) AS n FROM preds)
    SELECT model, {IF}, round((max(n) / 2.0::DOUBLE - sum(y * (n - rp + 1)) / sum(y)) / (max(n) / 2.0::DOUBLE - sum(y * (n - rt + 1)) / sum(y)), 6) + 0.0 AS gini
    FROM ranked GROUP BY model, iter, fold""",
)
def gini_by_fold(spark, folder):
    wide = library(spark, folder)
    scored = L.to_long(wide, Q.MODELS)
    labels = wide.select("iter", "fold", "row_id", "y")
    return tidy(O.normalised_gini(scored, labels=labels, label_groups=["iter", "fold"]))


@query(
    "lorenz_curve",
    f"""WITH {Q.LIBRARY}, w AS (SELECT model, iter, fold, row_id, y, row_number() OVER p AS rank, sum(y) OVER (PARTITION BY model, iter, fold ORDER BY pred DESC, row_id ROWS UNBOUNDED PRECEDING) AS cum,
      sum(y) OVER (PARTITION BY model, iter, fold) AS total, count(*) OVER (PARTITION BY model, iter, fold) AS n FROM preds
      WINDOW p AS (PARTITION BY model, iter, fold ORDER BY pred DESC, row_id))
    SELECT model, {IF}, row_id, rank, round(cum / total, 6) AS lorenz, round((rank - 1) / CAST(n - 1 AS DOUBLE), 6) AS even FROM w""",
)
def lorenz_curve(spark, folder):
    scored = predictions(spark, folder)
    curve = O.lorenz_curve(scored, "pred", "y", ["model", "iter", "fold"])
    return tidy(curve.select("model", "iter", "fold", "row_id", "rank", "lorenz", "even"))


# Binary targets: labelled documents, a length score and the out-of-fold rate of the source.
BINARY = Q.LABELLED + "," + Q.stratified("labelled", iters=1) + f""",
rates AS {Q.leave_out("folded", "avg(y) AS rate", "source")},
alls AS {Q.leave_out("folded", "avg(y) AS rate")},
scored AS (
  SELECT 'length' AS model, iter, fold, row_id, y, length_score AS pred FROM folded
  UNION ALL SELECT 'source', f.iter, f.fold, row_id, y, coalesce(r.rate, a.rate) FROM folded f JOIN alls a ON f.iter = a.iter AND f.fold = a.fold
  LEFT JOIN rates r ON f.iter = r.iter AND f.fold = r.fold AND f.source = r.source)"""


def binary_scores(spark, folder):
    from foldwright.operators.baselines import fold_group_mean

    rows = FO.store_folds(FO.stratified_folds(tables.labelled_docs(spark, folder), "stratum", Q.K, 1))
    wide = fold_group_mean(rows, "y", "source", "source_rate").withColumnsRenamed({"length_score": "length"}).drop("source")
    return L.to_long(wide.withColumnRenamed("source_rate", "source"), ["length", "source"])


@query(
    "auc_by_fold",
    f"""WITH {BINARY}, r AS (SELECT model, iter, fold, y, rank() OVER w + (count(*) OVER (PARTITION BY model, iter, fold, pred) - 1) / 2.0::DOUBLE AS rk FROM scored WINDOW w AS (PARTITION BY model, iter, fold ORDER BY pred))
    SELECT model, {IF}, round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r GROUP BY model, iter, fold""",
)
def auc_by_fold(spark, folder):
    # tied rates are equal numbers only up to the order of additions
    scores = binary_scores(spark, folder).withColumn("pred", F.round("pred", 9))
    return tidy(O.roc_auc(scores))


@query(
    "logloss_by_fold",
    f"""WITH {BINARY}, c AS (SELECT model, iter, fold, y, least(greatest(pred, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS p FROM scored)
    SELECT model, {IF}, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS score FROM c GROUP BY model, iter, fold""",
)
def logloss_by_fold(spark, folder):
    return tidy(L.score(binary_scores(spark, folder), "logloss").drop("metric"))


@query(
    "metric_dispatch",
    f"""WITH {Q.LIBRARY}, m AS (
    SELECT model, iter, fold, 'rmspe' AS metric, {Q.RMSPE} AS score, 0 AS higher_is_better FROM preds GROUP BY ALL
    UNION ALL SELECT model, iter, fold, 'rmse', sqrt(avg((y - pred) * (y - pred))), 0 FROM preds GROUP BY ALL)
    SELECT model, {IF}, metric, round(score, 4) AS score, CAST(higher_is_better AS BIGINT) AS higher_is_better FROM m""",
)
def metric_dispatch(spark, folder):
    scored = predictions(spark, folder)
    pieces = [
        L.score(scored, m).withColumn("higher_is_better", F.lit(int(METRICS[m].higher_is_better))) for m in ("rmspe", "rmse")
    ]
    return tidy(reduce(DataFrame.unionByName, pieces), 4)


@query(
    "metric_direction",
    f"""WITH {BINARY}, s AS (SELECT model, iter, fold, row_id, y, round(pred, 9) AS pred, least(greatest(pred, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS p FROM scored),
    r AS (SELECT *, rank() OVER (PARTITION BY model, iter, fold ORDER BY pred) + (count(*) OVER (PARTITION BY model, iter, fold, pred) - 1) / 2.0::DOUBLE AS rk,
      row_number() OVER (PARTITION BY model, iter, fold ORDER BY pred DESC, row_id) AS rp, row_number() OVER (PARTITION BY model, iter, fold ORDER BY y DESC, row_id) AS rt,
      count(*) OVER (PARTITION BY model, iter, fold) AS n FROM s),
    m AS (SELECT 'auc' AS metric, 1 AS higher_is_better, model, iter, fold, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS score FROM r GROUP BY ALL
      UNION ALL SELECT 'logloss', 0, model, iter, fold, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) FROM s GROUP BY ALL
      UNION ALL SELECT 'gini', 1, model, iter, fold, (max(n) / 2.0::DOUBLE - sum(y * (n - rp + 1)) / sum(y)) / (max(n) / 2.0::DOUBLE - sum(y * (n - rt + 1)) / sum(y)) FROM r GROUP BY ALL),
    c AS (SELECT metric, higher_is_better, model, avg(score) AS cv_mean FROM m GROUP BY ALL)
    SELECT metric, CAST(higher_is_better AS BIGINT) AS higher_is_better, model, round(cv_mean, 6) AS cv_mean,
      row_number() OVER (PARTITION BY metric ORDER BY CASE higher_is_better WHEN 1 THEN -cv_mean ELSE cv_mean END, model) AS model_rank FROM c""",
)
def metric_direction(spark, folder):
    """Models ranked by every metric of a binary target, each in its own direction."""
    exact = binary_scores(spark, folder)
    rounded = exact.withColumn("pred", F.round("pred", 9))
    pieces = []
    for name, scored in (("auc", rounded), ("logloss", exact), ("gini", rounded)):
        ranked = L.ranking(L.cv_summary(L.score(scored, name)), name)
        pieces.append(ranked.withColumn("higher_is_better", F.lit(int(METRICS[name].higher_is_better))))
    return tidy(reduce(DataFrame.unionByName, pieces).select("metric", "higher_is_better", "model", "cv_mean", "model_rank"))


@query("cv_mean_std", f"WITH {Q.SCORES} SELECT model, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, n_folds FROM summary")
def cv_mean_std(spark, folder):
    return tidy(L.cv_summary(L.score(predictions(spark, folder), "rmspe")).drop("metric"))


@query("model_ranking", f"WITH {Q.SCORES} SELECT model, model_rank, round(cv_mean, 6) AS cv_mean FROM ranking")
def model_ranking(spark, folder):
    summary = L.cv_summary(L.score(predictions(spark, folder), "rmspe"))
    return tidy(L.ranking(summary, "rmspe").select("model", "model_rank", "cv_mean"))


@query("best_model", f"WITH {Q.SCORES} SELECT model, round(cv_mean, 6) AS cv_mean FROM ranking WHERE model_rank = 1")
def best_model(spark, folder):
    """The seed of an ensemble."""
    summary = L.cv_summary(L.score(predictions(spark, folder), "rmspe"))
    return tidy(summary.orderBy(L.best_first("rmspe"), "model").limit(1).select("model", "cv_mean"))


@query("score_threshold", f"WITH {Q.SCORES} SELECT model, round(cv_mean, 6) AS cv_mean FROM summary WHERE cv_mean < (SELECT avg(cv_mean) FROM summary)")
def score_threshold(spark, folder):
    """Models better than the average of the library."""
    summary = L.cv_summary(L.score(predictions(spark, folder), "rmspe"))
    threshold = summary.agg(F.avg("cv_mean")).first()[0]  # one number
    return tidy(L.passing(summary, "rmspe", threshold).select("model", "cv_mean"))


PARTIAL = Q.LIBRARY + ", done AS (SELECT * FROM preds WHERE NOT (model IN ('ols', 'ridge') AND iter = 1 AND fold = 2))"


def _partial(spark, folder):
    """A prediction table in which two models lack their last fold, as written by an unfinished run."""
    last = F.col("model").isin("ols", "ridge") & (F.col("iter") == 1) & (F.col("fold") == 2)
    path = scratch_path(spark, "predictions")
    files.append_predictions(predictions(spark, folder).filter(~last), path)
    return files.read_predictions(spark, path)


@query(
    "library_complete",
    f"""WITH {PARTIAL}, parts AS (SELECT DISTINCT model, iter, fold FROM done)
    SELECT model, count(*) AS n_parts, CAST(count(*) = {Q.K * Q.ITERS} AS BIGINT) AS complete FROM parts GROUP BY model""",
)
def library_complete(spark, folder):
    return tidy(L.completeness(_partial(spark, folder), Q.K, Q.ITERS))


@query(
    "model_library",
    f"""WITH {PARTIAL}, parts AS (SELECT DISTINCT model, iter, fold FROM done)
    SELECT 'stand' AS feat, model, 'stand_' || model AS key FROM parts GROUP BY model HAVING count(*) = {Q.K * Q.ITERS}""",
)
def model_library(spark, folder):
    """Complete models with their keys."""
    complete = L.completeness(_partial(spark, folder), Q.K, Q.ITERS).filter("complete = 1")
    return complete.select(F.lit("stand").alias("feat"), "model", F.concat_ws("_", F.lit("stand"), "model").alias("key"))


@query(
    "library_listing",
    f"""WITH {Q.LIBRARY}, v(feat, trial) AS (VALUES ('stand', NULL), ('raw', 1), ('raw', 2)),
    parts AS (SELECT DISTINCT feat, model, trial, iter, fold FROM preds, v WHERE NOT (coalesce(trial, 0) = 2 AND model IN ('ols', 'ridge') AND iter = 1 AND fold = 2))
    SELECT feat, model, CAST(trial AS BIGINT) AS trial, feat || '_' || model || coalesce('@' || trial, '') AS key FROM parts GROUP BY feat, model, trial HAVING count(*) = {Q.K * Q.ITERS}""",
)
def library_listing(spark, folder):
    """Two feature sets, one with two trials of every model, the second of which is unfinished for two models."""
    member = [F.struct(F.lit(f).alias("feat"), F.lit(t).cast("int").alias("trial")) for f, t in (("stand", None), ("raw", 1), ("raw", 2))]
    rows = predictions(spark, folder).withColumn("_m", F.explode(F.array(*member)))
    unfinished = F.col("trial").eqNullSafe(2) & F.col("model").isin("ols", "ridge") & (F.col("iter") == 1) & (F.col("fold") == 2)
    keyed = rows.select("_m.*", "model", "iter", "fold", "row_id", "pred").filter(~unfinished)
    path = scratch_path(spark, "predictions")
    files.append_predictions(keyed.withColumn("model", model_key(F.col("feat"), F.col("model"), F.col("trial"))), path)
    key = F.col("model")
    # keys are taken apart once per part, not once per prediction; a plain distinct would be merged with the listing's own
    index = files.read_predictions(spark, path).groupBy("model", "iter", "fold").count().filter("count > 0").select(
        model_key_feat(key).alias("feat"), model_key_model(key).alias("model"), model_key_trial(key).alias("trial"), "iter", "fold"
    )
    return tidy(L.library_listing(index, Q.K, Q.ITERS))


@query(
    "missing_work",
    f"""WITH {PARTIAL}, wanted AS (SELECT DISTINCT model, iter, fold FROM preds), have AS (SELECT DISTINCT model, iter, fold FROM done WHERE model <> 'mean')
    SELECT model, {IF} FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.model = w.model AND h.iter = w.iter AND h.fold = w.fold)""",
)
def missing_work(spark, folder):
    """What is left to train; the fold mean is asked for again."""
    wanted = predictions(spark, folder).select("model", "iter", "fold").distinct()
    return tidy(L.missing_work(wanted, _partial(spark, folder), forced=["mean"]))


@query(
    "fold_sizes",
    f"WITH {Q.SALES}, {Q.stratified('sales')}, n AS (SELECT iter, fold, count(*) AS n_valid FROM folded GROUP BY ALL) SELECT {IF}, n_valid, max(n_valid) OVER () AS max_valid FROM n",
)
def fold_sizes(spark, folder):
    return tidy(L.fold_sizes(folded_sales(spark, folder)))


CORRELATED = ["log_mean", "by_kind", "by_stratum", "ols", "ridge"]


@query(
    "model_correlation",
    f"WITH {Q.LIBRARY} " + " UNION ALL ".join(f"SELECT '{m}' AS model, round(corr(ols, {m}), 6) + 0.0 AS corr FROM wide" for m in CORRELATED),
)
def model_correlation(spark, folder):
    return tidy(L.correlation_with(library(spark, folder), "ols", CORRELATED))


@query(
    "model_report",
    f"""WITH {Q.SCORES}, best AS (SELECT model FROM ranking WHERE model_rank = 1),
    side AS (SELECT p.model, p.pred, b.pred AS best_pred FROM preds p JOIN preds b ON p.iter = b.iter AND p.fold = b.fold AND p.row_id = b.row_id JOIN best ON b.model = best.model),
    c AS (SELECT model, round(corr(best_pred, pred), 6) + 0.0 AS corr FROM side GROUP BY model)
    SELECT r.model, c.corr, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, n_folds, model_rank, CAST(model_rank = 1 AS BIGINT) AS is_best FROM ranking r JOIN c USING (model)""",
)
def model_report(spark, folder):
    wide = library(spark, folder)
    return tidy(L.model_report(wide, Q.MODELS, "rmspe").drop("metric"))


@query(
    "class_ratio",
    """SELECT count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1, round(count(*) FILTER (toxic = 0) / CAST(count(*) FILTER (toxic = 1) AS DOUBLE), 6) AS ratio
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def class_ratio(spark, folder):
    return tidy(L.class_ratio(tables.docs(spark, folder).filter(F.col("toxic").isNotNull()), "toxic"))


@query(
    "rank_normalise",
    f"""WITH {Q.LIBRARY} SELECT model, {IF}, row_id, round(row_number() OVER (PARTITION BY model, iter, fold ORDER BY pred, row_id) / CAST(count(*) OVER (PARTITION BY model, iter, fold) AS DOUBLE), 6) AS rank_pred
    FROM preds""",
)
def rank_normalise(spark, folder):
    from foldwright.operators.ensemble import rank_normalise as normalise

    ranked = normalise(predictions(spark, folder))
    return tidy(ranked.select("model", "iter", "fold", "row_id", "rank_pred"))


@query(
    "label_encode",
    """WITH v AS (SELECT DISTINCT source FROM documents), p AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM v)
    SELECT doc_id, d.source, code FROM documents d JOIN p ON d.source = p.source""",
)
def label_encode(spark, folder):
    from foldwright.operators.features import label_encode as encode

    rows = tables.table(spark, folder, "documents").select("doc_id", "source")
    return tidy(encode(rows, "source", "code"))


LANGS = ["de", "en", "es", "fr"]


@query("one_hot", "SELECT doc_id, " + ", ".join(f"CAST(lang = '{v}' AS BIGINT) AS lang_{v}" for v in LANGS) + " FROM documents")
def one_hot(spark, folder):
    from foldwright.operators.features import one_hot as encode

    rows = tables.table(spark, folder, "documents").select("doc_id", "lang")
    return tidy(encode(rows, "lang", LANGS, "lang_").drop("lang"))


@query(
    "order_rank",
    f"WITH {Q.SALES} SELECT row_id, kind, row_number() OVER (PARTITION BY kind ORDER BY stratum_code, row_id) AS rank FROM (SELECT *, CAST(substr(stratum, 1, 1) AS DOUBLE) AS stratum_code FROM sales)",
)
def order_rank(spark, folder):
    """Ranks over heavily tied values: five values over all rows."""
    rows = tables.sales(spark, folder).withColumn("code", F.substring("stratum", 1, 1).cast("double"))
    return tidy(ranked_by_value(rows, "code", True, "row_id", ["kind"]).select("row_id", "kind", "rank"))
