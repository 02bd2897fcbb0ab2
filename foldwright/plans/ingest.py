"""Queries: scans, sinks, cleaning, derived columns and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions import scalar as S
from foldwright.operators import features as X
from foldwright.operators import folds as FO
from foldwright.operators import heavy as H
from foldwright.operators import library as L
from foldwright.operators.ranking import ranked_by_value
from foldwright.plans import sql as Q
from foldwright.plans.common import folded_sales, library, predictions, tidy
from foldwright.plans.registry import query
from foldwright.session import scratch_path
from foldwright.sources import files, tables

MERGED_COLUMNS = [
    "row_id", "store", "date_text", "day_of_week", "sales", "open", "promo", "school_holiday", "state_holiday", "stratum",
    "store_type", "assortment", "competition_distance", "competition_month", "competition_year", "promo2", "promo2_week", "promo2_year",
]


def merged(spark, folder) -> DataFrame:
    return X.join_store(tables.train(spark, folder), tables.store(spark, folder)).select(*MERGED_COLUMNS)


def _wide_int(columns: str) -> str:
    """SQL select list with the flag columns as BIGINT."""
    flags = {"open", "promo", "school_holiday", "promo2", "day_of_week"}
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in flags else c for c in columns.split())


TRAIN_COLUMNS = "row_id store date_text day_of_week sales open promo school_holiday state_holiday stratum"


@query("csv_scan", f"WITH {Q.TRAIN} SELECT {_wide_int(TRAIN_COLUMNS)} FROM train")
def csv_scan(spark, folder):
    path = scratch_path(spark, "train-csv")
    files.write_csv(tables.train(spark, folder), path)
    return tidy(files.read_csv(spark, path, files.TRAIN_SCHEMA))


@query("merged_tables", f"WITH {Q.MERGED} SELECT {_wide_int(' '.join(MERGED_COLUMNS))} FROM merged")
def merged_tables(spark, folder):
    frame = merged(spark, folder)
    path = scratch_path(spark, "merged-csv")
    files.write_csv(frame.select(F.col("row_id").alias("_index"), "*"), path)
    return tidy(files.read_csv(spark, path, frame.schema, index_column=True))


@query(
    "store_join",
    f"WITH {Q.MERGED} SELECT row_id, store, sales, store_type, assortment, competition_distance, CAST(promo2 AS BIGINT) AS promo2 FROM merged",
)
def store_join(spark, folder):
    return tidy(merged(spark, folder).select("row_id", "store", "sales", "store_type", "assortment", "competition_distance", "promo2"))


@query(
    "test_store_join",
    f"WITH {Q.MERGED} SELECT row_id AS id, store, date_text, store_type, assortment, competition_distance, CAST(open AS BIGINT) AS open FROM merged",
)
def test_store_join(spark, folder):
    joined = X.join_store(tables.test(spark, folder), tables.store(spark, folder))
    return tidy(joined.select("id", "store", "date_text", "store_type", "assortment", "competition_distance", "open"))


@query(
    "open_filter",
    f"WITH {Q.TRAIN} SELECT row_id, sales, CAST(open AS BIGINT) AS open FROM train WHERE open IS DISTINCT FROM 0 AND sales IS DISTINCT FROM 0",
)
def open_filter(spark, folder):
    return tidy(X.drop_closed(tables.train(spark, folder)).select("row_id", "sales", "open"))


@query(
    "null_defaults",
    f"""WITH {Q.MERGED} SELECT row_id, CAST(coalesce(open, 1) AS BIGINT) AS open, coalesce(store_type, '0') AS store_type,
    coalesce(competition_distance, 0) AS competition_distance, coalesce(competition_month, 0) AS competition_month,
    coalesce(promo2_week, 0) AS promo2_week FROM merged""",
)
def null_defaults(spark, folder):
    filled = X.fill_nulls(X.default_open(merged(spark, folder)))
    return tidy(filled.select("row_id", "open", "store_type", "competition_distance", "competition_month", "promo2_week"))


@query(
    "sentinel_fill",
    """SELECT d.doc_id AS row_id, lang, CAST(coalesce(quality, -1) AS BIGINT) AS quality, CAST(coalesce(toxic, -1) AS BIGINT) AS toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def sentinel_fill(spark, folder):
    return tidy(X.fill_sentinel(tables.docs(spark, folder)).select("row_id", "lang", "quality", "toxic"))


@query(
    "date_parts",
    f"""WITH {Q.TRAIN} SELECT row_id, CAST(year(CAST(date_text AS DATE)) AS DOUBLE) AS year, CAST(month(CAST(date_text AS DATE)) AS DOUBLE) AS month,
    CAST(day(CAST(date_text AS DATE)) AS DOUBLE) AS day FROM train""",
)
def date_parts(spark, folder):
    text = F.col("date_text")
    parts = [S.date_part_from_text(text, p).alias(p) for p in ("year", "month", "day")]
    return tables.train(spark, folder).select("row_id", *parts)


@query(
    "ordinal_codes",
    f"""WITH {Q.MERGED} SELECT row_id,
    CASE store_type WHEN 'a' THEN 1.0::DOUBLE WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'd' THEN 4 ELSE 0 END AS store_type,
    CASE assortment WHEN 'a' THEN 1.0::DOUBLE WHEN 'b' THEN 2 WHEN 'c' THEN 3 END AS assortment,
    CASE state_holiday WHEN 'a' THEN 1.0::DOUBLE WHEN 'b' THEN 2 WHEN 'c' THEN 3 ELSE 0 END AS state_holiday FROM merged""",
)
def ordinal_codes(spark, folder):
    built = X.build_features(merged(spark, folder), state_holiday=True)
    return built.select("row_id", "store_type", "assortment", "state_holiday")


FEATURE_SQL = """SELECT row_id, store, coalesce(competition_distance, 0) AS competition_distance, coalesce(competition_month, 0) AS competition_month,
    coalesce(competition_year, 0) AS competition_year, CAST(promo AS DOUBLE) AS promo, CAST(promo2 AS DOUBLE) AS promo2, coalesce(promo2_week, 0) AS promo2_week,
    coalesce(promo2_year, 0) AS promo2_year, CAST(school_holiday AS DOUBLE) AS school_holiday, CAST(day_of_week AS DOUBLE) AS day_of_week,
    CAST(split_part(date_text, '-', 2) AS DOUBLE) AS month, CAST(split_part(date_text, '-', 3) AS DOUBLE) AS day, CAST(split_part(date_text, '-', 1) AS DOUBLE) AS year,
    CASE store_type WHEN 'a' THEN 1.0::DOUBLE WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'd' THEN 4 ELSE 0 END AS store_type,
    CASE assortment WHEN 'a' THEN 1.0::DOUBLE WHEN 'b' THEN 2 WHEN 'c' THEN 3 END AS assortment"""


@query("feature_frame", f"WITH {Q.MERGED} {FEATURE_SQL}, sales FROM merged")
def feature_frame(spark, folder):
    return X.features_only(X.build_features(merged(spark, folder)), "row_id", "sales")


@query(
    "feature_sink",
    f"""WITH {Q.MERGED}, f AS ({FEATURE_SQL}, sales FROM merged)
    SELECT * EXCLUDE (sales), sales AS y, 'train' AS split, 'stand' AS feature_set FROM f
    UNION ALL SELECT * EXCLUDE (sales), 0.0 AS y, 'test' AS split, 'stand' AS feature_set FROM f""",
)
def feature_sink(spark, folder):
    """Train features with their target and test features with target 0, in one partitioned table."""
    stores = tables.store(spark, folder)
    train = X.features_only(X.build_features(merged(spark, folder)), "row_id", F.col("sales").alias("y"))
    test = X.join_store(tables.test(spark, folder), stores).withColumnRenamed("id", "row_id")
    test = X.features_only(X.build_features(test), "row_id", F.lit(0.0).alias("y"))
    path = scratch_path(spark, "feature-table")
    files.write_features(train.withColumn("split", F.lit("train")), path, "stand")
    files.write_features(test.withColumn("split", F.lit("test")), path, "stand")
    schema = T.StructType([*train.schema.fields, T.StructField("split", T.StringType()), T.StructField("feature_set", T.StringType())])
    return spark.read.schema(schema).parquet(path)


@query("log1p_target", f"WITH {Q.SALES} SELECT row_id, round(ln(y + 1), 6) AS log_y, round(exp(ln(y + 1)) - 1, 4) AS back FROM sales")
def log1p_target(spark, folder):
    frame = tables.sales(spark, folder).withColumn("log_y", S.log_target(F.col("y")))
    return frame.select("row_id", F.round("log_y", 6).alias("log_y"), F.round(S.unlog_target(F.col("log_y")), 4).alias("back"))


SHIFT = 250_000.0


def shifted(spark, folder) -> DataFrame:
    """Predictions moved down so that some are negative."""
    return predictions(spark, folder).withColumn("pred", F.col("pred") - F.lit(SHIFT))


SHIFTED = Q.LIBRARY + f", shifted AS (SELECT model, iter, fold, row_id, pred - {SHIFT}::DOUBLE AS pred FROM preds)"
BOUNDS = SHIFTED + ", bounds AS (SELECT model, min(pred) AS lo, max(pred) AS hi FROM shifted GROUP BY model)"


@query("clip_negative", f"WITH {SHIFTED} SELECT model, CAST(iter AS BIGINT) AS iter, row_id, round(greatest(pred, 0), 3) + 0.0 AS pred FROM shifted")
def clip_negative(spark, folder):
    clipped = shifted(spark, folder).withColumn("pred", S.clip_negative(F.col("pred")))
    return tidy(clipped.select("model", "iter", "row_id", "pred"), 3)


@query("negative_predictions", f"WITH {SHIFTED} SELECT model, CAST(iter AS BIGINT) AS iter, row_id, round(pred, 3) AS pred FROM shifted WHERE pred < 0")
def negative_predictions(spark, folder):
    return tidy(shifted(spark, folder).filter(F.col("pred") < 0).select("model", "iter", "row_id", "pred"), 3)


@query(
    "minmax_if_negative",
    f"""WITH {BOUNDS} SELECT s.model, CAST(iter AS BIGINT) AS iter, row_id, round(CASE WHEN lo < 0 THEN (pred - lo) / (hi - lo) ELSE pred END, 6) + 0.0 AS pred
    FROM shifted s JOIN bounds b ON s.model = b.model""",
)
def minmax_if_negative(spark, folder):
    return tidy(L.rescale(shifted(spark, folder), S.minmax_if_negative).select("model", "iter", "row_id", "pred"))


@query(
    "stretch_max",
    f"WITH {Q.LIBRARY} SELECT model, CAST(iter AS BIGINT) AS iter, row_id, round(pred / max(pred) OVER (PARTITION BY model), 6) AS pred FROM preds",
)
def stretch_max(spark, folder):
    stretched = L.rescale(predictions(spark, folder), lambda p, low, high: p / high)
    return tidy(stretched.select("model", "iter", "row_id", "pred"))


@query(
    "shift_scale",
    f"""WITH {BOUNDS} SELECT s.model, CAST(iter AS BIGINT) AS iter, row_id, round((pred - lo + abs(lo)) / (hi - lo + abs(lo)), 6) + 0.0 AS pred
    FROM shifted s JOIN bounds b ON s.model = b.model""",
)
def shift_scale(spark, folder):
    return tidy(L.rescale(shifted(spark, folder), S.shift_scale).select("model", "iter", "row_id", "pred"))


@query(
    "prediction_range",
    f"WITH {Q.LIBRARY} SELECT model, round(min(pred), 3) AS pred_min, round(max(pred), 3) AS pred_max FROM preds GROUP BY model",
)
def prediction_range(spark, folder):
    return tidy(L.prediction_range(predictions(spark, folder)), 3)


ITEM_COLUMNS = ", ".join(tables.ITEM_FEATURES)
LOGGED = Q.ITEMS + "," + Q.stratified("items", iters=1) + """,
logged AS (SELECT row_id, iter, fold, """ + ", ".join(f"ln(trunc({c}) + 1) AS {c}" for c in tables.ITEM_FEATURES) + """ FROM folded)"""


@query(
    "log_standardise",
    f"""WITH {LOGGED}, stats AS {Q.leave_out("logged", ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in tables.ITEM_FEATURES))}
    SELECT row_id, CAST(l.fold AS BIGINT) AS fold, {", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) + 0.0 AS {c}" for c in tables.ITEM_FEATURES)}
    FROM logged l JOIN stats s ON l.iter = s.iter AND l.fold = s.fold""",
)
def log_standardise(spark, folder):
    rows = FO.store_folds(FO.stratified_folds(tables.items(spark, folder), "stratum", Q.K, 1))
    scaled = X.standardise_by_fold(X.log_truncated(rows, tables.ITEM_FEATURES), tables.ITEM_FEATURES)
    return tidy(scaled.select("row_id", "fold", *tables.ITEM_FEATURES))


@query("label_shift", "SELECT vec_id AS row_id, CAST(label - 1 AS BIGINT) AS y FROM embeddings")
def label_shift(spark, folder):
    return tidy(tables.vectors(spark, folder).select("row_id", (F.col("label") - 1).alias("y")))


@query(
    "label_sign",
    """SELECT d.doc_id AS row_id, CAST(CASE WHEN toxic = 0 THEN -1 ELSE 1 END AS BIGINT) AS y
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL""",
)
def label_sign(spark, folder):
    rows = tables.docs(spark, folder).filter(F.col("toxic").isNotNull())
    return tidy(rows.select("row_id", S.sign_label(F.col("toxic")).alias("y")))


@query(
    "reversed_log_target",
    f"WITH {Q.SALES} SELECT row_id, row_number() OVER (ORDER BY row_id DESC) AS position, round(ln(y), 6) AS log_y FROM sales",
)
def reversed_log_target(spark, folder):
    ranked = ranked_by_value(tables.sales(spark, folder).select("row_id", "y"), "row_id", False, "row_id", rank="position")
    return tidy(ranked.select("row_id", "position", F.log("y").alias("log_y")))


@query(
    "logit_log1p",
    f"WITH {Q.LABELLED} SELECT row_id, round(ln(length_score / (1 - length_score)), 6) AS logit, round(ln(length_score + 1), 6) AS log1p FROM labelled",
)
def logit_log1p(spark, folder):
    score = F.col("length_score")
    rows = tables.labelled_docs(spark, folder)
    return tidy(rows.select("row_id", S.logit(score).alias("logit"), F.log1p(score).alias("log1p")))


@query(
    "failed_model_zeros",
    f"""WITH {Q.LIBRARY}, done AS (SELECT * FROM preds WHERE NOT (model = 'ols' AND fold = 1))
    SELECT m.model, CAST(f.iter AS BIGINT) AS iter, CAST(f.fold AS BIGINT) AS fold, f.row_id, round(coalesce(d.pred, 0), 3) AS pred, CAST(d.pred IS NULL AS BIGINT) AS failed
    FROM folded f CROSS JOIN (VALUES ('mean'), ('ols')) m(model)
    LEFT JOIN done d ON d.model = m.model AND d.iter = f.iter AND d.fold = f.fold AND d.row_id = f.row_id""",
)
def failed_model_zeros(spark, folder):
    """The one-feature model is taken to have failed on fold 1."""
    done = predictions(spark, folder).filter(~((F.col("model") == "ols") & (F.col("fold") == 1)))
    labels = folded_sales(spark, folder).select("iter", "fold", "row_id")
    filled = L.zeros_for_failed(labels, done.drop("y"), ["mean", "ols"])
    return tidy(filled.select("model", "iter", "fold", "row_id", "pred", "failed"), 3)


KEYED = """keyed AS (SELECT doc_id, lang AS feat, source AS model, CASE WHEN n_chars % 2 = 1 THEN n_chars % 7 END AS trial FROM documents),
built AS (SELECT doc_id, feat || '_' || model || coalesce('@' || CAST(trial AS VARCHAR), '') AS key FROM keyed)"""


def _keyed(spark, folder):
    chars = F.col("n_chars")
    trial = F.when(chars % 2 == 1, chars % 7)
    return tables.table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("feat"), F.col("source").alias("model"), trial.alias("trial")
    )


@query(
    "model_keys",
    f"""WITH {KEYED} SELECT doc_id, key, regexp_extract(key, '^([^_]+)_', 1) AS feat, regexp_extract(key, '^[^_]+_([^@]+)', 1) AS model,
    TRY_CAST(regexp_extract(key, '@([0-9]+)$', 1) AS BIGINT) AS trial FROM built""",
)
def model_keys(spark, folder):
    key = F.col("key")
    built = _keyed(spark, folder).select("doc_id", S.model_key(F.col("feat"), F.col("model"), F.col("trial")).alias("key"))
    return tidy(
        built.select(
            "doc_id", "key", S.model_key_feat(key).alias("feat"), S.model_key_model(key).alias("model"), S.model_key_trial(key).alias("trial")
        )
    )


@query(
    "model_key_rewrite",
    f"""WITH {KEYED} SELECT doc_id, CASE WHEN trial IS NULL THEN feat || '_' || model ELSE feat || '_' || model || '@' || CAST(trial AS VARCHAR) END AS key FROM keyed""",
)
def model_key_rewrite(spark, folder):
    base = F.concat_ws("_", "feat", "model")
    old = F.when(F.col("trial").isNull(), base).otherwise(F.concat(base, F.lit(".pred."), F.col("trial").cast("string")))
    return _keyed(spark, folder).select("doc_id", S.rewrite_model_key(old).alias("key"))


SPARSE = "CASE WHEN {c} <> 0 THEN printf(' {i}:%.6f', {c}) ELSE '' END"


@query(
    "sparse_text_rows",
    f"""WITH {Q.ITEMS} SELECT printf('%.6f', y) || {" || ".join(SPARSE.format(c=c, i=i) for i, c in enumerate(tables.ITEM_FEATURES))} AS value FROM items""",
)
def sparse_text_rows(spark, folder):
    rows = tables.items(spark, folder)
    path = scratch_path(spark, "sparse-text")
    files.write_lines(rows, files.sparse_lines(F.col("y"), F.array(*tables.ITEM_FEATURES)), path)
    return spark.read.text(path)


@query(
    "dense_text_rows",
    f"""WITH {Q.ITEMS}, stats AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in tables.ITEM_FEATURES)} FROM items)
    SELECT {" || ' ' || ".join(f"printf('%.6f', ({c} - m_{c}) / s_{c})" for c in tables.ITEM_FEATURES)} AS value FROM items, stats""",
)
def dense_text_rows(spark, folder):
    rows = tables.items(spark, folder)
    scaled = X.standardise(rows, rows, tables.ITEM_FEATURES)
    path = scratch_path(spark, "dense-text")
    files.write_lines(scaled, files.dense_lines(F.array(*tables.ITEM_FEATURES)), path)
    return spark.read.text(path)


@query(
    "label_text_rows",
    f"""WITH {Q.ITEMS} SELECT printf('%.6f', y) || ',' || {" || ' ' || ".join(f"printf('%.6f', {c})" for c in tables.ITEM_FEATURES)} AS value FROM items""",
)
def label_text_rows(spark, folder):
    rows = tables.items(spark, folder)
    path = scratch_path(spark, "label-text")
    files.write_lines(rows, files.labelled_lines(F.col("y"), F.array(*tables.ITEM_FEATURES)), path)
    return spark.read.text(path)


@query(
    "sign_text_rows",
    "SELECT CASE WHEN toxic = 0 THEN '-1' ELSE '+1' END AS value FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL",
)
def sign_text_rows(spark, folder):
    rows = tables.docs(spark, folder).filter(F.col("toxic").isNotNull())
    path = scratch_path(spark, "sign-text")
    files.write_lines(rows, files.sign_lines(F.col("toxic")), path)
    return spark.read.text(path)


DROP_COLUMNS = [c for c in MERGED_COLUMNS if c not in ("row_id", "sales")]
DROP_TEXT = {"state_holiday", "store_type", "date_text", "stratum", "assortment"}
MAX_SAME = 4000


def _drop_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), '-1') AS value, "
        + ("CAST(NULL AS DOUBLE)" if c in DROP_TEXT else f"coalesce(CAST({c} AS DOUBLE), -1)")
        + " AS number FROM merged"
        for c in DROP_COLUMNS
    )
    return f"""WITH {Q.MERGED}, cells AS ({cells}),
    counts AS (SELECT column_name, value, count(*) AS c FROM cells GROUP BY ALL),
    per_value AS (SELECT column_name, count(*) AS n_distinct, max(CAST(CASE WHEN value IN ('-1', '-1.0') THEN 1 ELSE 0 END AS BIGINT)) AS has_sentinel, max(c) AS max_count FROM counts GROUP BY 1),
    dev AS (SELECT column_name, stddev_pop(number) AS std FROM cells GROUP BY 1),
    stats AS (SELECT p.*, d.std FROM per_value p JOIN dev d USING (column_name))
    SELECT column_name, n_distinct, has_sentinel, max_count, round(std, 4) AS std,
      CAST(n_distinct <= 1 OR (n_distinct = 2 AND has_sentinel = 1) OR (std IS NOT NULL AND (std < 0.1 OR max_count > {MAX_SAME})) AS BIGINT) AS "drop"
    FROM stats"""


@query("feature_drop_list", _drop_sql())
def feature_drop_list(spark, folder):
    return tidy(X.feature_drop_list(merged(spark, folder), DROP_COLUMNS, max_same=MAX_SAME), 4)


@query(
    "feature_drop_summary",
    f"""SELECT column_name, CASE WHEN n_distinct <= 2 THEN n_distinct END AS n_distinct, CASE WHEN max_count > {MAX_SAME} THEN max_count END AS max_count, std, "drop" FROM ({_drop_sql()})""",
)
def feature_drop_summary(spark, folder):
    """The same decisions from summaries of few counters, fewer than some columns have values."""
    return tidy(H.drop_summary(merged(spark, folder), DROP_COLUMNS, max_same=MAX_SAME, counters=64), 4)


@query("removed_columns_sink", f'SELECT column_name FROM ({_drop_sql()}) WHERE "drop" = 1')
def removed_columns_sink(spark, folder):
    listed = X.feature_drop_list(merged(spark, folder), DROP_COLUMNS, max_same=MAX_SAME)
    return files.round_trip(listed.filter("drop = 1").select("column_name"), "removed-columns")


@query("external_predictions", f"WITH {Q.LIBRARY} SELECT 'label_fm@6' AS model, CAST(iter AS BIGINT) AS iter, CAST(fold AS BIGINT) AS fold, row_id, round(pred, 3) AS pred FROM preds WHERE model = 'ols'")
def external_predictions(spark, folder):
    """Per-fold text files of an outside program, registered as one more model."""
    wide = library(spark, folder)
    pieces = []
    for i in range(Q.ITERS):
        for f in range(Q.K):
            path = scratch_path(spark, f"outside-{i}-{f}")
            wide.filter((F.col("iter") == i) & (F.col("fold") == f)).select("row_id", "ols").write.csv(path)
            pieces.append(files.read_external_predictions(spark, path, "label_fm@6", i, f))
    return tidy(reduce(DataFrame.unionByName, pieces), 3)


@query("prediction_sink", f"WITH {Q.LIBRARY} SELECT model, CAST(iter AS BIGINT) AS iter, CAST(fold AS BIGINT) AS fold, row_id, round(pred, 3) AS pred FROM preds")
def prediction_sink(spark, folder):
    path = scratch_path(spark, "predictions")
    files.append_predictions(predictions(spark, folder), path)
    return tidy(files.read_predictions(spark, path), 3)


SUBMITTED = SHIFTED + """, sub AS (SELECT row_id, iter, pred, min(pred) OVER (PARTITION BY iter) AS lo, max(pred) OVER (PARTITION BY iter) AS hi FROM shifted WHERE model = 'ols'),
scaled AS (SELECT row_id, iter, CASE WHEN lo < 0 THEN (pred - lo) / (hi - lo) ELSE pred END AS pred FROM sub)"""


def _submission(spark, folder, iteration: int) -> DataFrame:
    chosen = shifted(spark, folder).filter((F.col("model") == "ols") & (F.col("iter") == iteration))
    return L.rescale(chosen, S.minmax_if_negative)


@query("submission_rows", f"""WITH {SUBMITTED} SELECT row_id AS "Id", round(pred, 6) + 0.0 AS "Sales" FROM scaled WHERE iter = 0""")
def submission_rows(spark, folder):
    root = scratch_path(spark, "submissions")
    version = files.write_submission(_submission(spark, folder, 0), root)
    return tidy(files.read_submission(spark, root, "model_library", version))


@query("submission_fixed_names", f"""WITH {SUBMITTED} SELECT row_id AS "Id", round(pred, 6) + 0.0 AS "Hazard" FROM scaled WHERE iter = 0""")
def submission_fixed_names(spark, folder):
    root = scratch_path(spark, "submissions")
    version = files.write_submission(_submission(spark, folder, 0), root, "hazard", target="Hazard")
    return tidy(files.read_submission(spark, root, "hazard", version, target="Hazard"))


@query(
    "submission_from_logs",
    f"""WITH {Q.LIBRARY} SELECT row_id AS "Id", round(exp(greatest(ln(pred + 1), 0)) - 1, 3) AS "Sales" FROM preds WHERE model = 'log_mean' AND iter = 0""",
)
def submission_from_logs(spark, folder):
    logs = library(spark, folder).filter("iter = 0").select("row_id", F.log1p("log_mean").alias("pred"))
    root = scratch_path(spark, "submissions")
    version = files.write_submission(logs.withColumn("pred", S.unlog_target(S.clip_negative(F.col("pred")))), root, "one_shot")
    return tidy(files.read_submission(spark, root, "one_shot", version), 3)


@query(
    "submission_next_version",
    f"""WITH {SUBMITTED} SELECT CAST(iter + 1 AS BIGINT) AS version, row_id AS "Id", round(pred, 6) + 0.0 AS "Sales" FROM scaled""",
)
def submission_next_version(spark, folder):
    """Submissions of one name count up."""
    root = scratch_path(spark, "submissions")
    pieces = []
    for i in range(Q.ITERS):
        version = files.write_submission(_submission(spark, folder, i), root)
        rows = files.read_submission(spark, root, "model_library", version)
        pieces.append(rows.select(F.lit(version).alias("version"), "Id", "Sales"))
    return tidy(reduce(DataFrame.unionByName, pieces))


@query("per_model_export", f"""WITH {Q.LIBRARY} SELECT model, row_id AS "Id", round(pred, 3) AS "Sales" FROM preds WHERE iter = 0 AND model IN ('mean', 'ols', 'ridge')""")
def per_model_export(spark, folder):
    chosen = predictions(spark, folder).filter(F.col("model").isin("mean", "ols", "ridge") & (F.col("iter") == 0))
    path = scratch_path(spark, "final")
    files.write_per_model(chosen, path, "Id", "Sales")
    rows = spark.read.schema("Id bigint, Sales double, model string").option("header", True).csv(path)
    return tidy(rows.select("model", "Id", "Sales"), 3)


@query(
    "attach_ids",
    f"""WITH {Q.LIBRARY}, {Q.TRAIN.strip()} SELECT t.row_id AS "Id", t.date_text, round(p.pred, 3) AS pred FROM train t JOIN preds p ON t.row_id = p.row_id WHERE model = 'ridge' AND iter = 0""",
)
def attach_ids(spark, folder):
    preds = library(spark, folder).filter("iter = 0").select(F.col("row_id").alias("id"), F.col("ridge").alias("pred"))
    ids = tables.test(spark, folder).select("id", "date_text")
    return tidy(ids.join(preds, "id").withColumnRenamed("id", "Id"), 3)


@query("align_predictions", f"WITH {Q.LIBRARY} SELECT model, CAST(iter AS BIGINT) AS iter, CAST(fold AS BIGINT) AS fold, row_id, y, round(y - pred, 3) AS error FROM preds WHERE model IN ('by_kind', 'ols')")
def align_predictions(spark, folder):
    """Predictions read from their table meet the labels by key."""
    path = scratch_path(spark, "predictions")
    files.append_predictions(predictions(spark, folder), path)
    chosen = files.read_predictions(spark, path).filter(F.col("model").isin("by_kind", "ols"))
    labels = folded_sales(spark, folder).select("iter", "fold", "row_id", "y")
    aligned = L.align_with_labels(chosen, labels)
    return tidy(aligned.select("model", "iter", "fold", "row_id", "y", (F.col("y") - F.col("pred")).alias("error")), 3)
