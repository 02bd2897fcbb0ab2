"""SQL building blocks shared by the oracles: the same views and models as in ``sources.tables`` and
``operators.baselines``, written out in plain SQL."""

from __future__ import annotations

K = 3
ITERS = 2
RIDGE = 50000000000.0

TRAIN = """
train AS (
  SELECT o_orderkey AS row_id, o_custkey AS store,
         strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date_text,
         CAST(isodow(o_orderdate) AS BIGINT) AS day_of_week, o_totalprice AS sales,
         CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 END AS open,
         CAST(o_orderpriority = '1-URGENT' AS INT) AS promo,
         CAST(o_orderpriority = '2-HIGH' AS INT) AS school_holiday,
         CASE o_orderpriority WHEN '3-MEDIUM' THEN 'a' WHEN '4-NOT SPECIFIED' THEN 'b' WHEN '5-LOW' THEN 'c' ELSE '0' END AS state_holiday,
         o_orderpriority AS stratum
  FROM orders)"""

STORE = """
store AS (
  SELECT c_custkey AS store,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'a' WHEN 'BUILDING' THEN 'b' WHEN 'FURNITURE' THEN 'c' WHEN 'HOUSEHOLD' THEN 'd' END AS store_type,
         CASE c_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS assortment,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS competition_distance,
         CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey % 12 + 1 AS DOUBLE) END AS competition_month,
         CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey + 1990 AS DOUBLE) END AS competition_year,
         c_nationkey % 2 AS promo2,
         CASE WHEN c_nationkey % 2 = 1 THEN CAST(c_nationkey + 1 AS DOUBLE) END AS promo2_week,
         CASE WHEN c_nationkey % 2 = 1 THEN CAST(c_nationkey + 2000 AS DOUBLE) END AS promo2_year
  FROM customer)"""

MERGED = TRAIN + "," + STORE + """,
merged AS (SELECT train.*, store.* EXCLUDE (store) FROM train JOIN store ON train.store = store.store)"""

SALES = """
sales AS (
  SELECT o_orderkey AS row_id, o_totalprice AS y, c_acctbal AS x, c_mktsegment AS kind, o_orderpriority AS stratum
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

ITEMS = """
items AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_id,
         l_extendedprice AS y, l_returnflag AS stratum, l_quantity, l_discount, l_tax, CAST(p_size AS DOUBLE) AS p_size, p_retailprice
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

LABELLED = """
labelled AS (
  SELECT d.doc_id AS row_id, CAST(quality AS DOUBLE) AS y, CAST(quality AS VARCHAR) AS stratum,
         n_chars / (n_chars + 1000.0::DOUBLE) AS length_score, lang, source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL)"""


def seeds(iters: int) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{711 + 1000 * (i + 1)}')" for i in range(iters)) + ") seeds(iter, seed)"


def stratified(view: str, stratum: str = "stratum", k: int = K, iters: int = ITERS, out: str = "folded") -> str:
    return f"""
{out} AS (
  SELECT v.*, iter,
         (row_number() OVER (PARTITION BY iter, {stratum} ORDER BY md5(concat_ws('|', seed, row_id)), row_id) - 1) % {k} AS fold
  FROM {view} v, {seeds(iters)})"""


def leave_out(view: str, values: str, group: str | None = None) -> str:
    """Aggregates over the rows of the other folds, per (iter, fold)."""
    by = f", t.{group}" if group else ""
    return f"""(
  SELECT t.iter, v.fold{by}, {values}
  FROM {view} t JOIN (SELECT DISTINCT iter, fold FROM {view}) v ON t.iter = v.iter AND t.fold <> v.fold
  GROUP BY t.iter, v.fold{by})"""


MODELS = ["mean", "log_mean", "by_kind", "by_stratum", "ols", "ridge"]

# The model library on the sales view as columns: `wide`, and as rows: `preds`.
LIBRARY = SALES + "," + stratified("sales") + f""",
overall AS {leave_out("folded", '''avg(y) AS "mean", exp(avg(ln(y + 1))) - 1 AS log_mean, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sp, var_pop(x) * count(*) AS ss''')},
kinds AS {leave_out("folded", "avg(y) AS by_kind", "kind")},
strata AS {leave_out("folded", "avg(y) AS by_stratum", "stratum")},
wide AS (
  SELECT f.row_id, f.iter, f.fold, f.y, f.x, f.kind, f.stratum, o."mean", o.log_mean,
         coalesce(k.by_kind, o."mean") AS by_kind, coalesce(s.by_stratum, o."mean") AS by_stratum,
         o.my + o.sp / o.ss * (f.x - o.mx) AS ols, o.my + o.sp / (o.ss + {RIDGE}) * (f.x - o.mx) AS ridge
  FROM folded f JOIN overall o USING (iter, fold)
  LEFT JOIN kinds k ON f.iter = k.iter AND f.fold = k.fold AND f.kind = k.kind
  LEFT JOIN strata s ON f.iter = s.iter AND f.fold = s.fold AND f.stratum = s.stratum),
preds AS (
  {" UNION ALL ".join(f"SELECT '{m}' AS model, iter, fold, row_id, y, " + f'"{m}" AS pred FROM wide' for m in MODELS)})"""

RMSPE = "sqrt(avg(CASE WHEN y <> 0 THEN pow((y - pred) / y, 2) ELSE 0 END))"

SCORES = LIBRARY + f""",
scores AS (SELECT model, iter, fold, {RMSPE} AS score FROM preds GROUP BY model, iter, fold),
summary AS (SELECT model, avg(score) AS cv_mean, stddev_pop(score) AS cv_std, count(*) AS n_folds FROM scores GROUP BY model),
ranking AS (SELECT *, row_number() OVER (ORDER BY cv_mean, model) AS model_rank FROM summary)"""


def uniform(seed: int, *keys: str) -> str:
    text = ", ".join([f"'{seed}'", *keys])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
