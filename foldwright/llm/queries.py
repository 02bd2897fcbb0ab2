"""The registered queries of this folder, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldwright.llm import bpe, chat, clustering, divergence, exact_dedup, language, line_dedup, mixing, personal, quality, secrets, simhash, suffix_dedup
from foldwright.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, '<s>' || regexp_replace(role, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g') || '[INST]'
            || regexp_replace(text, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g') || '[/INST]</s>' AS shown FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op2_chat_format", CHAT_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(documents(spark, sf_dir))


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, c.k IS NOT NULL AND keyed.doc_id <> c.last AS gone FROM keyed LEFT JOIN common c ON keyed.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op5_line_dedup", LINES_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(documents(spark, sf_dir))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(documents(spark, sf_dir))


EXACT_SQL = r"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY p ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY p) AS group_size FROM plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(p) AS text_sha256 FROM ranked
"""


@query("op9_exact_dedup", EXACT_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(documents(spark, sf_dir))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
terms AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (
  SELECT l.lang, count(t.term)::HUGEINT AS v, coalesce(sum(t.c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN terms t ON l.lang = t.lang GROUP BY l.lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN terms t ON w.lang = t.lang AND w.term = t.term GROUP BY ALL),
sources AS (
  SELECT s.lang, s.source, coalesce(sum(c.c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) s LEFT JOIN counts c ON s.lang = c.lang AND s.source = c.source GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, t.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (s.n + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (t.c + 5)) // (l.n + 5 * l.v) AS q
  FROM sources s JOIN langs l ON s.lang = l.lang JOIN terms t ON t.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.other = b.source),
listed AS (
  SELECT * FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
WHERE part = 'pair' OR rank <= 50
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


CLUSTERS, COMPONENTS = 16, 64


def _cluster_sql() -> str:
    """Three rounds and the last assignment, unrolled."""
    nearest = """{out} AS (
  SELECT r, vec_id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT x.r, x.vec_id, x.v, m.c, list_sum(list_transform(list_zip(x.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM kept x CROSS JOIN {centres} m) GROUP BY ALL)"""
    moved = """{out} AS (
  SELECT c, CASE WHEN count(s) = 0 THEN any_value(old) ELSE list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) END AS v
  FROM (SELECT m.c, m.v AS old, t.i, t.s, t.n FROM {centres} m LEFT JOIN (
    SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {near})
    GROUP BY cluster, i) t ON t.cluster = m.c) GROUP BY c)"""
    parts = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {COMPONENTS})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept) QUALIFY c < {CLUSTERS})",
    ]
    for n in range(3):
        parts += [nearest.format(out=f"n{n}", centres=f"c{n}"), moved.format(out=f"c{n + 1}", centres=f"c{n}", near=f"n{n}")]
    parts += [nearest.format(out="found", centres="c3")]
    return "WITH " + ",\n".join(parts) + """
SELECT f.vec_id, f.cluster::INTEGER AS cluster, f.distance, (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
       (sum(f.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM found f JOIN c3 m ON m.c = f.cluster"""


@query("op13_centroid_clustering", _cluster_sql())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
