"""Registered queries of the corpus operators, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprint import fingerprints
from .html_text import extract
from .lang_id import identify
from .license_scan import PHRASES, TEMPLATES, THRESHOLD, license_scan, text_words
from .mixing import mix
from .near_dedup import near_duplicates
from .pieces import encode
from .substring_dedup import substring_dedup
from .topk_search import top_k
from .toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, words, i, array_to_string(list_slice(words, i, i + 49), ' ') AS win
  FROM w, unnest(range(1, len(words) - 48)) AS u(i)),
least AS (SELECT win, min(doc_id) AS m FROM win GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, i + k AS pos
  FROM win JOIN least USING (win), unnest(range(50)) AS v(k)
  WHERE doc_id > m),
lost AS (SELECT doc_id, list(pos) AS lost FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(lost), 0) AS n_removed,
    list_filter(words, lambda x, i: lost IS NULL OR NOT list_contains(lost, i)) AS kept
  FROM w LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_substring_dedup": op2_substring_dedup}
SQL: dict[str, str] = {"op2_substring_dedup": OP2_SQL}


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")


_WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TEMPLATE_ROWS = ", ".join(f"({k}, '{label}', {len(text_words(text))}, {sorted(set(text_words(text)))}, {text_words(keys)}::VARCHAR[])" for k, (label, text, keys) in enumerate(TEMPLATES))
_BASE = " UNION ALL ".join(
    f"SELECT row, '{label}' AS label, i - 1 AS start FROM d, unnest(range(1, len(words) + 1)) AS u(i) WHERE " + " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
    for phrase, label in PHRASES.items()
)
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text, {_WORDS.format("text")} AS words FROM documents),
base AS ({_BASE}),
found AS (SELECT row, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY row),
t AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) AS v(id, label, size, words, keys)),
tw AS (SELECT id, size, unnest(words) AS word FROM t),
dw AS (SELECT row, k - 1 AS pos, words[k] AS word FROM d, unnest(range(1, len(words) + 1)) AS u(k)),
inside AS (SELECT row, id, word, pos // size AS block FROM dw JOIN tw USING (word)),
held AS (SELECT DISTINCT row, id, word, block FROM inside UNION SELECT row, id, word, block - 1 FROM inside WHERE block > 0),
hit AS (
  SELECT row, id, block, count(*) AS n, list(word) AS words FROM held GROUP BY row, id, block),
matched AS (
  SELECT row, label, n / len(t.words) AS share FROM hit JOIN t USING (id)
  WHERE n >= {THRESHOLD} * len(t.words) AND list_has_all(hit.words, t.keys)),
more AS (SELECT row, max(share) AS share, list_distinct(list(label)) AS labels FROM matched GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(found.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN found USING (row) LEFT JOIN more USING (row)
"""
QUERIES |= {"op5_document_fingerprints": op5_document_fingerprints, "op3_license_scan": op3_license_scan}
SQL |= {"op3_license_scan": OP3_SQL}


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES["op10_language_id"] = op10_language_id


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES["op4_toxicity"] = op4_toxicity


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "score", "ids_sha256", "nbest", "round_trip")


QUERIES["op9_sentencepiece"] = op9_sentencepiece


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
QUERIES |= {"op8_html_text": op8_html_text, "op6_exact_top_k": op6_exact_top_k}
SQL["op6_exact_top_k"] = OP6_SQL


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


QUERIES["op7_near_dedup"] = op7_near_dedup


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])


QUERIES["op1_mixing"] = op1_mixing
