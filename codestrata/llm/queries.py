"""The pN_ queries of the llm operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import leaks, neardup, neighbours, provenance, reading, secrets, splitting, tokenizer
from codestrata.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.found(table(spark, d, "code_memory"))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "code_memory"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "code_memory"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.membership(table(spark, d, "code_memory"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.beliefs(table(spark, d, "code_memory")).where("label <> 'handwritten'").select("id")


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.beliefs(table(spark, d, "code_memory"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "code_memory"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "code_memory"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.locate(table(spark, d, "code_memory")).select("id", "field", "start_at")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(table(spark, d, "code_memory"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.occurrences(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.removal_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {f.__name__: f for f in (p2_found, p2_nearest, p3_found, p3_classes, p4_found, p4_labels, p5_found, p5_pieces, p6_found, p6_redacted, p7_ids, p8_found, p8_spans, p9_found)}
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x1c-\x1f\v]"
ORACLE = {
    "p3_found": f"""WITH c AS (SELECT id, unnest([new_code, old_code]) AS code FROM code_memory), d AS (SELECT DISTINCT code, md5(code) AS h FROM c WHERE code IS NOT NULL),
  t AS (SELECT h, regexp_extract_all(code, '{_TOKEN}') AS w FROM d), s AS (SELECT DISTINCT h, unnest(list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], chr(0))))) AS g FROM t WHERE len(w) >= 4),
  n AS (SELECT h, count(*) AS n FROM s GROUP BY h), b AS (SELECT x.h AS a, y.h AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.h <= y.h GROUP BY ALL),
  l AS (SELECT a, b FROM b JOIN n p ON p.h = a JOIN n q ON q.h = b WHERE k >= 0.7 * (p.n + q.n - k) - 1e-9), m AS (SELECT DISTINCT id, md5(code) AS h FROM c WHERE code IS NOT NULL)
  SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM l JOIN m x ON x.h = l.a JOIN m y ON y.h = l.b WHERE x.id <> y.id""",
    "p5_found": "SELECT id FROM code_memory WHERE length(new_code) > 2000",
}
