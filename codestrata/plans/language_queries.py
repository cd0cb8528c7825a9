"""Language detection queries, with SQL generated from the same patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import language as L
from codestrata.session import spread, table


def language_memory(spark: SparkSession, d: str) -> DataFrame:
    r = L.detect(spread(table(spark, d, "code_memory").select("id", "file_path", "new_code")), "file_path", "new_code")
    return r.select("id", "language", "confidence", "method", "is_code")


def language_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by content alone."""
    r = L.detect(spread(table(spark, d, "documents").select("doc_id", "text")), None, "text")
    return r.select("doc_id", "language", "confidence", "is_code")


def language_embedded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(L.embedded(F.col("text")), ",").alias("embedded"))


QUERIES = {f.__name__: f for f in (language_memory, language_documents, language_embedded)}


def _q(p: str) -> str:
    return p.replace("'", "''")


def _flag(dotall: bool = False) -> str:
    return "(?mis)" if dotall else "(?mi)"


def _sql(key: str, tab: str, path: str | None, content: str) -> str:
    case = lambda p, w: f"CASE WHEN regexp_matches(c, '{_flag(bool(p[2:]))}{_q(p[0])}') THEN {w} ELSE 0 END"
    scores = ", ".join(f"round(({' + '.join(case(p, p[1]) for p in L.PATTERNS[x])})::DOUBLE, 6) AS s_{x}, {' + '.join(case(p, 1) for p in L.PATTERNS[x])} AS n_{x}" for x in L.ORDER)
    shared = " + ".join(f"CASE WHEN regexp_matches(c, '(?mi){_q(p)}') THEN {w} ELSE 0 END" for p, w in L.SHARED)
    ext = " ".join(f"WHEN ext = '{e}' THEN '{lang}'" for e, lang in {e: lang for lang, es in L.EXTENSIONS.items() for e in es.split()}.items())
    special = " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in L.SPECIAL.items())
    bang = " ".join(f"WHEN regexp_matches(who, '^{p}') THEN '{v}'" for p, v in L.INTERPRETERS)
    ranked = "[" + ", ".join(f"{{'s': s_{x}, 'n': n_{x}, 'l': '{x}'}}" for x in L.ORDER) + "]"
    name = f"string_split({path}, '/')[-1]" if path else "NULL::VARCHAR"
    return rf"""WITH a AS (SELECT {key} AS k, coalesce({content}, '') AS c, {name} AS name FROM {tab}),
  b AS (SELECT *, lower(regexp_extract(regexp_replace(name, '^\.+', ''), '(\.[^.]+)$', 1)) AS ext, lower(regexp_extract(substring(c, 1, 500), '^#!\s*(?:/usr/bin/env\s+)?(?:\S*/)?(\w+)', 1)) AS who, {scores}, round(({shared})::DOUBLE, 6) AS shared FROM a),
  h AS (SELECT *, CASE {ext} END AS hint, CASE {special} END AS special, CASE {bang} END AS bang, {ranked} AS r FROM b),
  o AS (SELECT *, list_concat(list_filter(r, lambda x: x.l = hint), list_filter(r, lambda x: coalesce(x.l <> hint, true))) AS q FROM h),
  g AS (SELECT *, CASE WHEN regexp_replace(c, '\s', '', 'g') <> '' THEN coalesce(list_filter(q, lambda x: x.s >= 0.9)[1], list_filter(q, lambda x: x.s = list_max(list_transform(q, lambda y: y.s)) AND x.s > 0)[1]) END AS best, regexp_replace(c, '\s', '', 'g') = '' AS blank FROM o),
  f AS (SELECT *, least(0.5::DOUBLE + least(best.s, 0.45::DOUBLE) + CASE WHEN best.n >= 3 THEN 0.05 ELSE 0 END + CASE WHEN best.n >= 5 THEN 0.05 ELSE 0 END, 0.95::DOUBLE) AS c0, NOT blank AND shared > 0.15 AS loose FROM g),
  e AS (SELECT *, CASE WHEN best IS NOT NULL THEN CASE WHEN best.l = hint THEN greatest(c0, 0.8::DOUBLE) ELSE c0 END WHEN blank THEN 0.0::DOUBLE WHEN loose THEN least(shared + 0.1, 0.4::DOUBLE) ELSE 0.1::DOUBLE END AS cc FROM f)
  SELECT k AS {key}, CASE WHEN special IS NOT NULL THEN special WHEN bang IS NOT NULL THEN bang WHEN hint IS NOT NULL THEN hint WHEN best IS NOT NULL THEN best.l WHEN loose THEN 'code' END AS language,
  round(CASE WHEN special IS NOT NULL THEN 0.95::DOUBLE WHEN bang IS NOT NULL THEN 0.9::DOUBLE WHEN hint IS NOT NULL THEN greatest(0.85::DOUBLE, cc) ELSE cc END, 6) AS confidence,
  {"CASE WHEN special IS NOT NULL THEN 'special_file' WHEN bang IS NOT NULL THEN 'shebang' WHEN hint IS NOT NULL THEN 'extension' ELSE 'content' END AS method," if path else ""}
  CASE WHEN special IS NOT NULL OR bang IS NOT NULL OR hint IS NOT NULL THEN true WHEN best IS NOT NULL THEN cc >= 0.4 OR best.s > 0.3 ELSE loose END AS is_code FROM e"""


ORACLE = {
    "language_memory": _sql("id", "code_memory", "file_path", "new_code"),
    "language_documents": _sql("doc_id", "documents", None, "text"),
    "language_embedded": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?mis){_q(p)}') THEN '{x}' END" for x, p in L.EMBEDDED) + "], lambda x: x IS NOT NULL), ',') AS embedded FROM documents WHERE text IS NOT NULL",
}
