"""Queries of the code memory and of search, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import memory, search, timestamps
from codestrata.plans.clock_sql import clock
from codestrata.session import table

RECENT = "2025-06-01 00:00:00+00:00"
QUERY = "signal parser"


def _cm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_memory")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    """The memory with the instant of every row."""
    return timestamps.timed(_cm(spark, d), table(spark, d, "sessions"))


def _recent() -> Column:
    return F.lit(RECENT).cast("timestamp")


def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory.stats(_timed(spark, d))


def kb_coverage(spark: SparkSession, d: str) -> DataFrame:
    return memory.coverage(_cm(spark, d))


def kb_recent(spark: SparkSession, d: str) -> DataFrame:
    return memory.newest(_timed(spark, d), 20).select(*memory.LISTED, "at_us")


def kb_by_session(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "sessions").agg(F.min("session_id")).first()[0]
    return memory.of_session(_timed(spark, d), first).select(*memory.LISTED, "at_us")


def kb_path_search(spark: SparkSession, d: str) -> DataFrame:
    return memory.path_search(_cm(spark, d), "Engine/").select(*memory.LISTED)


def kb_path_newest(spark: SparkSession, d: str) -> DataFrame:
    return memory.path_search(_timed(spark, d), "loop", 10).select(*memory.LISTED, "at_us")


def kb_get(spark: SparkSession, d: str) -> DataFrame:
    """Point lookup of the least id."""
    cm = _cm(spark, d)
    return memory.get(cm, cm.agg(F.min("id")).first()[0]).select(*memory.LISTED, "new_code")


def kb_with_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return memory.with_embeddings(_cm(spark, d)).select("id", "timestamp", F.size("embedding").alias("dim"))


def kb_export(spark: SparkSession, d: str) -> DataFrame:
    return memory.export(_timed(spark, d)).select("id", "file_path", "old_code", "new_code", "context", "timestamp", "session_id", F.col("embedding").isNull().alias("without_embedding"))


def kb_store(spark: SparkSession, d: str) -> DataFrame:
    """Extracted changes that the memory does not hold yet."""
    new = table(spark, d, "code_change").select(F.col("change_id").cast("string").alias("id"), "file_path", "timestamp")
    return memory.store(_cm(spark, d).select("file_path", "timestamp"), new).select("id", "file_path", "timestamp")


def kb_delete(spark: SparkSession, d: str) -> DataFrame:
    """The memory without its rows of null session."""
    cm = _cm(spark, d)
    return memory.delete(cm.select("id", "file_path"), cm.where("session_id is null")).select("id", "file_path")


def kb_update_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an embedding take that of the first row of the same path."""
    cm = _cm(spark, d)
    vec = cm.where("embedding is not null").groupBy("file_path").agg(F.min_by("embedding", "id").alias("embedding"))
    new = cm.where("embedding is null").select("id", "file_path").join(vec, "file_path").select("id", "embedding")
    return memory.update_embedding(cm.select("id", "embedding"), new).select("id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"), F.get("embedding", 0).cast("double").alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def kb_clear(spark: SparkSession, d: str) -> DataFrame:
    """How many rows emptying the memory and the edit log removes, and what is left."""
    out = None
    for name in ("code_memory", "edit_history"):
        left, n = memory.clear(table(spark, d, name))
        row = n.crossJoin(left.agg(F.count("*").alias("remain"))).select(F.lit(name).alias("store"), "cleared", "remain")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def _target(spark: SparkSession, d: str) -> DataFrame:
    """A store that a copy has reached in part: the rows with an embedding."""
    return memory.with_embeddings(_cm(spark, d))


def kb_migration_plan(spark: SparkSession, d: str) -> DataFrame:
    return memory.migration_plan(_cm(spark, d).select("id"), _target(spark, d)).select("id", "batch")


def kb_migration_report(spark: SparkSession, d: str) -> DataFrame:
    return memory.migration_report(_cm(spark, d), _target(spark, d))


def kb_migration_sample(spark: SparkSession, d: str) -> DataFrame:
    return memory.validate_sample(_cm(spark, d), _target(spark, d))


def embedding_backlog(spark: SparkSession, d: str) -> DataFrame:
    return memory.backlog(_timed(spark, d), _recent(), 500).select("id", "priority", "at_us")


def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = memory.backlog(_timed(spark, d), _recent()).select("id", "priority", "at_us")
    return memory.number_batches(rows, [F.col("priority"), F.desc_nulls_last("at_us"), F.col("id")], 32).select("id", "batch")


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Groups of rows with the same code; hashed before the shuffle, so texts do not move."""
    h = F.sha2("new_code", 256)
    return _cm(spark, d).groupBy(h.alias("hash")).agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


def _vector(spark: SparkSession, d: str) -> list[float]:
    """The query vector: the embedding of the first usable row (one row to the driver)."""
    cm = _cm(spark, d).where("size(embedding) = 384 and not exists(embedding, x -> isnan(x))")
    return list(cm.orderBy("id").select("embedding").first()[0])


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.lexical(_cm(spark, d), QUERY, 10)


def bm25_any_topk(spark: SparkSession, d: str) -> DataFrame:
    """Signs left in the query: any of its words may match."""
    return search.lexical(_cm(spark, d), "raise, sorted/logger token", 25)


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """The five best rows of the memory for every project name's words."""
    q = table(spark, d, "projects").select(F.col("project").alias("query_id"), F.translate("project", "-", " ").alias("query"))
    return search.batch_bm25(_cm(spark, d), q, 5).select("query_id", "id", "rank", "n")


def weighted_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.weighted_rank(_cm(spark, d), QUERY, 10)


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.semantic(_cm(spark, d), _vector(spark, d), 10)


def code_to_code_topk(spark: SparkSession, d: str) -> DataFrame:
    first = _cm(spark, d).where("size(embedding) = 384 and not exists(embedding, x -> isnan(x))").agg(F.min("id")).first()[0]
    return search.code_to_code(_cm(spark, d), _vector(spark, d), first)


def embeddings_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest rows of the small embeddings table for every one of its vectors, exactly."""
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    near = search.batch_semantic(rows, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)
    return near.select("query_id", "n", F.col("id").cast("bigint").alias("vec_id"), "score")


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(_cm(spark, d), QUERY, _vector(spark, d))


def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(_cm(spark, d), QUERY, _vector(spark, d), limit=20, path_filter="/")


QUERIES = {f.__name__: f for f in (kb_stats, kb_coverage, kb_recent, kb_by_session, kb_path_search, kb_path_newest, kb_get, kb_with_embeddings, kb_export, kb_store, kb_delete, kb_clear, kb_update_embedding,
    kb_migration_plan, kb_migration_report, kb_migration_sample, embedding_backlog, embedding_batches, exact_duplicates, bm25_topk, bm25_any_topk, bm25_batch, weighted_rank_topk, cosine_topk, code_to_code_topk,
    embeddings_knn, hybrid_topk, hybrid_filtered)}

_L = "id, file_path, timestamp, session_id"
_AT = f"WITH {clock('code_memory', 'id')}, m AS (SELECT m.*, us AS at_us FROM code_memory m JOIN clk ON k = id)"
_LATE = f"CASE WHEN at_us > epoch_us(TIMESTAMPTZ '{RECENT}') THEN 0 ELSE 1 END"
_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(id, '') || ' ' || coalesce(file_path, '') || ' ' || coalesce(new_code, '') || ' ' || coalesce(context, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_BASE = f"r AS (SELECT id, file_path, {_TOK} AS t FROM code_memory), g AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM r)"


def _bm25(terms: list[str], every: bool, name: str = "lex", limit: int = 10) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    where = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"{_BASE}, c AS (SELECT id, len(t) AS dl, {tf} FROM r), k AS (SELECT {df} FROM c), {name} AS (SELECT id, round(-({score}), 6) AS rank FROM c, k, g WHERE {where} ORDER BY rank, id LIMIT {limit})"


_NRM = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"
_USABLE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: isnan(x))) = 0"
_COS = f"""q AS (SELECT embedding AS v, id AS qid FROM code_memory WHERE {_USABLE} ORDER BY id LIMIT 1),
  cs AS (SELECT id, {_NRM.format('embedding')} AS na, {_NRM.format('v')} AS nb, list_sum(list_transform(list_zip(embedding[1:least(len(embedding), len(v))], v[1:least(len(embedding), len(v))]), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS dp, qid FROM code_memory, q WHERE embedding IS NOT NULL),
  cc AS (SELECT id, qid, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE ELSE dp / (na * nb) END AS c FROM cs),
  sem0 AS (SELECT id, qid, round(c, 6) AS score FROM cc WHERE NOT isnan(c))"""


def _hybrid(limit: int, path: str = "") -> str:
    keep = f"WHERE id IN (SELECT id FROM code_memory WHERE contains(file_path, '{path}'))" if path else ""
    return f"""WITH {_bm25(["parser", "signal"], True, "lex", 2 * limit)}, {_COS}, sem AS (SELECT id, score FROM sem0 ORDER BY score DESC, id LIMIT {2 * limit}),
  j AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN rank IS NULL THEN 0.0::DOUBLE WHEN rank < 0 THEN least(1.0::DOUBLE, 1 / (1 + abs(rank))) ELSE least(1.0::DOUBLE, rank) END AS f, coalesce(score, 0.0::DOUBLE) AS s
    FROM (SELECT * FROM lex {keep}) a FULL JOIN (SELECT * FROM sem {keep}) b ON a.id = b.id),
  o AS (SELECT id, round(f, 6) AS fts_score, round(s, 6) AS semantic_score FROM j)
  SELECT id, fts_score, semantic_score, round(0.4::DOUBLE * least(fts_score, 1.0::DOUBLE) + 0.6::DOUBLE * semantic_score, 6) AS relevance FROM o
  WHERE round(0.4::DOUBLE * least(fts_score, 1.0::DOUBLE) + 0.6::DOUBLE * semantic_score, 6) >= 0.3 OR fts_score > 0 ORDER BY relevance DESC, id LIMIT {limit}"""


ORACLE = {
    "kb_stats": f"{_AT} SELECT count(*) AS total, count(embedding) AS with_embeddings, count(DISTINCT file_path) AS files, count(DISTINCT session_id) AS sessions, min(at_us) AS oldest, max(at_us) AS newest FROM m",
    "kb_coverage": "SELECT count(*) AS total, count(embedding) AS embedded, round(coalesce(count(embedding) * 100.0::DOUBLE / nullif(count(*), 0), 0), 6) AS coverage FROM code_memory",
    "kb_recent": f"{_AT} SELECT {_L}, at_us FROM m ORDER BY at_us DESC NULLS LAST, id LIMIT 20",
    "kb_by_session": f"{_AT} SELECT {_L}, at_us FROM m WHERE session_id = (SELECT min(session_id) FROM sessions)",
    "kb_path_search": f"SELECT {_L} FROM code_memory WHERE file_path ILIKE '%Engine/%'",
    "kb_path_newest": f"{_AT} SELECT {_L}, at_us FROM m WHERE file_path ILIKE '%loop%' ORDER BY at_us DESC NULLS LAST, id LIMIT 10",
    "kb_get": f"SELECT {_L}, new_code FROM code_memory WHERE id = (SELECT min(id) FROM code_memory)",
    "kb_with_embeddings": "SELECT id, timestamp, len(embedding)::INTEGER AS dim FROM code_memory WHERE embedding IS NOT NULL",
    "kb_export": "SELECT id, file_path, old_code, new_code, context, timestamp, session_id, true AS without_embedding FROM code_memory",
    "kb_store": """SELECT id, file_path, timestamp FROM (SELECT change_id::VARCHAR AS id, file_path, timestamp, row_number() OVER (PARTITION BY file_path, timestamp ORDER BY change_id::VARCHAR) AS n FROM code_change) c
  WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM code_memory m WHERE m.file_path = c.file_path AND m.timestamp = c.timestamp)""",
    "kb_delete": "SELECT id, file_path FROM code_memory WHERE session_id IS NOT NULL",
    "kb_update_embedding": """WITH v AS (SELECT file_path, arg_min(embedding, id) AS e FROM code_memory WHERE embedding IS NOT NULL GROUP BY 1),
  u AS (SELECT id, coalesce(embedding, e) AS e FROM code_memory m LEFT JOIN v USING (file_path))
  SELECT id, coalesce(len(e), -1)::INTEGER AS dim, e[1]::DOUBLE AS first, round(CASE WHEN len(e) = 0 THEN 0 ELSE list_sum(list_transform(e, lambda x: x::DOUBLE)) END, 4) AS total FROM u""",
    "kb_clear": "SELECT 'code_memory' AS store, count(*) AS cleared, 0::BIGINT AS remain FROM code_memory UNION ALL SELECT 'edit_history', count(*), 0 FROM edit_history",
    "kb_migration_plan": "SELECT id, ceil(row_number() OVER (ORDER BY id) / 100.0)::BIGINT AS batch FROM code_memory WHERE embedding IS NULL",
    "kb_migration_report": "SELECT count(*) AS total, count(t.id) AS skipped, count(*) - count(t.id) AS migrated, round((count(*) - count(t.id) + count(t.id)) * 100.0::DOUBLE / count(*), 6) AS success_rate FROM code_memory s LEFT JOIN (SELECT id FROM code_memory WHERE embedding IS NOT NULL) t USING (id)",
    "kb_migration_sample": "SELECT a.id, a.embedding = b.embedding AS same FROM (SELECT * FROM code_memory WHERE embedding IS NOT NULL ORDER BY md5(id), id LIMIT 5) a JOIN code_memory b ON a.id = b.id",
    "embedding_backlog": f"{_AT} SELECT id, ({_LATE})::INTEGER AS priority, at_us FROM m WHERE embedding IS NULL ORDER BY priority, at_us DESC NULLS LAST, id LIMIT 500",
    "embedding_batches": f"{_AT} SELECT id, ceil(row_number() OVER (ORDER BY {_LATE}, at_us DESC NULLS LAST, id) / 32.0)::BIGINT AS batch FROM m WHERE embedding IS NULL",
    "exact_duplicates": "SELECT sha256(new_code) AS hash, count(*) AS copies, min(id) AS first_id FROM code_memory GROUP BY 1 HAVING count(*) > 1",
    "bm25_topk": f"WITH {_bm25(['parser', 'signal'], True)} SELECT id, rank FROM lex",
    "bm25_any_topk": f"WITH {_bm25(['logger', 'raise', 'sorted', 'token'], False, 'lex', 25)} SELECT id, rank FROM lex",
    "bm25_batch": rf"""WITH {_BASE}, qt AS (SELECT DISTINCT project AS query_id, unnest(list_filter(regexp_split_to_array(lower(project), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS term FROM projects),
  p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM r), c AS (SELECT id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL), k AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
  s AS (SELECT query_id, id, round(-sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS rank FROM c JOIN k USING (term) JOIN qt USING (term), g GROUP BY ALL)
  SELECT query_id, id, rank, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS n FROM s) WHERE n <= 5""",
    "weighted_rank_topk": r"""WITH w AS (SELECT id, regexp_split_to_array(lower(coalesce(file_path, '')), '[^\p{L}\p{N}]+') AS a, regexp_split_to_array(lower(coalesce(new_code, '')), '[^\p{L}\p{N}]+') AS b, regexp_split_to_array(lower(coalesce(context, '')), '[^\p{L}\p{N}]+') AS c FROM code_memory),
  n AS (SELECT id, len(list_filter(a, lambda x: x = 'parser')) AS a1, len(list_filter(b, lambda x: x = 'parser')) AS b1, len(list_filter(c, lambda x: x = 'parser')) AS c1, len(list_filter(a, lambda x: x = 'signal')) AS a2, len(list_filter(b, lambda x: x = 'signal')) AS b2, len(list_filter(c, lambda x: x = 'signal')) AS c2 FROM w)
  SELECT id, round(1.0::DOUBLE * (1 - 1 / (1 + a1)) + 0.4::DOUBLE * (1 - 1 / (1 + b1)) + 0.2::DOUBLE * (1 - 1 / (1 + c1)) + 1.0::DOUBLE * (1 - 1 / (1 + a2)) + 0.4::DOUBLE * (1 - 1 / (1 + b2)) + 0.2::DOUBLE * (1 - 1 / (1 + c2)), 6) AS rank
  FROM n WHERE a1 + b1 + c1 > 0 AND a2 + b2 + c2 > 0 ORDER BY rank DESC, id LIMIT 10""",
    "cosine_topk": f"WITH {_COS} SELECT id, score FROM sem0 ORDER BY score DESC, id LIMIT 10",
    "code_to_code_topk": f"WITH {_COS}, t AS (SELECT * FROM sem0 ORDER BY score DESC, id LIMIT 10) SELECT id, score FROM t WHERE score >= 0.4 AND id <> qid ORDER BY score DESC, id LIMIT 5",
    "embeddings_knn": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id::VARCHAR AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b)
  SELECT query_id, n::INTEGER AS n, id::BIGINT AS vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 10""",
    "hybrid_topk": _hybrid(5),
    "hybrid_filtered": _hybrid(20, "/"),
}
