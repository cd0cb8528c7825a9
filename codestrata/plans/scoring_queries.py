"""Expression, scoring and budget queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths, relevance
from codestrata.operators import budget
from codestrata.session import table

AS_OF = "2025-06-15 12:00:00+00:00"
CURRENT = "/srv/work/kestrel-relay/engine/posting_loop.py"


def path_expressions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return table(spark, d, "code_memory").select("id", paths.short_path(p).alias("short"), paths.module_name(p).alias("module"), paths.content_hash(F.col("new_code")).alias("hash"), paths.shown_hash(p, F.col("new_code")).alias("shown"))


def relative_imports(spark: SparkSession, d: str) -> DataFrame:
    """Every module's view of two relative imports, under both rules for too many dots."""
    m = table(spark, d, "code_memory").select(paths.module_name(F.col("file_path")).alias("module")).distinct()
    package = F.lit(False)
    return m.select("module", paths.relative_import(F.lit("..util"), F.col("module"), package).alias("up"), paths.relative_import(F.lit(".....far"), F.col("module"), package, strict=True).alias("far"))


def signature_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the first line of every code against case and spacing."""
    line = F.split(F.col("new_code"), "\n")[0]
    return table(spark, d, "code_change").select("change_id", paths.signature_hash(F.regexp_replace(line, r"[^\x20-\x7e]", "")).alias("hash"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("new_code")
    return table(spark, d, "code_memory").select("id", *[paths.estimate_tokens(c, k).alias(k) for k in ("inject", "chunk", "code", "prose", "mixed")], paths.estimate_block(c).alias("block"), paths.human_bytes(F.length(c).cast("double") * 1000).alias("size"))


def code_truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_memory").select("id", F.md5(paths.truncate_code(F.col("new_code"))).alias("h"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    t = paths.embedding_text(F.col("file_path"), F.col("new_code"), F.col("context"))
    return table(spark, d, "code_memory").select("id", F.length(paths.preprocess(t)).alias("chars"), F.md5(t).alias("h"))


def recency_scores(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    h = table(spark, d, "edit_history").dropDuplicates(["id"]).where(F.col("timestamp") <= as_of)
    return h.select("id", F.round(relevance.recency(F.col("timestamp"), as_of), 6).alias("recency"))


def proximity_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_memory").select("id", F.round(relevance.proximity(F.col("file_path"), F.lit(CURRENT)), 6).alias("proximity"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The edits of every file, scored for the current file at a fixed time."""
    as_of = F.lit(AS_OF).cast("timestamp")
    h = table(spark, d, "edit_history").dropDuplicates(["id"]).where(F.col("timestamp") <= as_of)
    s = relevance.combine(relevance.recency(F.col("timestamp"), as_of), relevance.proximity(F.col("file_path"), F.lit(CURRENT)), F.lit(0.5), relevance.project(F.col("file_path"), F.lit("/srv/work/kestrel-relay")))
    return h.select("id", "file_path", "session_id", F.round(s, 6).alias("score"))


def relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= relevance.LEAST).select("id", "score")


def dependency_boosts(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "code_memory")
    deps = F.array(F.lit("posting_loop"), F.lit("load_badger_rope"), F.lit("logger"))
    name = F.regexp_extract("new_code", r"def (\w+)", 1)
    return h.select("id", F.round(relevance.dependency_boost(F.lit(0.7), name, F.col("new_code"), deps), 6).alias("score"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_memory").where("session_id is not null").select("session_id", "id", "file_path", "new_code", paths.estimate_block(F.col("new_code")).alias("tokens"))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of each session in order of id until the budget overflows."""
    return budget.prefix(_sized(spark, d), "session_id", [F.col("id")], F.col("tokens"), 2000).select("session_id", "id", "used")


def budget_skip(spark: SparkSession, d: str) -> DataFrame:
    """The same with larger snippets skipped: complete snippets within a standard budget."""
    return budget.allocate(_sized(spark, d), "session_id", ["id"], "new_code")


def budget_truncated(spark: SparkSession, d: str) -> DataFrame:
    t = budget.truncate_lines(F.col("new_code"), F.lit(200))
    return table(spark, d, "code_memory").select("id", F.length(t).alias("chars"))


QUERIES = {f.__name__: f for f in (path_expressions, relative_imports, signature_hashes, token_estimates, code_truncated, embedding_texts, recency_scores, proximity_scores, relevance_scores, dependency_boosts, budget_prefix, budget_skip, budget_truncated)}

_REC = f"least(1.0::DOUBLE, CASE WHEN d > 90 THEN 0.0::DOUBLE ELSE exp(-ln(2.0::DOUBLE) / 7 * d) END)"
_H = f"h AS (SELECT *, (epoch_us(TIMESTAMPTZ '{AS_OF}') - epoch_us(timestamp))::DOUBLE / 86400000000 AS d FROM (SELECT DISTINCT * FROM edit_history) WHERE timestamp <= TIMESTAMPTZ '{AS_OF}')"
_PRX = """CASE WHEN file_path = '{c}' THEN 1.0::DOUBLE WHEN array_to_string(a[:-2], '/') = array_to_string(b[:-2], '/') THEN 0.8::DOUBLE WHEN array_to_string(a[:-3], '/') = array_to_string(b[:-3], '/') THEN 0.6::DOUBLE
  WHEN greatest(len(a), len(b)) <= 1 THEN 0.3::DOUBLE ELSE 0.3::DOUBLE + 0.4::DOUBLE * (SELECT count(*) FROM range(1, greatest(len(a), len(b))) r(i) WHERE len(a) - 1 >= i AND len(b) - 1 >= i AND a[1:i] = b[1:i]) / (greatest(len(a), len(b)) - 1) END""".format(c=CURRENT)
_AB = f"string_split(file_path, '/') AS a, string_split('{CURRENT}', '/') AS b"
_BLOCK = "(CASE WHEN length(new_code) = 0 THEN 0 ELSE floor(length(new_code) / 4.0::DOUBLE * 1.1::DOUBLE) + 1 END + 4)::INTEGER"
_MOD = r"translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_path, '^\./', ''), '\.py$', ''), '(^|/)__init__$', ''), '^/+', ''), '/', '.')"

ORACLE = {
    "path_expressions": f"SELECT id, CASE WHEN len(string_split(file_path, '/')) > 3 THEN '.../' || array_to_string(string_split(file_path, '/')[-3:], '/') ELSE file_path END AS short, {_MOD} AS module, left(sha256(new_code), 16) AS hash, md5(file_path || ':' || substring(new_code, 1, 500)) AS shown FROM code_memory",
    "relative_imports": f"WITH m AS (SELECT DISTINCT {_MOD} AS module FROM code_memory), s AS (SELECT module, string_split(module, '.') AS p FROM m) SELECT module, CASE WHEN len(p) - 2 < 0 THEN '..util' WHEN array_to_string(p[:len(p) - 2], '.') = '' THEN 'util' ELSE array_to_string(p[:len(p) - 2], '.') || '.util' END AS up, CASE WHEN len(p) - 5 < 0 THEN NULL WHEN len(p) = 5 OR array_to_string(p[:len(p) - 5], '.') = '' THEN 'far' ELSE array_to_string(p[:len(p) - 5], '.') || '.far' END AS far FROM s",
    "signature_hashes": r"SELECT change_id, left(sha256(regexp_replace(trim(lower(regexp_replace(string_split(new_code, chr(10))[1], '[^\x20-\x7e]', '', 'g'))), '\s+', ' ', 'g')), 16) AS hash FROM code_change",
    "token_estimates": f"""WITH n AS (SELECT id, new_code, length(new_code) AS n FROM code_memory) SELECT id, (n // 4)::INTEGER AS inject, (n // 4 + 1)::INTEGER AS chunk,
  CASE WHEN n = 0 THEN 0 ELSE floor(n / 4.0::DOUBLE * 1.1::DOUBLE)::INTEGER + 1 END AS code, CASE WHEN n = 0 THEN 0 ELSE floor(n / 5.0::DOUBLE * 1.1::DOUBLE)::INTEGER + 1 END AS prose, CASE WHEN n = 0 THEN 0 ELSE floor(n / 4.5::DOUBLE * 1.1::DOUBLE)::INTEGER + 1 END AS mixed, {_BLOCK} AS block,
  CASE WHEN n * 1000 < 1024 THEN printf('%.1f B', n * 1000.0::DOUBLE) WHEN n * 1000 < 1048576 THEN printf('%.1f KB', n * 1000 / 1024.0::DOUBLE) ELSE printf('%.1f MB', n * 1000 / 1048576.0::DOUBLE) END AS size FROM n""",
    "code_truncated": "WITH s AS (SELECT id, new_code, string_split(new_code, chr(10)) AS l FROM code_memory) SELECT id, md5(CASE WHEN len(l) > 30 THEN array_to_string(l[:15], chr(10)) || chr(10) || chr(10) || '    # ... (' || (len(l) - 30) || ' lines omitted) ...' || chr(10) || chr(10) || array_to_string(l[-15:], chr(10)) ELSE new_code END) AS h FROM s",
    "embedding_texts": r"""WITH t AS (SELECT id, 'File: ' || array_to_string(string_split(file_path, '/')[-3:], '/') || chr(10) || chr(10) || new_code || CASE WHEN length(context) > 0 THEN chr(10) || chr(10) || 'Context: ' || substring(context, 1, 200) ELSE '' END AS t FROM code_memory),
  u AS (SELECT id, t, replace(t, chr(9), '    ') AS w FROM t), v AS (SELECT id, t, CASE WHEN length(w) > 1500 THEN substring(w, 1, 750) || chr(10) || '...' || chr(10) || right(w, 750) ELSE w END AS w FROM u)
  SELECT id, length(regexp_replace(w, '^\s+|\s+$', '', 'g'))::INTEGER AS chars, md5(t) AS h FROM v""",
    "recency_scores": f"WITH {_H} SELECT id, round({_REC}, 6) AS recency FROM h",
    "proximity_scores": f"SELECT id, round({_PRX}, 6) AS proximity FROM (SELECT id, file_path, {_AB} FROM code_memory)",
    "relevance_scores": f"WITH {_H}, x AS (SELECT *, {_AB} FROM h), s AS (SELECT id, round(0.2::DOUBLE * {_REC} + 0.25::DOUBLE * ({_PRX}) + 0.35::DOUBLE * 0.5::DOUBLE + 0.2::DOUBLE * (CASE WHEN starts_with(file_path, '/srv/work/kestrel-relay') THEN 1.0 ELSE 0.3 END)::DOUBLE, 6) AS score FROM x) SELECT id, score FROM s WHERE score >= 0.3",
    "dependency_boosts": r"""SELECT id, round(least(1.0::DOUBLE, 0.7::DOUBLE * (CASE WHEN regexp_extract(new_code, 'def (\w+)', 1) IN ('posting_loop', 'load_badger_rope', 'logger') THEN 1.2 ELSE 1.0 END)::DOUBLE *
  (CASE WHEN regexp_matches(new_code, '(def|class) (posting_loop|load_badger_rope|logger)') THEN 1.15 ELSE 1.0 END)::DOUBLE), 6) AS score FROM code_memory""",
    "budget_prefix": f"SELECT session_id, id, used FROM (SELECT session_id, id, (sum({_BLOCK}) OVER (PARTITION BY session_id ORDER BY id))::BIGINT AS used FROM code_memory WHERE session_id IS NOT NULL) WHERE used <= 2000",
    "budget_skip": f"""WITH RECURSIVE s AS (SELECT session_id, {_BLOCK} AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM code_memory WHERE session_id IS NOT NULL),
  f AS (SELECT session_id, n, tokens, tokens <= 500 AND tokens <= 1900 AS taken, CASE WHEN tokens <= 500 AND tokens <= 1900 THEN 1900 - tokens ELSE 1900 END AS rest FROM s WHERE n = 1
    UNION ALL SELECT s.session_id, s.n, s.tokens, s.tokens <= 500 AND s.tokens <= f.rest, CASE WHEN s.tokens <= 500 AND s.tokens <= f.rest THEN f.rest - s.tokens ELSE f.rest END FROM f JOIN s ON s.session_id = f.session_id AND s.n = f.n + 1)
  SELECT session_id, n::INTEGER AS n, tokens FROM f WHERE taken""",
}
