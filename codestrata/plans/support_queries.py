"""Queries of the smaller operators: retries, limits, budgets, projects, measured runs, graph cycles, batch search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.operators import budget, graph, measure, projects, search
from codestrata.plans import memory_queries
from codestrata.plans.graph_queries import _calls, _e, _start
from codestrata.plans.streaming_queries import _queue
from codestrata.session import table, written
from codestrata.streaming import backfill as B

NOW = "2024-01-25 00:00:00+00:00"


def _cm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_memory")


def retry_entries(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose retry is due; a user who is no customer counts as done."""
    entries = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return B.due_entries(_queue(spark, d), entries, F.lit(NOW).cast("timestamp"))[0].select("id", "name", "attempts")


def retry_permanent(spark: SparkSession, d: str) -> DataFrame:
    q = _queue(spark, d)
    return B.permanently_failed(q).select("id", "attempts", F.lit("failed").alias("state")).unionByName(B.clear_permanent(q).select("id", "attempts", F.lit("kept").alias("state")))


def limit_stats(spark: SparkSession, d: str) -> DataFrame:
    """What the limiter did for each kind of event; with it switched off nothing is rejected."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    on = B.limit_stats(B.token_bucket(e, "user_id", "ts", "event_id", 2, 1 / 86400), "user_id").withColumn("enabled", F.lit(True))
    return on.unionByName(B.limit_stats(B.unlimited(e, "user_id", "event_id"), "user_id").withColumn("enabled", F.lit(False)))


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return measure.run_stats(table(spark, d, "events"), ["event_type"], "value")


def run_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of events whose mean grew by more than one per cent from the first half of the month to the second."""
    e = table(spark, d, "events").withColumn("late", F.dayofmonth("ts") > 15)
    part = lambda late: measure.run_stats(e.where(F.col("late") == late), ["event_type"], "value")
    return measure.regressions(part(False), part(True), "event_type", 1.0)


def parser_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that the index finds in generated sources of every language."""
    return measure.parser_runs(spark, functions=10, classes=3, runs=1).select("ext", "run", "symbols")


def first_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first three short paths of every session, in the order in which they first occur."""
    s = _cm(spark, d).where("session_id is not null").select("session_id", "id", paths.short_path(F.col("file_path")).alias("path"))
    first = s.groupBy("session_id", "path").agg(F.min("id").alias("first"))
    w = Window.partitionBy("session_id").orderBy("first")
    return first.withColumn("n", F.row_number().over(w)).where("n <= 3").select("session_id", "n", "path")


def budget_truncating(spark: SparkSession, d: str) -> DataFrame:
    """For every session its snippets in order, the last one shortened to what is left of a standard budget."""
    return budget.allocate_truncating(_cm(spark, d).where("session_id is not null"), "session_id", ["id"], "new_code")


def injection_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each code as one snippet under a heading, whether it fits a compact budget, and what would be left."""
    c = _cm(spark, d)
    used = budget.estimate_injection(F.col("file_path"), F.array("new_code"), F.lit("end"))
    return c.select("id", used.alias("tokens"), budget.fits(F.col("new_code"), "compact").alias("fits"), budget.remaining(used, "compact").alias("left"))


def project_of_files(spark: SparkSession, d: str) -> DataFrame:
    """The project each file lies in, by the deepest root above it."""
    roots = table(spark, d, "projects").select(F.col("root_path").alias("root"))
    hit = projects.detect(_cm(spark, d).select("id", "file_path"), roots)
    return hit.select("id", "root", projects.name(F.col("root")).alias("name"))


def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    """A cycle of every component of the slice that the ``graph_*`` queries have."""
    return graph.cycles(_e(spark, d)).select("component", F.col("nodes").cast("bigint").alias("nodes"), F.array_join("path", ">").alias("path"))


def graph_chains_all(spark: SparkSession, d: str) -> DataFrame:
    """Shortest chains of any length."""
    return graph.chains(_e(spark, d), _start(spark, d), None).select("dst", F.col("nodes").cast("bigint").alias("nodes"))


def graph_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependencies(_e(spark, d)).select("node", F.array_join("direct", ",").alias("direct"))


def call_graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(_calls(spark, d))


def hybrid_batch(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search for every project's words with the vector of one row each, all at once."""
    w = Window.orderBy("id")  # at most as many rows as there are projects
    vectors = _cm(spark, d).where("size(embedding) = 384 and not exists(embedding, x -> isnan(x))").select("id", F.col("embedding").alias("vector"))
    vectors = vectors.orderBy("id").limit(40).withColumn("i", F.row_number().over(w))
    q = table(spark, d, "projects").select(F.col("project").alias("query_id"), F.translate("project", "-", " ").alias("query"), F.row_number().over(Window.orderBy("project")).alias("i"))
    q = written(q.join(vectors.select("i", "vector"), "i", "left").drop("i"), "hybrid-queries")
    return search.batch_hybrid(_cm(spark, d), q).select("query_id", "n", "id", "fts_score", "semantic_score", "relevance")


QUERIES = {f.__name__: f for f in (retry_entries, retry_permanent, limit_stats, run_statistics, run_regressions, parser_benchmark, first_paths, budget_truncating, injection_estimates, project_of_files, graph_cycles, graph_chains_all,
    graph_dependencies, call_graph_cycles, hybrid_batch)}

from codestrata.plans.graph_queries import _E as _EDGES  # noqa: E402
from codestrata.plans.graph_queries import _S as _FIRST  # noqa: E402
from codestrata.plans.streaming_queries import _LIMITED, _Q  # noqa: E402

_M = memory_queries
_SPLIT = r"'[^\p{L}\p{N}]+'"
ORACLE = {
    "hybrid_batch": f"""WITH {_M._BASE}, qt AS (SELECT DISTINCT project AS query_id, unnest(list_filter(regexp_split_to_array(lower(project), {_SPLIT}), lambda t: t <> '')) AS term FROM projects),
  ps AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM r), c AS (SELECT id, dl, term, count(*) AS tf FROM ps WHERE term IN (SELECT term FROM qt) GROUP BY ALL), k AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
  s AS (SELECT query_id, id, round(-sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS rank FROM c JOIN k USING (term) JOIN qt USING (term), g GROUP BY ALL),
  lex AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS o FROM s) WHERE o <= 10),
  v AS (SELECT row_number() OVER (ORDER BY id) AS i, embedding AS v FROM code_memory WHERE {_M._USABLE} ORDER BY id LIMIT 40), q AS (SELECT query_id, v FROM (SELECT project AS query_id, row_number() OVER (ORDER BY project) AS i FROM projects) JOIN v USING (i)),
  cs AS (SELECT query_id, id, {_M._NRM.format('embedding')} AS na, {_M._NRM.format('v')} AS nb, list_sum(list_transform(list_zip(embedding[1:least(len(embedding), len(v))], v[1:least(len(embedding), len(v))]), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS dp FROM code_memory, q WHERE embedding IS NOT NULL),
  cc AS (SELECT query_id, id, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE ELSE dp / (na * nb) END, 6) AS score FROM cs), sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS o FROM cc WHERE NOT isnan(score)) WHERE o <= 10),
  j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, round(CASE WHEN rank IS NULL THEN 0.0::DOUBLE WHEN rank < 0 THEN least(1.0::DOUBLE, 1 / (1 + abs(rank))) ELSE least(1.0::DOUBLE, rank) END, 6) AS fts_score, round(coalesce(score, 0.0::DOUBLE), 6) AS semantic_score
    FROM lex a FULL JOIN sem b ON a.id = b.id AND a.query_id = b.query_id),
  f AS (SELECT *, round(0.4::DOUBLE * least(fts_score, 1.0::DOUBLE) + 0.6::DOUBLE * semantic_score, 6) AS relevance FROM j)
  SELECT query_id, n::INTEGER AS n, id, fts_score, semantic_score, relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS n FROM f WHERE relevance >= 0.3 OR fts_score > 0) WHERE n <= 5""",
    "retry_entries": f"WITH {_Q} SELECT q.id, c_name AS name, attempts FROM q JOIN customer ON c_custkey = q.id WHERE NOT permanent AND next_try <= TIMESTAMP '2024-01-25 00:00:00'",
    "retry_permanent": f"WITH {_Q} SELECT id, attempts, CASE WHEN permanent THEN 'failed' ELSE 'kept' END AS state FROM q",
    "limit_stats": f"""WITH RECURSIVE {_LIMITED}, s AS (SELECT user_id, accepted, true AS enabled FROM b UNION ALL SELECT user_id, true, false FROM events)
  SELECT user_id, enabled, count(*) AS requests, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, round(count(*) FILTER (accepted) / count(*)::DOUBLE, 6) AS share FROM s GROUP BY ALL""",
    "run_statistics": "SELECT event_type, count(value) AS runs, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1",
    "run_regressions": """WITH s AS (SELECT event_type, day(ts) > 15 AS late, round(avg(value), 6) AS mean FROM events GROUP BY ALL)
  SELECT a.event_type, a.mean AS before, b.mean AS after, round((b.mean - a.mean) * 100.0::DOUBLE / a.mean, 6) AS change FROM s a JOIN s b ON a.event_type = b.event_type AND NOT a.late AND b.late WHERE (b.mean - a.mean) * 100.0::DOUBLE / a.mean > 1""",
    "first_paths": """WITH s AS (SELECT session_id, id, string_split(file_path, '/') AS p, file_path FROM code_memory WHERE session_id IS NOT NULL),
  k AS (SELECT session_id, CASE WHEN len(p) > 3 THEN '.../' || array_to_string(p[-3:], '/') ELSE file_path END AS path, min(id) AS first FROM s GROUP BY ALL)
  SELECT session_id, n::INTEGER AS n, path FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS n FROM k) WHERE n <= 3""",
    "injection_estimates": """WITH t AS (SELECT id, CASE WHEN length(file_path) = 0 THEN 0 ELSE floor(length(file_path) / 4.5 * 1.1)::INTEGER + 1 END + CASE WHEN length(new_code) = 0 THEN 0 ELSE floor(length(new_code) / 4.0 * 1.1)::INTEGER + 1 END + 4 + floor(3 / 4.5 * 1.1)::INTEGER + 1 AS tokens, new_code FROM code_memory)
  SELECT id, tokens::INTEGER AS tokens, CASE WHEN length(new_code) = 0 THEN true ELSE floor(length(new_code) / 4.5 * 1.1) + 1 <= 1000 END AS fits, greatest(0, 1000 - tokens)::INTEGER AS "left" FROM t""",
    "project_of_files": r"""WITH f AS (SELECT id, regexp_replace(file_path, '[\\/]+', '/', 'g') AS p FROM code_memory), r AS (SELECT DISTINCT regexp_replace(regexp_replace(root_path, '[\\/]+', '/', 'g'), '(.)/$', '\1') AS root FROM projects)
  SELECT id, arg_max(root, length(root)) AS root, regexp_extract(arg_max(root, length(root)), '[^/]*$') AS name FROM f JOIN r ON starts_with(p, root || '/') GROUP BY id""",
    "graph_chains_all": f"WITH RECURSIVE {_EDGES}, b AS (SELECT {_FIRST} AS dst, 1 AS nodes UNION SELECT e.dst, b.nodes + 1 FROM b JOIN e ON e.src = b.dst WHERE b.nodes < 40) SELECT dst, min(nodes)::BIGINT AS nodes FROM b GROUP BY dst",
    "graph_dependencies": f"WITH {_EDGES} SELECT src AS node, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS direct FROM e GROUP BY src",
}
