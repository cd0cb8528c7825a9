"""Graph queries. The ``graph_*`` queries have SQL, which fixes their graph: a supplier
calls the supplier its largest first order lines point to. The ``call_graph_*`` queries
run the same operators over every call edge of the symbol index, without any filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import graph
from codestrata.session import table, written


def _e(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity >= 49 and l_linenumber = 1")
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    li = li.join(F.broadcast(n)).select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % F.col("n") + 1).alias("t"))
    return graph.edges(li, "s", "t")


def _start(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").agg(F.min("s_suppkey").alias("node"))


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_e(spark, d))


def graph_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(_e(spark, d))


def graph_leaves(spark: SparkSession, d: str) -> DataFrame:
    return graph.leaves(_e(spark, d))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(_e(spark, d))


def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes each node reaches, over the closure of the whole graph."""
    return graph.reach_counts(written(_e(spark, d), "graph-edges"))


def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    """Transitive callers of the node most call (the largest on a tie): the closure of the reversed graph from it."""
    e = _e(spark, d)
    called = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).agg(F.max_by("node", F.struct("n", "node")).alias("node"))
    return graph.closure(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), called).select(F.col("dst").alias("caller"))


def graph_chains(spark: SparkSession, d: str) -> DataFrame:
    return graph.chains(_e(spark, d), _start(spark, d)).select("dst", F.col("nodes").cast("bigint").alias("nodes"), F.array_join("path", ">").alias("path"))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    c = graph.components(_e(spark, d))
    return c.groupBy("component").agg(F.count("*").alias("members"), F.min("node").alias("least"))


def graph_recursive(spark: SparkSession, d: str) -> DataFrame:
    return graph.recursive(_e(spark, d))


def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """The call graph together with the graph of the second order lines."""
    li = table(spark, d, "lineitem").where("l_quantity >= 49 and l_linenumber = 2")
    return graph.merge(_e(spark, d), graph.edges(li, "l_suppkey", "l_orderkey"))


def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return graph.dot_lines(e, graph.leaves(e)).select("line")


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    """Edits of one function of a file followed by another in the same session: sites per pair."""
    from pyspark.sql import Window

    h = table(spark, d, "edit_history").dropDuplicates(["id"]).where("session_id is not null and function_name is not null")
    w = Window.partitionBy("session_id", "file_path").orderBy("timestamp", "id")
    h = h.select(F.col("function_name").alias("caller"), F.lead("function_name").over(w).alias("callee")).where("callee is not null and callee <> caller")
    return h.groupBy("caller", "callee").agg(F.count("*").alias("sites"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """All call edges of the index; parsed and written once, as the operators read them often."""
    from codestrata.plans import code_queries

    return written(graph.edges(code_queries.index_calls(spark, d), "src", "dst"), "call-edges")


def _first(e: DataFrame) -> DataFrame:
    return e.agg(F.min("src").alias("node")).where("node is not null")


def call_graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_calls(spark, d))


def call_graph_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(_calls(spark, d))


def call_graph_leaves(spark: SparkSession, d: str) -> DataFrame:
    return graph.leaves(_calls(spark, d))


def call_graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(_calls(spark, d))


def call_graph_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_calls(spark, d)).groupBy("src").agg(F.count("*").alias("reached"))


def call_graph_callers(spark: SparkSession, d: str) -> DataFrame:
    """Transitive callers of the name most call (the largest on a tie)."""
    e = _calls(spark, d)
    called = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).agg(F.max_by("node", F.struct("n", "node")).alias("node")).where("node is not null")
    return graph.closure(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), called).select(F.col("dst").alias("caller"))


def call_graph_chains(spark: SparkSession, d: str) -> DataFrame:
    e = _calls(spark, d)
    return graph.chains(e, _first(e)).select("dst", F.col("nodes").cast("bigint").alias("nodes"), F.array_join("path", ">").alias("path"))


def call_graph_components(spark: SparkSession, d: str) -> DataFrame:
    c = graph.components(_calls(spark, d))
    return c.groupBy("component").agg(F.count("*").alias("members"), F.min("node").alias("least"))


def call_graph_recursive(spark: SparkSession, d: str) -> DataFrame:
    return graph.recursive(_calls(spark, d))


def call_graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """All calls together with all imports between modules."""
    from codestrata.plans import code_queries

    return graph.merge(_calls(spark, d), graph.edges(code_queries.index_imports(spark, d), "src", "dst"))


def call_graph_dot(spark: SparkSession, d: str) -> DataFrame:
    e = _calls(spark, d)
    return graph.dot_lines(e, graph.leaves(e)).select("line")


QUERIES = {f.__name__: f for f in (graph_degrees, graph_entry_points, graph_leaves, graph_summary, graph_closure, graph_callers, graph_chains, graph_components, graph_recursive, graph_merge, graph_dot, call_sites,
    call_graph_degrees, call_graph_entry_points, call_graph_leaves, call_graph_summary, call_graph_closure, call_graph_callers, call_graph_chains, call_graph_components, call_graph_recursive, call_graph_merge, call_graph_dot)}

_E = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) + 1 AS dst FROM lineitem WHERE l_quantity >= 49 AND l_linenumber = 1)"
_N = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
_D = f"{_N}, d AS (SELECT node, (SELECT count(*) FROM e WHERE src = node) AS calls, (SELECT count(*) FROM e WHERE dst = node) AS called_by FROM n)"
_C = "c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"
_S = "(SELECT min(s_suppkey) FROM supplier)"

ORACLE = {
    "graph_degrees": f"WITH {_E}, {_D} SELECT * FROM d",
    "graph_entry_points": f"WITH {_E}, {_D} SELECT node FROM d WHERE called_by = 0",
    "graph_leaves": f"WITH {_E}, {_D} SELECT node FROM d WHERE calls = 0",
    "graph_summary": f"""WITH {_E}, {_D} SELECT count(*) AS nodes, sum(calls)::BIGINT AS edges, count(*) FILTER (called_by = 0) AS entry_points, count(*) FILTER (calls = 0) AS leaves, max(calls) AS most_calls, max(called_by) AS most_callers FROM d""",
    "graph_closure": f"WITH RECURSIVE {_E}, {_C} SELECT src, count(*) AS reached FROM c GROUP BY src",
    "graph_callers": f"WITH RECURSIVE {_E}, most AS (SELECT dst FROM e GROUP BY dst ORDER BY count(*) DESC, dst DESC LIMIT 1), k AS (SELECT src AS caller FROM e WHERE dst = (SELECT dst FROM most) UNION SELECT e.src FROM k JOIN e ON e.dst = k.caller) SELECT caller FROM k",
    "graph_chains": f"""WITH RECURSIVE {_E}, b AS (SELECT {_S} AS dst, 1 AS nodes UNION SELECT e.dst, b.nodes + 1 FROM b JOIN e ON e.src = b.dst WHERE b.nodes < 10),
  l AS (SELECT dst, min(nodes) AS nodes FROM b GROUP BY dst),
  p AS (SELECT dst, nodes, [dst] AS path FROM l WHERE nodes = 1 UNION ALL SELECT l.dst, l.nodes, min(list_append(p.path, l.dst)) FROM p JOIN e ON e.src = p.dst JOIN l ON l.dst = e.dst AND l.nodes = p.nodes + 1 GROUP BY l.dst, l.nodes)
  SELECT dst, nodes::BIGINT AS nodes, array_to_string(path, '>') AS path FROM p""",
    "graph_components": f"""WITH RECURSIVE {_E}, {_N}, {_C}, m AS (SELECT a.src AS node, a.dst AS other FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src UNION SELECT node, node FROM n),
  g AS (SELECT node, max(other) AS component FROM m GROUP BY node) SELECT component, count(*) AS members, min(node) AS least FROM g GROUP BY component""",
    "graph_recursive": f"WITH RECURSIVE {_E}, {_C} SELECT src AS node FROM c WHERE src = dst",
    "graph_merge": f"WITH {_E} SELECT src, dst FROM e UNION SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_linenumber = 2",
    "graph_dot": f"""WITH {_E}, {_D} SELECT '  "' || node || '" [color=red];' AS line FROM d WHERE calls = 0 UNION ALL SELECT '  "' || src || '" -> "' || dst || '";' FROM e""",
    "call_sites": """WITH h AS (SELECT DISTINCT * FROM edit_history), p AS (SELECT function_name AS caller, lead(function_name) OVER (PARTITION BY session_id, file_path ORDER BY timestamp, id) AS callee FROM h WHERE session_id IS NOT NULL AND function_name IS NOT NULL)
  SELECT caller, callee, count(*) AS sites FROM p WHERE callee IS NOT NULL AND callee <> caller GROUP BY ALL""",
}
