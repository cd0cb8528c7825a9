"""Chunk, classification, grouping and index queries. Python parsing has no SQL;
these are tested against small fixtures. Relational parts have SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import code_filter, paths
from codestrata.operators import chunking, churn, classify, index, modules, recall, timestamps
from codestrata.plans.churn_queries import AS_OF
from codestrata.plans.clock_sql import clock
from codestrata.plans.ingest_queries import _EXT, _list
from codestrata.session import spread, table, written


def _cm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_memory")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.timed(_cm(spark, d), table(spark, d, "sessions"))


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(spread(_cm(spark, d).select("id", "file_path", "new_code")), "id", "file_path", "new_code")


def generic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.generic_chunks(_cm(spark, d), "id", "new_code").select("id", "block", "start", "end", "lines")


def change_classes(spark: SparkSession, d: str) -> DataFrame:
    return classify.changes(spread(table(spark, d, "code_change").select("change_id", "file_path", "old_code", "new_code")), "change_id")


def change_history(spark: SparkSession, d: str) -> DataFrame:
    return classify.history_rows(classify.changes(table(spark, d, "code_change"), "change_id"), "change_id")


def repetitive_changes(spark: SparkSession, d: str) -> DataFrame:
    """Edits to functions that many edits of the log touched in a day."""
    stats = churn.function_stats(table(spark, d, "edit_history"), AS_OF)
    return classify.repetitive_warnings(classify.changes(table(spark, d, "code_change"), "change_id"), stats, "change_id")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of every session, the newest first, grouped by likeness."""
    cm = _cm(spark, d).where("session_id is not null")
    return chunking.group_snippets(cm, "session_id", "id", "file_path", "new_code", F.element_at(F.split("file_path", r"\."), -1), F.length("new_code"))


def greedy_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def group_labels(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("new_code")
    kind = F.when(c.rlike(r"(?m)^\s*(?:export\s+|pub\s+)*(?:class|struct|interface|type)\s"), "class").when(c.rlike(r"\b(?:def|function|func|fn)\s+\w|=>\s*\{"), "function").when(c.rlike(r"(?m)^(?:import|from|use|#include)\b"), "imports").otherwise("block")
    g = _groups(spark, d).join(_cm(spark, d).select("id", "file_path", kind.alias("kind")), "id")
    return chunking.group_labels(g, "session_id", "kind", "file_path")


def rendered_results(spark: SparkSession, d: str) -> DataFrame:
    t = chunking.render(F.col("file_path"), F.col("new_code"), F.lit(0.5), F.col("context"))
    return _cm(spark, d).select("id", t.alias("markdown"))


def injections(spark: SparkSession, d: str) -> DataFrame:
    """For every session the text to inject: its snippets by relevance for the file it edited last, whole ones within
    a standard budget; the project is the session's."""
    from codestrata.functions import relevance
    from codestrata.operators import budget

    cm = written(_timed(spark, d).where("session_id is not null").drop("embedding"), "injection-rows")  # read twice
    root = table(spark, d, "sessions").join(table(spark, d, "projects"), "project").select("session_id", F.col("root_path").alias("root"))
    last = cm.groupBy("session_id").agg(F.max_by("file_path", F.struct("at_us", "id")).alias("current"))
    cm = cm.join(last, "session_id").join(root, "session_id", "left")
    as_of = F.lit(AS_OF).cast("timestamp")
    score = relevance.combine(relevance.recency(F.timestamp_micros("at_us"), as_of), relevance.proximity(F.col("file_path"), F.col("current")), F.lit(0.5), relevance.project(F.col("file_path"), F.col("root")))
    s = cm.select("session_id", "id", "file_path", "new_code", "context", F.round(score, 6).alias("score"))
    s = s.select("session_id", "id", (-F.col("score")).alias("o"), chunking.render(F.col("file_path"), F.col("new_code"), F.col("score"), F.col("context")).alias("markdown"), paths.estimate_block(F.col("new_code")).alias("tokens"))
    taken = budget.skip_fold(s, "session_id", ["o", "id"], F.col("tokens"), budget.TIERS["standard"] - budget.OVERHEAD, budget.MOST_SNIPPET)
    w = Window.partitionBy("session_id").orderBy("o", "id")
    top = s.withColumn("n", F.row_number().over(w)).join(taken.select("session_id", "n"), ["session_id", "n"])
    out = top.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "markdown"))).alias("l"), F.sum("tokens").alias("tokens"))
    return out.select("session_id", F.size("l").alias("snippets"), "tokens", F.array_join(F.transform("l", lambda x: x["markdown"]), "\n\n").alias("text"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return index.facts(spread(index.latest_files(_timed(spark, d))))


def index_symbols(spark: SparkSession, d: str) -> DataFrame:
    return index.facts_table(_parsed(spark, d), "symbols")


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return index.index_stats(_parsed(spark, d))


def index_search(spark: SparkSession, d: str) -> DataFrame:
    return index.search_symbols(index.facts_table(_parsed(spark, d), "symbols"), "signal").select("file_path", "qualified_name", "kind", "start_line")


def index_exports(spark: SparkSession, d: str) -> DataFrame:
    return index.module_exports(index.facts_table(_parsed(spark, d), "symbols"))


def index_hover(spark: SparkSession, d: str) -> DataFrame:
    return index.hover(index.facts_table(_parsed(spark, d), "symbols"))


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = written(_parsed(spark, d), "index-facts")  # parsed once, read three times
    return tuple(index.facts_table(p, w) for w in ("symbols", "references", "scopes"))


def index_definitions(spark: SparkSession, d: str) -> DataFrame:
    s, r, c = _three(spark, d)
    return index.definitions(r, s, c)


def index_references(spark: SparkSession, d: str) -> DataFrame:
    s, r, _ = _three(spark, d)
    return index.references_to(s, r)


def index_reference_rows(spark: SparkSession, d: str) -> DataFrame:
    s, r, _ = _three(spark, d)
    return index.reference_rows(s, r)


def _call_sites(r: DataFrame) -> DataFrame:
    return r.where("is_call").select(F.concat_ws(":", "file_path", "start_line", "start_col").alias("pos_id"), "file_path", F.col("start_line").alias("line"), F.col("start_col").alias("col")).distinct()


def index_hover_at(spark: SparkSession, d: str) -> DataFrame:
    """Hover at every call and every declaration."""
    s, r, _ = _three(spark, d)
    return index.hover_at(_sites(s, r), s, r)


def _sites(s: DataFrame, r: DataFrame) -> DataFrame:
    here = s.select(F.concat_ws(":", "file_path", "start_line", "start_col").alias("pos_id"), "file_path", F.col("start_line").alias("line"), F.col("start_col").alias("col"))
    return _call_sites(r).unionByName(here).distinct()


def index_references_at(spark: SparkSession, d: str) -> DataFrame:
    """The uses of what is declared at every declaration."""
    s, r, _ = _three(spark, d)
    return index.references_at(_sites(s, r.limit(0)), s, r)


def index_signature_help(spark: SparkSession, d: str) -> DataFrame:
    s, r, _ = _three(spark, d)
    return index.signature_help(_sites(s, r), s, r)


def index_files(spark: SparkSession, d: str) -> DataFrame:
    """How much of every file could be read."""
    return index.completeness(index.facts_table(_parsed(spark, d), "files"))


def index_import_groups(spark: SparkSession, d: str) -> DataFrame:
    return index.imports_by_module(index.facts_table(_parsed(spark, d), "symbols"))


def index_unused(spark: SparkSession, d: str) -> DataFrame:
    s, r, _ = _three(spark, d)
    return index.unused(s, r)


def index_positions(spark: SparkSession, d: str) -> DataFrame:
    """What stands at the start of every call, and in which scope."""
    s, r, c = _three(spark, d)
    p = _call_sites(r)
    return index.entity_at(p, s, r).join(index.scope_at(p, c).withColumnRenamed("kind", "scope_kind"), "pos_id")


def index_types(spark: SparkSession, d: str) -> DataFrame:
    return index.infer_types(index.facts_table(_parsed(spark, d), "symbols"))


def index_calls(spark: SparkSession, d: str) -> DataFrame:
    return index.call_edges(index.facts_table(_parsed(spark, d), "calls"))


def index_imports(spark: SparkSession, d: str) -> DataFrame:
    return index.import_edges(index.facts_table(_parsed(spark, d), "symbols"))


def index_changed(spark: SparkSession, d: str) -> DataFrame:
    """Files to parse again when the index holds the first version of every path."""
    cm = _timed(spark, d)
    first = cm.groupBy("file_path").agg(F.min_by("new_code", F.struct("at_us", "id")).alias("code")).select("file_path", paths.content_hash(F.col("code")).alias("hash"))
    return index.changed_files(index.latest_files(cm), first).select("file_path", "hash")


def module_exports(spark: SparkSession, d: str) -> DataFrame:
    p = written(_parsed(spark, d), "index-facts")
    return modules.exported_names(index.facts_table(p, "symbols"), index.facts_table(p, "all_names"))


def module_imports(spark: SparkSession, d: str) -> DataFrame:
    """Where every imported name is defined, through stars and re-exports."""
    p = written(_parsed(spark, d), "index-facts")
    return modules.resolve(index.facts_table(p, "symbols"), index.facts_table(p, "all_names"))


def recall_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text shown before every extracted edit: search, chunk, score, group, budget, render."""
    pending = table(spark, d, "code_change")
    r = recall.recall(_timed(spark, d), pending, F.lit(AS_OF).cast("timestamp"), F.lit("/srv/work/kestrel-relay"))
    return recall.hook_text(r, pending)


def code_outlines(spark: SparkSession, d: str) -> DataFrame:
    return index.outlines(_cm(spark, d), "id", "file_path", "new_code")


QUERIES = {f.__name__: f for f in (code_chunks, generic_chunks, change_classes, change_history, repetitive_changes, greedy_groups, group_labels, rendered_results, injections, index_symbols, index_summary, index_search,
    index_exports, index_hover, index_definitions, index_references, index_reference_rows, index_hover_at, index_references_at, index_signature_help, index_files, index_import_groups, index_unused, index_positions, index_types, index_calls, index_imports, index_changed, module_exports, module_imports, recall_texts, code_outlines)}

_FENCE = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in (
    (".py", "python"), (".js", "javascript"), (".ts", "typescript"), (".tsx", "tsx"), (".jsx", "jsx"), (".rs", "rust"), (".go", "go"), (".java", "java"), (".rb", "ruby"), (".sh", "bash"), (".sql", "sql"), (".c", "c"), (".cpp", "cpp")))
ORACLE = {
    "rendered_results": f"""WITH b AS (SELECT *, string_split(regexp_replace(file_path, '/+$', ''), '/')[-1] AS b, string_split(file_path, '/') AS f, string_split(new_code, chr(10)) AS l, replace(CASE WHEN length(context) > 200 THEN substring(context, 1, 200) || '...' ELSE context END, chr(10), ' ') AS note FROM code_memory),
  x AS (SELECT *, string_split(b, '.') AS p FROM b), y AS (SELECT *, {_EXT.format(c=_list(code_filter.COMPOUND))} AS e FROM x)
  SELECT id, '### ' || CASE WHEN len(f) > 3 THEN '.../' || array_to_string(f[-3:], '/') ELSE file_path END || ' (50% relevant)' || chr(10) || CASE WHEN length(note) > 0 THEN '> ' || note || chr(10) ELSE '' END || '```' || CASE e {_FENCE} ELSE '' END || chr(10)
    || CASE WHEN len(l) > 30 THEN array_to_string(l[:15], chr(10)) || chr(10) || chr(10) || '    # ... (' || (len(l) - 30) || ' lines omitted) ...' || chr(10) || chr(10) || array_to_string(l[-15:], chr(10)) ELSE new_code END || chr(10) || '```' AS markdown FROM y""",
    "generic_chunks": r"""WITH l AS (SELECT id, unnest(string_split(new_code, chr(10))) AS line, generate_subscripts(string_split(new_code, chr(10)), 1) AS i FROM code_memory),
  b AS (SELECT id, i, regexp_replace(line, '\s', '', 'g') = '' AS blank FROM l), r AS (SELECT *, count(*) FILTER (blank) OVER (PARTITION BY id ORDER BY i) AS g FROM b),
  k AS (SELECT id, g, min(i) AS s, max(i) AS e, count(*) AS lines FROM r WHERE NOT blank GROUP BY id, g)
  SELECT id, (row_number() OVER (PARTITION BY id ORDER BY g))::INTEGER AS block, s::INTEGER AS start, e::INTEGER AS "end", lines FROM k""",
    "index_changed": rf"""WITH {clock("code_memory", "id")}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY us NULLS FIRST, id) AS n, count(*) OVER (PARTITION BY file_path) AS last FROM code_memory JOIN clk ON k = id),
  p AS (SELECT file_path, any_value(new_code) FILTER (n = 1) AS a, any_value(new_code) FILTER (n = last) AS b FROM r WHERE regexp_matches(lower(file_path), '[^/.]\.(py|js|jsx|mjs|cjs|ts|tsx|rs|go|c|h|cc|cpp|hpp|cxx)$') GROUP BY 1)
  SELECT file_path, left(sha256(b), 16) AS hash FROM p WHERE a <> b""",
}
