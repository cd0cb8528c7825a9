"""Transcript ingest and code filter queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import code_filter, symbols
from codestrata.sources import transcripts
from codestrata.session import table


def transcript_entries(spark: SparkSession, d: str) -> DataFrame:
    e = transcripts.entry_text(transcripts.tool_call(transcripts.entries(table(spark, d, "transcripts"))))
    return e.select("file", "line_no", "shape", "tool", "text")


def transcript_changes(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.changes(table(spark, d, "transcripts")).select("file", "line_no", "file_path", "new_code", "old_code", "tool_type")


def transcript_context(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.changes(table(spark, d, "transcripts")).select("file", "line_no", "context")


def transcript_sessions(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.session_ids(table(spark, d, "transcripts"), "session_id", "line_no", F.col("file"))


def raw_entry_changes(spark: SparkSession, d: str) -> DataFrame:
    """Edits read back from the raw entries, beside those that were extracted."""
    cc = table(spark, d, "code_change")
    e = transcripts.changes(cc.select("change_id", F.lit(0).alias("n"), F.col("raw_entry").alias("line")), "change_id", "n")
    return e.select(F.col("file").alias("change_id"), "file_path", "new_code", "old_code", "tool_type")


def code_filter_memory(spark: SparkSession, d: str) -> DataFrame:
    cm = table(spark, d, "code_memory")
    path = F.col("file_path")
    return cm.select("id", code_filter.extension(path).alias("extension"), code_filter.is_code(path, F.col("new_code")).alias("is_code"))


def code_filter_content(spark: SparkSession, d: str) -> DataFrame:
    """Signs of code in documents, whose names tell nothing."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", code_filter.content_score(F.col("text")).alias("score"), code_filter.looks_like_code(F.col("text")).alias("is_code"))


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_memory").select("id", F.array_join(symbols.code_symbols(F.col("new_code")), ",").alias("symbols"))


def search_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_memory").select("id", symbols.search_terms(F.col("new_code"), F.col("file_path")).alias("terms"))


QUERIES = {f.__name__: f for f in (transcript_entries, transcript_changes, transcript_context, transcript_sessions, raw_entry_changes, code_filter_memory, code_filter_content, code_symbols, search_terms)}

_EXT = """CASE WHEN NOT contains(b, '.') THEN '' WHEN b LIKE '.%' AND len(p) = 2 THEN b WHEN ('.' || p[-2] || '.' || p[-1]) IN ({c}) THEN '.' || p[-1] ELSE lower(regexp_extract(regexp_replace(b, '^\\.+', ''), '(\\.[^.]+)$', 1)) END"""
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_score = lambda c: " + ".join([*[f"CASE WHEN regexp_matches({c}, '{p}') THEN 2 ELSE 0 END" for p in code_filter.STRONG], *[f"CASE WHEN regexp_matches({c}, '{p}') THEN 1 ELSE 0 END" for p in code_filter.WEAK],
    f"CASE WHEN (length({c}) - length(translate({c}, '{{}}[]', '')))::DOUBLE / greatest(length({c}), 1) > 0.02 THEN 1 ELSE 0 END"])
_looks = lambda c: rf"CASE WHEN length(regexp_replace({c}, '^\s+|\s+$', '', 'g')) < 20 THEN false WHEN regexp_matches(regexp_replace({c}, '^\s+', ''), '{code_filter.SHEBANGS}') THEN true ELSE {_score(c)} >= 2 END"
_TOOL = """CASE WHEN j->>'$.type' = 'tool_use' THEN '1' WHEN j->>'$.tool' IS NOT NULL THEN '2'
  WHEN json_type(j, '$.content') = 'ARRAY' AND len(list_filter(CAST(j->'$.content' AS JSON[]), lambda x: json_type(x) = 'OBJECT' AND x->>'$.type' = 'tool_use')) > 0 THEN '3'
  WHEN json_type(j, '$.message.content') = 'ARRAY' AND len(list_filter(CAST(j->'$.message.content' AS JSON[]), lambda x: json_type(x) = 'OBJECT' AND x->>'$.type' = 'tool_use')) > 0 THEN '3b'
  WHEN j->>'$.toolName' IS NOT NULL THEN '4' WHEN j->>'$.type' = 'response_item' AND j->>'$.payload.name' IS NOT NULL AND j->>'$.payload.type' IN ('function_call', 'custom_tool_call') THEN '5' END"""
_PICK = """CASE shape WHEN '1' THEN j->>'$.{n1}' WHEN '2' THEN j->>'$.{n2}' WHEN '3' THEN list_filter(CAST(j->'$.content' AS JSON[]), lambda x: json_type(x) = 'OBJECT' AND x->>'$.type' = 'tool_use')[1]->>'$.{n1}'
  WHEN '3b' THEN list_filter(CAST(j->'$.message.content' AS JSON[]), lambda x: json_type(x) = 'OBJECT' AND x->>'$.type' = 'tool_use')[1]->>'$.{n1}' WHEN '4' THEN j->>'$.{n4}' WHEN '5' THEN {n5} END"""
_ENTRIES = f"""l AS (SELECT {{f}} AS file, {{p}} AS line_no, trim({{c}}) AS t FROM {{r}}), o AS (SELECT file, line_no, CAST(t AS JSON) AS j FROM l WHERE t LIKE '{{{{%' AND json_valid(t)),
  s AS (SELECT *, {_TOOL} AS shape FROM o),
  e AS (SELECT *, {_PICK.format(n1='name', n2='tool', n4='toolName', n5="j->>'$.payload.name'")} AS tool,
    {_PICK.format(n1='input', n2='input', n4='toolInput', n5="CASE WHEN j->>'$.payload.type' = 'function_call' THEN j->>'$.payload.arguments' ELSE j->>'$.payload.input' END")} AS input,
    coalesce(j->>'$.text', CASE WHEN j->>'$.role' IN ('user', 'assistant', 'human') THEN CASE WHEN json_type(j, '$.content') = 'ARRAY' THEN
      array_to_string(list_transform(list_filter(CAST(j->'$.content' AS JSON[]), lambda x: x->>'$.type' = 'text'), lambda x: coalesce(x->>'$.text', '')), ' ') ELSE j->>'$.content' END END, CASE json_type(j, '$.message') WHEN 'OBJECT' THEN CASE WHEN json_type(j, '$.message.content') = 'ARRAY' THEN
      array_to_string(list_transform(list_filter(CAST(j->'$.message.content' AS JSON[]), lambda x: x->>'$.type' = 'text'), lambda x: coalesce(x->>'$.text', '')), ' ') ELSE j->>'$.message.content' END ELSE j->>'$.message' END) AS text FROM s)"""
_T = _ENTRIES.format(f="session_id", p="line_no", c="line", r="transcripts")
_R = _ENTRIES.format(f="change_id", p="0", c="raw_entry", r="code_change")
_CH = """g AS (SELECT *, coalesce(nullif(input->>'$.file_path', ''), nullif(input->>'$.path', '')) AS file_path, CASE WHEN tool = 'Write' THEN nullif(input->>'$.content', '') ELSE coalesce(nullif(input->>'$.new_string', ''), input->>'$.new') END AS new_code,
  CASE WHEN tool = 'Edit' THEN coalesce(nullif(input->>'$.old_string', ''), nullif(input->>'$.old', '')) END AS old_code FROM e WHERE tool IN ('Write', 'Edit'))"""

ORACLE = {
    "transcript_entries": f"WITH {_T} SELECT file, line_no, shape, tool, text FROM e",
    "transcript_changes": f"WITH {_T}, {_CH} SELECT file, line_no, file_path, new_code, old_code, tool AS tool_type FROM g WHERE file_path IS NOT NULL AND new_code IS NOT NULL",
    "raw_entry_changes": f"WITH {_R}, {_CH} SELECT file AS change_id, file_path, new_code, old_code, tool AS tool_type FROM g WHERE file_path IS NOT NULL AND new_code IS NOT NULL",
    "transcript_context": f"""WITH {_T}, {_CH}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS r FROM e),
  k AS (SELECT c.file, c.line_no, string_agg(x.text, chr(10) ORDER BY x.r) FILTER (x.text IS NOT NULL AND x.text <> '') AS t FROM (SELECT n.* FROM n JOIN g ON n.file = g.file AND n.line_no = g.line_no WHERE g.file_path IS NOT NULL AND g.new_code IS NOT NULL) c
    LEFT JOIN n x ON x.file = c.file AND (x.r BETWEEN c.r - 5 AND c.r - 1 OR x.r BETWEEN c.r + 1 AND c.r + 5 AND NOT EXISTS (SELECT 1 FROM n y WHERE y.file = c.file AND y.r BETWEEN c.r + 1 AND x.r AND y.tool IS NOT NULL)) GROUP BY ALL)
  SELECT file, line_no, CASE WHEN length(t) > 1000 THEN substring(t, 1, 1000) || '...' ELSE coalesce(t, '') END AS context FROM k""",
    "transcript_sessions": f"WITH {_T} SELECT file, coalesce(arg_min(coalesce(j->>'$.session_id', j->>'$.sessionId', CASE WHEN j->>'$.type' = 'session_meta' THEN j->>'$.payload.id' END), line_no), file) AS session FROM e GROUP BY file",
    "code_filter_memory": f"""WITH b AS (SELECT id, file_path, new_code, string_split(regexp_replace(file_path, '/+$', ''), '/')[-1] AS b FROM code_memory), x AS (SELECT *, string_split(b, '.') AS p FROM b), y AS (SELECT *, {_EXT.format(c=_list(code_filter.COMPOUND))} AS extension FROM x)
  SELECT id, extension, CASE WHEN {" OR ".join(f"contains(file_path, '{s}')" for s in code_filter.SKIP_PATHS)} THEN false WHEN contains(b, '.min.') THEN false WHEN b IN ({_list(code_filter.NAMES)}) THEN true
  WHEN extension IN ({_list(code_filter.SKIP)}) THEN false WHEN extension IN ({_list(code_filter.CODE)}) THEN true WHEN new_code IS NULL THEN false ELSE {_looks('new_code')} END AS is_code FROM y""",
    "code_filter_content": f"SELECT doc_id, ({_score('text')})::INTEGER AS score, {_looks('text')} AS is_code FROM documents WHERE text IS NOT NULL",
    "code_symbols": "SELECT id, array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(new_code, '{p}', 1)" for p in symbols.DEFINITIONS) + "]))), ',') AS symbols FROM code_memory",
    "search_terms": "WITH t AS (SELECT id, flatten([" + ", ".join(
        f"list_transform(list_zip(regexp_extract_all(new_code, '{p}', 1), regexp_extract_all(new_code, '{p}', 2)), lambda x: CASE WHEN x[1] <> '' THEN x[1] ELSE x[2] END)" if g == 2 else f"regexp_extract_all(new_code, '{p}', 1)" for p, g in symbols.SEARCHED
    ) + r", [CASE WHEN regexp_matches(string_split(file_path, '/')[-1], '^.+\.[^.]*$') THEN regexp_replace(string_split(file_path, '/')[-1], '\.[^.]*$', '') ELSE string_split(file_path, '/')[-1] END]]) AS l FROM code_memory)"
    " SELECT id, array_to_string(list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: length(x) > 2)[1:8], ' ') AS terms FROM t",
}
