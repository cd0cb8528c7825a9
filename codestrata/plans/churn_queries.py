"""Churn queries over edit_history and code_change, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import churn
from codestrata.session import table

AS_OF = "2025-06-15 12:00:00+00:00"

_H = "h AS (SELECT DISTINCT * FROM edit_history)"
_STATS = f"""{_H}, w AS (
  SELECT file_path, count(*) AS total_edits, min(timestamp) AS first_edit, max(timestamp) AS last_edit,
    count(*) FILTER (timestamp >= TIMESTAMPTZ '{AS_OF}' - INTERVAL 1 DAY) AS edits_24h,
    count(*) FILTER (timestamp >= TIMESTAMPTZ '{AS_OF}' - INTERVAL 7 DAY) AS edits_7d,
    count(*) FILTER (timestamp >= TIMESTAMPTZ '{AS_OF}' - INTERVAL 30 DAY) AS edits_30d
  FROM h WHERE timestamp <= TIMESTAMPTZ '{AS_OF}' GROUP BY file_path),
s AS (SELECT *, CASE WHEN edits_30d > 20 OR edits_24h >= 5 THEN 'red' WHEN edits_30d <= 2 THEN 'gold' WHEN edits_30d <= 10 THEN 'silver' ELSE 'bronze' END AS tier,
  CASE WHEN edits_30d = 0 THEN 0.0::DOUBLE ELSE least(edits_24h::DOUBLE / (edits_30d::DOUBLE / 30), 10.0::DOUBLE) END AS v FROM w),
f AS (SELECT *, CASE WHEN tier = 'red' THEN 'Consider refactoring this file - it has excessive churn'
  WHEN tier = 'bronze' AND v > 2 THEN 'Churn is accelerating - consider pausing to stabilize'
  WHEN tier = 'gold' THEN 'This file is stable - consider if changes are truly necessary' END AS action FROM s)"""


def _us(c: str):  # noqa: ANN202
    return F.unix_micros(c).alias(c)


def churn_file_stats(spark: SparkSession, d: str) -> DataFrame:
    s = churn.file_stats(table(spark, d, "edit_history"), AS_OF)
    return s.select("file_path", "total_edits", _us("first_edit"), _us("last_edit"), "edits_24h", "edits_7d", "edits_30d", "tier", "velocity", "action")


def churn_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return churn.hotspots(table(spark, d, "edit_history"), AS_OF).select("file_path", "edits_24h", "edits_30d", "tier", "velocity", "score")


def churn_tier_counts(spark: SparkSession, d: str) -> DataFrame:
    s = churn.file_stats(table(spark, d, "edit_history"), AS_OF)
    return s.groupBy("tier").agg(F.count("*").alias("files"), F.sum("total_edits").alias("edits")).withColumn("badge", churn.badge(F.col("tier")))


def churn_files_by_tier(spark: SparkSession, d: str) -> DataFrame:
    s = churn.file_stats(table(spark, d, "edit_history"), AS_OF).where("tier in ('red', 'bronze')")
    return s.select("tier", "file_path", "total_edits", "edits_30d")


def churn_function_stats(spark: SparkSession, d: str) -> DataFrame:
    s = churn.function_stats(table(spark, d, "edit_history"), AS_OF)
    return s.select("file_path", "signature_hash", "function_name", "edit_count", _us("last_edit"), "edits_24h", "recent_changes")


def churn_repetitive_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions with three edits or more within a year before the fixed time (no function of these data has as many in a day)."""
    s = churn.function_stats(table(spark, d, "edit_history"), AS_OF, days=365).where(F.col("edits_24h") >= churn.REPETITIVE)
    return s.select("file_path", "function_name", "signature_hash", F.col("edits_24h").alias("edits"))


def churn_recent_history(spark: SparkSession, d: str) -> DataFrame:
    return churn.recent_history(table(spark, d, "edit_history"), AS_OF).select("file_path", "n", "id", _us("timestamp"), "change_type")


def churn_rolling_24h(spark: SparkSession, d: str) -> DataFrame:
    return churn.rolling_edits(table(spark, d, "edit_history"))


def churn_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The warning for one more edit of every file of the log."""
    h = table(spark, d, "edit_history")
    return churn.warnings(h.groupBy("file_path").agg(F.min("id").alias("change_id")), h, AS_OF)


def churn_change_types(spark: SparkSession, d: str) -> DataFrame:
    """Edits by validated kind of change; unknown kinds are kept apart."""
    h = churn.history(table(spark, d, "edit_history"))
    kind = F.lower("change_type")
    known = F.when(kind.isin("add", "modify", "delete", "refactor"), kind).otherwise("unknown")
    return h.groupBy(known.alias("change_type")).agg(
        F.count("*").alias("edits"), F.countDistinct("file_path").alias("files"), F.countDistinct("session_id").alias("sessions"),
        F.count_if(F.unix_micros("recorded_at") - F.unix_micros("timestamp") > 86_400_000_000).alias("late"),
    )


QUERIES = {f.__name__: f for f in (churn_file_stats, churn_hotspots, churn_tier_counts, churn_files_by_tier, churn_function_stats, churn_repetitive_functions, churn_recent_history, churn_rolling_24h, churn_warnings, churn_change_types)}

_FUNCTIONS = f"""{_H}, e AS (SELECT *, row_number() OVER (PARTITION BY file_path, signature_hash ORDER BY timestamp DESC, id DESC) AS r,
    row_number() OVER (PARTITION BY file_path, signature_hash ORDER BY (function_name IS NULL), timestamp, id) AS a
  FROM h WHERE timestamp <= TIMESTAMPTZ '{AS_OF}' AND signature_hash IS NOT NULL)
SELECT file_path, signature_hash, min(function_name) FILTER (a = 1) AS function_name, count(*) AS edit_count, epoch_us(max(timestamp)) AS last_edit,
  count(*) FILTER (timestamp >= TIMESTAMPTZ '{AS_OF}' - INTERVAL 1 DAY) AS edits_24h,
  string_agg(change_type, ',' ORDER BY r) FILTER (r <= 10) AS recent_changes FROM e GROUP BY ALL"""

ORACLE = {
    "churn_file_stats": f"WITH {_STATS} SELECT file_path, total_edits, epoch_us(first_edit) AS first_edit, epoch_us(last_edit) AS last_edit, edits_24h, edits_7d, edits_30d, tier, round(v, 6) AS velocity, action FROM f",
    "churn_hotspots": f"""WITH {_STATS} SELECT file_path, edits_24h, edits_30d, tier, round(v, 6) AS velocity,
  round(edits_30d * (1.0::DOUBLE + v * 0.5) * (CASE tier WHEN 'gold' THEN 0.1 WHEN 'silver' THEN 0.5 WHEN 'bronze' THEN 1.0 ELSE 1.5 END)::DOUBLE, 6) AS score
  FROM f ORDER BY score DESC, file_path LIMIT 20""",
    "churn_tier_counts": f"""WITH {_STATS} SELECT tier, count(*) AS files, sum(total_edits)::BIGINT AS edits,
  CASE tier WHEN 'gold' THEN '🥇 GOLD (Stable - rarely changed)' WHEN 'silver' THEN '🥈 SILVER (Normal - moderate activity)'
  WHEN 'bronze' THEN '🥉 BRONZE (Active - high modification rate)' ELSE '🔴 RED (Hot - excessive churn detected)' END AS badge FROM f GROUP BY tier""",
    "churn_files_by_tier": f"WITH {_STATS} SELECT tier, file_path, total_edits, edits_30d FROM f WHERE tier IN ('red', 'bronze')",
    "churn_function_stats": f"WITH {_FUNCTIONS}",
    "churn_repetitive_functions": f"SELECT file_path, function_name, signature_hash, edits_24h AS edits FROM (WITH {_FUNCTIONS.replace('INTERVAL 1 DAY', 'INTERVAL 365 DAY')}) WHERE edits_24h >= 3",
    "churn_recent_history": f"""WITH {_H} SELECT file_path, n::INTEGER AS n, id, epoch_us(timestamp) AS timestamp, change_type FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY timestamp DESC, id DESC) AS n FROM h WHERE timestamp <= TIMESTAMPTZ '{AS_OF}') WHERE n <= 20""",
    "churn_rolling_24h": f"""WITH {_H}, u AS (SELECT id, file_path, epoch_us(timestamp) AS us FROM h)
  SELECT id, file_path, us, count(*) OVER (PARTITION BY file_path ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS edits FROM u""",
    "churn_warnings": f"""WITH {_STATS}, k AS (SELECT *, CASE WHEN tier = 'gold' AND first_edit <= TIMESTAMPTZ '{AS_OF}' - INTERVAL 1 DAY THEN 'gold_tier' WHEN tier = 'red' THEN 'red_tier' END AS warning FROM f)
  SELECT change_id, file_path, warning, CASE warning WHEN 'gold_tier' THEN 'warn' ELSE 'alert' END AS severity,
  CASE warning WHEN 'gold_tier' THEN 'This file is stable and rarely modified. Total edits: ' || total_edits ELSE 'This file has excessive churn (' || edits_30d || ' edits in 30 days).' END AS message
  FROM (SELECT file_path, min(id) AS change_id FROM edit_history GROUP BY 1) JOIN k USING (file_path) WHERE warning IS NOT NULL""",
    "churn_change_types": f"""WITH {_H} SELECT CASE WHEN lower(change_type) IN ('add', 'modify', 'delete', 'refactor') THEN lower(change_type) ELSE 'unknown' END AS change_type,
  count(*) AS edits, count(DISTINCT file_path) AS files, count(DISTINCT session_id) AS sessions,
  count(*) FILTER (epoch_us(recorded_at) - epoch_us(timestamp) > 86400000000) AS late FROM h GROUP BY 1""",
}
