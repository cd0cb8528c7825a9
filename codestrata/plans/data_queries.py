"""Queries of the general data problems (the llm ones are in codestrata.llm)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import timestamps
from codestrata.plans.clock_sql import clock
from codestrata.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(table(spark, d, "code_memory"), table(spark, d, "code_change"), table(spark, d, "sessions"))


def p1_status(spark: SparkSession, d: str) -> DataFrame:
    """How many texts of each relation were exact, ambiguous, skipped or no time."""
    zones = table(spark, d, "sessions").select("session_id", "client_zone")
    cm = table(spark, d, "code_memory").select(F.lit("code_memory").alias("rel"), "timestamp", "session_id")
    cc = table(spark, d, "code_change").select(F.lit("code_change").alias("rel"), "timestamp", "session_id")
    rows = timestamps.normalise(cm.unionByName(cc).join(zones, "session_id", "left"), "timestamp", "client_zone")
    return rows.groupBy("rel", "status").agg(F.count("*").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_status": p1_status}
_BOTH = [("code_memory", "id"), ("code_change", "change_id::VARCHAR")]

ORACLE = {
    "p1_status": " UNION ALL ".join(f"SELECT * FROM (WITH {clock(rel, key)} SELECT '{rel}' AS rel, status, count(*) AS n FROM clk GROUP BY status)" for rel, key in _BOTH),
    "p1_found": " UNION ALL ".join(f"SELECT * FROM (WITH {clock(rel, key)} SELECT '{rel}' AS rel, k AS row_id, us AS utc_us FROM clk WHERE us IS NOT NULL)" for rel, key in _BOTH),
}
