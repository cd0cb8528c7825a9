"""Edit churn: windows, tiers, velocity, hotspots, function statistics, warnings.

Everything is a function of the edit history and an explicit ``as_of``; nothing
is stored incrementally, so tiers are never stale. Rows delivered twice count
once. Windows include their lower boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tier boundaries (edits in 30 days), red from this many edits in 24 hours,
# repetitive from this many edits of one function in 24 hours, hotspot factors.
GOLD_MOST, SILVER_MOST, BRONZE_MOST, RED_24H, REPETITIVE = 2, 10, 20, 5, 3
TIER_FACTOR = {"gold": 0.1, "silver": 0.5, "bronze": 1.0, "red": 1.5}
DESCRIPTION = {
    "gold": "Stable - rarely changed",
    "silver": "Normal - moderate activity",
    "bronze": "Active - high modification rate",
    "red": "Hot - excessive churn detected",
}
BADGE = {"gold": "🥇", "silver": "🥈", "bronze": "🥉", "red": "🔴"}


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def history(edits: DataFrame) -> DataFrame:
    """The edit log with redelivered rows once."""
    return edits.dropDuplicates(["id"])


def _since(as_of: str, days: int) -> Column:
    return F.col("timestamp") >= ts(as_of) - F.expr(f"INTERVAL {days} DAYS")


def tier(d24: Column, d30: Column) -> Column:
    return (
        F.when((d30 > BRONZE_MOST) | (d24 >= RED_24H), "red").when(d30 <= GOLD_MOST, "gold").when(d30 <= SILVER_MOST, "silver").otherwise("bronze")
    )


def velocity(d24: Column, d30: Column) -> Column:
    """Edits of the last day over the daily mean of 30 days, at most 10."""
    return F.when(d30 == 0, 0.0).otherwise(F.least(d24 / (d30 / 30.0), F.lit(10.0)))


def hotspot_score(d24: Column, d30: Column, tier_: Column) -> Column:
    factor = F.coalesce(*[F.when(tier_ == k, F.lit(v)) for k, v in TIER_FACTOR.items()], F.lit(1.0))
    return d30 * (1.0 + velocity(d24, d30) * 0.5) * factor


def suggested_action(tier_: Column, speed: Column) -> Column:
    return (
        F.when(tier_ == "red", "Consider refactoring this file - it has excessive churn")
        .when((tier_ == "bronze") & (speed > 2.0), "Churn is accelerating - consider pausing to stabilize")
        .when(tier_ == "gold", "This file is stable - consider if changes are truly necessary")
    )


def badge(tier_: Column) -> Column:
    pick = lambda d: F.coalesce(*[F.when(tier_ == k, F.lit(v)) for k, v in d.items()])
    return F.concat(pick(BADGE), F.lit(" "), F.upper(tier_), F.lit(" ("), pick(DESCRIPTION), F.lit(")"))


def file_stats(edits: DataFrame, as_of: str) -> DataFrame:
    """One row per file: totals, windows, tier, velocity, action; one aggregation with map-side combining."""
    h = history(edits).where(F.col("timestamp") <= ts(as_of))
    s = h.groupBy("file_path").agg(
        F.count("*").alias("total_edits"),
        F.min("timestamp").alias("first_edit"),
        F.max("timestamp").alias("last_edit"),
        *[F.count_if(_since(as_of, d)).alias(n) for n, d in (("edits_24h", 1), ("edits_7d", 7), ("edits_30d", 30))],
    )
    d24, d30 = F.col("edits_24h"), F.col("edits_30d")
    s = s.withColumn("tier", tier(d24, d30)).withColumn("velocity", F.round(velocity(d24, d30), 6))
    return s.withColumn("action", suggested_action(F.col("tier"), velocity(d24, d30)))


def hotspots(edits: DataFrame, as_of: str, limit: int = 20) -> DataFrame:
    s = file_stats(edits, as_of)
    score = F.round(hotspot_score(F.col("edits_24h"), F.col("edits_30d"), F.col("tier")), 6)
    return s.withColumn("score", score).orderBy(F.desc("score"), "file_path").limit(limit)


def function_stats(edits: DataFrame, as_of: str, recent: int = 10, days: int = 1) -> DataFrame:
    """One row per (file, signature): edits, last edit, first name, the latest change types; ``edits_24h``
    counts the last ``days``.

    The latest are ranked with partial group limits, so a hot function sends only
    ``recent`` rows of each task through the shuffle.
    """
    h = history(edits).where((F.col("timestamp") <= ts(as_of)) & F.col("signature_hash").isNotNull())
    keys = ["file_path", "signature_hash"]
    stats = h.groupBy(*keys).agg(
        F.min_by("function_name", F.struct("timestamp", "id")).alias("function_name"),
        F.count("*").alias("edit_count"),
        F.max("timestamp").alias("last_edit"),
        F.count_if(_since(as_of, days)).alias("edits_24h"),
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), F.desc("id"))
    top = h.withColumn("n", F.row_number().over(w)).where(F.col("n") <= recent)
    kinds = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "change_type"))).alias("k"))
    kinds = kinds.select(*keys, F.array_join(F.transform("k", lambda x: x["change_type"]), ",").alias("recent_changes"))
    return stats.join(kinds, keys)


def recent_history(edits: DataFrame, as_of: str, limit: int = 20) -> DataFrame:
    """The latest ``limit`` edits of every file, newest first (ranked with partial group limits)."""
    h = history(edits).where(F.col("timestamp") <= ts(as_of))
    w = Window.partitionBy("file_path").orderBy(F.desc("timestamp"), F.desc("id"))
    return h.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def rolling_edits(edits: DataFrame, hours: int = 24) -> DataFrame:
    """For every edit the edits of its file in the ``hours`` before it (and at its time).

    The window is partitioned by file and stretch of ``hours``; every edit also goes
    into the next stretch as a mere predecessor, so a file with a third of all
    edits is spread over its stretches.
    """
    span = hours * 3_600_000_000
    h = history(edits).select("id", "file_path", F.unix_micros("timestamp").alias("us"))
    slot = F.floor(F.col("us") / span)
    h = h.withColumn("x", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("slot", slot + F.col("x"))
    w = Window.partitionBy("file_path", "slot").orderBy("us").rangeBetween(-span, 0)
    return h.withColumn("edits", F.count("*").over(w)).where("x = 0").select("id", "file_path", "us", "edits")


def warnings(pending: DataFrame, edits: DataFrame, as_of: str) -> DataFrame:
    """The first warning that holds for each pending edit: gold, then red (then repetitive, see classify)."""
    s = file_stats(edits, as_of).select("file_path", "tier", "first_edit", "total_edits", "edits_30d")
    age = F.col("first_edit") <= ts(as_of) - F.expr("INTERVAL 24 HOURS")
    kind = F.when((F.col("tier") == "gold") & age, "gold_tier").when(F.col("tier") == "red", "red_tier")
    message = F.when(kind == "gold_tier", F.concat(F.lit("This file is stable and rarely modified. Total edits: "), F.col("total_edits"))).when(
        kind == "red_tier", F.concat(F.lit("This file has excessive churn ("), F.col("edits_30d"), F.lit(" edits in 30 days)."))
    )
    severity = F.when(kind == "gold_tier", "warn").when(kind == "red_tier", "alert")
    return pending.join(s, "file_path").select("change_id", "file_path", kind.alias("warning"), severity.alias("severity"), message.alias("message")).where("warning is not null")
