"""Streaming queries, run until their input is exhausted; the results are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import embed
from codestrata.plans.clock_sql import clock
from codestrata.session import shared_dir, table
from codestrata.streaming import backfill as B

RECENT = "2025-06-01 00:00:00+00:00"


def _dirs(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def stream_backfill(spark: SparkSession, d: str) -> DataFrame:
    out, cp = _dirs(spark)
    B.run_backfill(B.source(spark, f"{d}/code_memory.parquet"), table(spark, d, "sessions"), out, cp, F.lit(RECENT).cast("timestamp"))
    r = spark.read.parquet(out)
    return r.select("id", "priority", F.size("embedding").alias("dim"), F.col("error").isNotNull().alias("failed"))


def stream_churn(spark: SparkSession, d: str) -> DataFrame:
    out, cp = _dirs(spark)
    B.live_counts(B.source(spark, f"{d}/edit_history.parquet"), out, cp)
    return spark.read.parquet(out).select("file_path", "change_type", "edits", F.unix_micros("last_edit").alias("last_edit"))


def stream_show_once(spark: SparkSession, d: str) -> DataFrame:
    out, cp = _dirs(spark)
    B.show_once(B.source(spark, f"{d}/edit_history.parquet"), out, cp)
    return spark.read.parquet(out).select("file_path", "function_name")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    out, cp = _dirs(spark)
    s = B.source(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    B.windowed_counts(s, out, cp)
    return spark.read.parquet(out).select(F.unix_micros("start").alias("start"), "event_type", "n", "value")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """A retry queue from the events: every user's costly errors are attempts, their last time the next try."""
    e = table(spark, d, "events").where("event_type = 'error' and value > 120")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.count("*").cast("int").alias("attempts"), F.max(F.col("ts").cast("timestamp")).alias("next_try")).withColumn("permanent", F.col("attempts") >= B.ATTEMPTS)


def retry_stats(spark: SparkSession, d: str) -> DataFrame:
    return B.retry_stats(_queue(spark, d))


def retry_due(spark: SparkSession, d: str) -> DataFrame:
    return B.due(_queue(spark, d), F.lit("2024-01-20 00:00:00+00:00").cast("timestamp")).select("id", "attempts")


def retry_failures(spark: SparkSession, d: str) -> DataFrame:
    """The queue after all users of nation 7's customers failed again."""
    failed = table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("id"))
    return B.record_failures(_queue(spark, d), failed, F.lit("2024-02-01 00:00:00+00:00").cast("timestamp")).select("id", "attempts", "permanent")


def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events through a bucket of two tokens, one more each day."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return B.token_bucket(e, "user_id", "ts", "event_id", 2, 1 / 86400)


def _cycles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("cycle")).agg(F.count("*").alias("processed"), F.count_if(F.col("value") > 90).alias("failed"), F.sum("value").alias("seconds"))


def cycle_rollup(spark: SparkSession, d: str) -> DataFrame:
    return B.cycle_rollup(_cycles(spark, d))


def metrics_lines(spark: SparkSession, d: str) -> DataFrame:
    return B.prometheus(B.cycle_rollup(_cycles(spark, d)).select("cycles", "processed", "failed"))


def coverage_milestones(spark: SparkSession, d: str) -> DataFrame:
    """When the share of edits whose function is known first reached each mark, day by day."""
    from pyspark.sql import Window

    h = table(spark, d, "edit_history").dropDuplicates(["id"]).groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"), F.count("function_name").alias("k"))
    w = Window.orderBy("day")  # one row per day
    run = h.select("day", F.sum("n").over(w).alias("total"), F.sum("k").over(w).alias("embedded"))
    return B.milestones(run).select("mark", F.col("day").cast("string").alias("day"))


def blob_codec(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings through the packed form and back."""
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", "embedding", embed.pack_column("embedding").alias("blob"))
    back = p.select("vec_id", F.length("blob").alias("bytes"), embed.unpack_column("blob").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", "bytes", F.get("v", 0).cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"), F.round(total, 5).alias("total"))


QUERIES = {f.__name__: f for f in (stream_backfill, stream_churn, stream_show_once, stream_windows, retry_stats, retry_due, retry_failures, rate_limited, cycle_rollup, metrics_lines, coverage_milestones, blob_codec)}

_Q = "q AS (SELECT user_id AS id, count(*)::INTEGER AS attempts, max(ts) AS next_try, count(*) >= 3 AS permanent FROM events WHERE event_type = 'error' AND value > 120 GROUP BY 1)"
_Y = "y AS (SELECT date_trunc('hour', ts) AS cycle, count(*) AS processed, count(*) FILTER (value > 90) AS failed, sum(value) AS seconds FROM events GROUP BY 1)"

_LIMITED = """e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  b AS (SELECT user_id, event_id, t, n, true AS accepted, 1.0::DOUBLE AS have FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.t, e.n, least(2.0::DOUBLE, b.have + (e.t - b.t) / 1e6::DOUBLE * (1 / 86400::DOUBLE)) >= 1,
      least(2.0::DOUBLE, b.have + (e.t - b.t) / 1e6::DOUBLE * (1 / 86400::DOUBLE)) - CASE WHEN least(2.0::DOUBLE, b.have + (e.t - b.t) / 1e6::DOUBLE * (1 / 86400::DOUBLE)) >= 1 THEN 1 ELSE 0 END FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)"""

ORACLE = {
    "rate_limited": f"WITH RECURSIVE {_LIMITED} SELECT user_id, event_id, accepted FROM b",
    "stream_backfill": f"WITH {clock('code_memory', 'id')} SELECT id, (CASE WHEN us > epoch_us(TIMESTAMPTZ '{RECENT}') THEN 0 ELSE 1 END)::INTEGER AS priority, 384::INTEGER AS dim, false AS failed FROM code_memory JOIN clk ON k = id WHERE embedding IS NULL",
    "stream_churn": "SELECT file_path, change_type, count(*) AS edits, epoch_us(max(timestamp)) AS last_edit FROM (SELECT DISTINCT * FROM edit_history) GROUP BY ALL",
    "stream_show_once": "SELECT DISTINCT file_path, coalesce(function_name, NULL) AS function_name FROM edit_history",
    "stream_windows": "SELECT epoch_us(date_trunc('day', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "retry_stats": f"WITH {_Q} SELECT count(*) FILTER (NOT permanent) AS retrying, count(*) FILTER (permanent) AS failed, coalesce(sum(attempts), 0)::BIGINT AS attempts FROM q",
    "retry_due": f"WITH {_Q} SELECT id, attempts FROM q WHERE NOT permanent AND next_try <= TIMESTAMP '2024-01-20 00:00:00'",
    "retry_failures": f"""WITH {_Q}, f AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 7), j AS (SELECT coalesce(q.id, f.id) AS id, coalesce(attempts, 0) + (f.id IS NOT NULL)::INTEGER AS attempts, f.id IS NOT NULL AS hit, permanent FROM q FULL JOIN f ON q.id = f.id)
  SELECT id, attempts::INTEGER AS attempts, CASE WHEN hit THEN attempts >= 3 ELSE coalesce(permanent, false) END AS permanent FROM j""",
    "cycle_rollup": f"""WITH {_Y}, l AS (SELECT * FROM y ORDER BY cycle DESC LIMIT 20) SELECT (SELECT count(*) FROM y) AS cycles, (SELECT sum(processed)::BIGINT FROM y) AS processed, (SELECT sum(failed)::BIGINT FROM y) AS failed, round(avg(seconds), 6) AS mean_seconds, round(sum(seconds) / sum(processed), 6) AS seconds_per_row FROM l""",
    "metrics_lines": f"WITH {_Y} SELECT unnest(['codestrata_cycles ' || count(*), 'codestrata_processed ' || sum(processed)::BIGINT, 'codestrata_failed ' || sum(failed)::BIGINT]) AS line FROM y",
    "coverage_milestones": """WITH h AS (SELECT (timestamp AT TIME ZONE 'UTC')::DATE AS day, count(*) AS n, count(function_name) AS k FROM (SELECT DISTINCT * FROM edit_history) GROUP BY 1), r AS (SELECT day, sum(k) OVER (ORDER BY day) * 100.0 / sum(n) OVER (ORDER BY day) AS c FROM h)
  SELECT mark, min(day)::VARCHAR AS day FROM r, (VALUES (50), (75), (90), (100)) m(mark) WHERE c >= mark GROUP BY mark""",
    "blob_codec": "SELECT vec_id, (4 * len(embedding))::INTEGER AS bytes, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings",
}
