"""The code memory as a table: lookups, listings, statistics, changes, migration, backlog.

Changes return the new table (copy on write); nothing is updated in place. What orders
or compares by time takes a memory with ``at_us`` (see ``timestamps.timed``): the texts
of ``timestamp`` come in many formats and zones and do not sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTED = ["id", "file_path", "timestamp", "session_id"]


def get(memory: DataFrame, key: str) -> DataFrame:
    """Point lookup; the predicate reaches the Parquet scan."""
    return memory.where(F.col("id") == key)


def newest(memory: DataFrame, limit: int) -> DataFrame:
    """Latest first; rows whose text names no time come last."""
    return memory.orderBy(F.desc_nulls_last("at_us"), "id").limit(limit)


def of_session(memory: DataFrame, session_id: str) -> DataFrame:
    return memory.where(F.col("session_id") == session_id).orderBy(F.asc_nulls_last("at_us"), "id")


def path_search(memory: DataFrame, pattern: str, limit: int | None = None, case_sensitive: bool = False) -> DataFrame:
    """LIKE on the path; % and _ keep their meaning."""
    like = F.col("file_path").like(f"%{pattern}%") if case_sensitive else F.col("file_path").ilike(f"%{pattern}%")
    hits = memory.where(like)
    return hits if limit is None else newest(hits, limit)


def with_embeddings(memory: DataFrame) -> DataFrame:
    return memory.where("embedding is not null")


def clear(memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the emptied table, one row with the number of rows ``cleared``); for the memory and the edit log alike."""
    return memory.limit(0), memory.agg(F.count("*").alias("cleared"))


def stats(memory: DataFrame) -> DataFrame:
    """All figures in one aggregation."""
    return memory.agg(
        F.count("*").alias("total"), F.count("embedding").alias("with_embeddings"), F.countDistinct("file_path").alias("files"),
        F.countDistinct("session_id").alias("sessions"), F.min("at_us").alias("oldest"), F.max("at_us").alias("newest"),
    )


def coverage(memory: DataFrame) -> DataFrame:
    """Share of rows with an embedding in per cent, 0 for an empty table."""
    s = memory.agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))
    return s.withColumn("coverage", F.round(F.coalesce(F.try_divide(F.col("embedded") * 100.0, F.col("total")), F.lit(0.0)), 6))


def store(memory: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows that may be appended: the first of each (file_path, timestamp), none that is stored already."""
    w = Window.partitionBy("file_path", "timestamp").orderBy("id")
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.join(memory.select("file_path", "timestamp"), ["file_path", "timestamp"], "left_anti")


def delete(memory: DataFrame, ids: DataFrame) -> DataFrame:
    return memory.join(ids.select("id"), "id", "left_anti")


def update_embedding(memory: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with the embeddings of ``vectors`` (id, embedding) in place of their own."""
    v = vectors.select("id", F.col("embedding").alias("__e"))
    return memory.join(v, "id", "left").withColumn("embedding", F.coalesce("__e", "embedding")).drop("__e")


def export(memory: DataFrame) -> DataFrame:
    """All rows oldest first without embeddings."""
    return memory.withColumn("embedding", F.lit(None).cast("array<float>")).orderBy(F.asc_nulls_last("at_us"), "id")


def migration_plan(source: DataFrame, target: DataFrame, batch: int = 100) -> DataFrame:
    """Rows of ``source`` that ``target`` lacks, in numbered batches."""
    left = source.join(target.select("id"), "id", "left_anti")
    return number_batches(left, [F.col("id")], batch)


def migration_report(source: DataFrame, target: DataFrame) -> DataFrame:
    """Counts of migrated, skipped and all rows and the success rate."""
    known = target.select("id", F.lit(1).alias("__t"))
    s = source.select("id").join(known, "id", "left").agg(F.count("*").alias("total"), F.count("__t").alias("skipped"))
    s = s.withColumn("migrated", F.col("total") - F.col("skipped"))
    return s.withColumn("success_rate", F.round(F.coalesce(F.try_divide(F.col("migrated") + F.col("skipped"), F.col("total")) * 100, F.lit(0.0)), 6))


def validate_sample(source: DataFrame, target: DataFrame, n: int = 5) -> DataFrame:
    """A reproducible sample of embeddings and whether the copies agree."""
    s = with_embeddings(source).orderBy(F.md5("id"), "id").limit(n).select("id", F.col("embedding").alias("a"))
    return s.join(target.select("id", F.col("embedding").alias("b")), "id", "left").select("id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def number_batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Add ``batch`` from 1 in the given order without one global window: ranges are
    sorted apart and their counts, one row per range, give each its start."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    local = parts.withColumn("__n", F.col("__i") - F.shiftleft(F.col("__p").cast("bigint"), 33) + 1)
    counts = local.groupBy("__p").agg(F.count("*").alias("__c"))
    starts = counts.withColumn("__s", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__s")
    # one row for each partition of the range exchange
    return local.join(F.broadcast(starts), "__p").withColumn("batch", F.ceil((F.col("__s") + F.col("__n")) / size)).drop("__p", "__i", "__n", "__s")


def backlog(memory: DataFrame, recent_after: Column, limit: int | None = None) -> DataFrame:
    """Rows without an embedding, those after the instant ``recent_after`` first, newest first within both."""
    rows = memory.where("embedding is null").withColumn("priority", priority(recent_after))
    rows = rows.orderBy("priority", F.desc_nulls_last("at_us"), "id")
    return rows if limit is None else rows.limit(limit)


def priority(recent_after: Column) -> Column:
    """0 for rows after the instant, 1 for older ones and those without a time."""
    return F.when(F.col("at_us") > F.unix_micros(recent_after), 0).otherwise(1)
