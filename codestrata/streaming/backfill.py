"""Streaming parts: embedding backfill, live churn counters, the show-once gate, retries, rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.embed import embed
from codestrata.functions.paths import embedding_text, preprocess, shown_hash
from codestrata.operators.memory import priority
from codestrata.operators.timestamps import timed

# First and longest delay of a retry in seconds, attempts, buckets (capacity, tokens a second).
BASE_DELAY, MOST_DELAY, ATTEMPTS = 1.0, 60.0, 3
BUCKETS = {"gpu": (50, 10.0), "db": (100, 50.0)}


def source(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files at a path; the batch size is the back-pressure."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
        return reader.option("pathGlobFilter", p.getName()).parquet(path.rsplit("/", 1)[0])
    return reader.parquet(path)


def backfill_batch(rows: DataFrame, sessions: DataFrame, recent_after: Column, load: Callable | None = None) -> DataFrame:
    """(id, embedding, error, priority) of the rows without an embedding; ``sessions`` has their time zones."""
    todo = rows.where("embedding is null")
    text = preprocess(embedding_text(F.col("file_path"), F.col("new_code"), F.col("context")))
    todo = timed(todo, sessions).select("id", priority(recent_after).alias("priority"), text.alias("text"))
    return todo.withColumn("e", embed(F.col("text"), load)).select("id", "priority", F.col("e.vector").alias("embedding"), F.col("e.error").alias("error"))


def run_backfill(stream: DataFrame, sessions: DataFrame, out: str, checkpoint: str, recent_after: Column, load: Callable | None = None) -> None:
    """Embed what is there and stop. Each batch goes to its own folder, so a batch that is
    repeated after a failure replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        backfill_batch(batch, sessions, recent_after, load).repartitionByRange("priority", "id").write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def live_counts(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Running edit counts per file and kind (redelivered edits once within the watermark)."""
    s = stream.withWatermark("timestamp", "3650 days").dropDuplicatesWithinWatermark(["id"])
    g = s.groupBy("file_path", "change_type").agg(F.count("*").alias("edits"), F.max("timestamp").alias("last_edit"))

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = g.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def show_once(stream: DataFrame, out: str, checkpoint: str, horizon: str = "3650 days") -> None:
    """The first time that each (path, content) comes by within the horizon."""
    s = stream.withColumn("gate", shown_hash(F.col("file_path"), F.coalesce("function_name", F.lit(""))))
    s = s.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(["gate"]).select("gate", "file_path", "function_name")
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(stream: DataFrame, out: str, checkpoint: str, width: str = "1 day", lateness: str = "3650 days") -> None:
    """Events per type and tumbling window."""
    g = stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))

    def write(batch: DataFrame, n: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n", "value").write.mode("overwrite").parquet(out)

    q = g.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


# --- retries as a table -----------------------------------------------------------------


def backoff(attempt: Column, key: Column) -> Column:
    """Seconds to wait before the next try: doubled each time up to a minute, spread by the key's hash."""
    base = F.least(F.lit(MOST_DELAY), BASE_DELAY * F.pow(F.lit(2.0), attempt))
    return base * (0.5 + F.pmod(F.xxhash64(key), F.lit(1000)) / 1000.0)


def record_failures(queue: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """The queue (id, attempts, next_try, permanent) after failures (id) at ``now``."""
    f = failed.select("id", F.lit(1).alias("__f")).distinct()
    q = queue.join(f, "id", "full")
    n = F.coalesce("attempts", F.lit(0)) + F.when(F.col("__f") == 1, 1).otherwise(0)
    hit = F.col("__f") == 1
    late = F.when(hit, now + F.make_dt_interval(secs=backoff(n, F.col("id")).cast("decimal(18,6)"))).otherwise(F.col("next_try"))
    return q.select("id", n.alias("attempts"), late.alias("next_try"), F.coalesce(F.when(hit, n >= ATTEMPTS), F.col("permanent"), F.lit(False)).alias("permanent"))


def due(queue: DataFrame, now: Column) -> DataFrame:
    return queue.where((~F.col("permanent")) & (F.col("next_try") <= now))


def record_success(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("id"), "id", "left_anti")


def due_entries(queue: DataFrame, entries: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entries to embed again, the queue without ids that have no entry): an id that is gone counts as done."""
    d = due(queue, now).select("id", "attempts")
    known = entries.select("id").distinct()
    lost = d.join(known, "id", "left_anti")
    return entries.join(d, "id"), record_success(queue, lost)


def permanently_failed(queue: DataFrame) -> DataFrame:
    return queue.where("permanent")


def clear_permanent(queue: DataFrame) -> DataFrame:
    """The queue without the ids that will not be tried again."""
    return queue.where("not permanent")


def retry_stats(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(~F.col("permanent")).alias("retrying"), F.count_if("permanent").alias("failed"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))


# --- rate limit -------------------------------------------------------------------------


def token_bucket(requests: DataFrame, key: str, ts: str, order: str, capacity: int, rate: float) -> DataFrame:
    """Add ``accepted``: each request takes one token of its key's bucket if there is one.

    After a pause of capacity / rate seconds a bucket is full whatever came before,
    so the requests of a key split exactly at such pauses and a busy key is many
    small groups.
    """
    full = capacity / rate
    w = Window.partitionBy(key).orderBy(ts, order)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    s = requests.withColumn("__us", us)
    s = s.withColumn("__new", (F.coalesce(F.col("__us") - F.lag("__us").over(w), F.lit(1 << 60)) >= int(full * 1e6)).cast("int"))
    s = s.withColumn("__g", F.sum("__new").over(w))
    kind = {f.name: f.dataType.simpleString() for f in requests.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__us", order])
        have, last, out = float(capacity), None, []
        for t in pdf["__us"]:
            if last is not None:
                have = min(capacity, have + (t - last) / 1e6 * rate)
            last = t
            ok = have >= 1
            have -= ok
            out.append(bool(ok))
        return pd.DataFrame({key: pdf[key], order: pdf[order], "accepted": out})

    return s.groupBy(key, "__g").applyInPandas(run, f"{key} {kind[key]}, {order} {kind[order]}, accepted boolean")


def limit_stats(limited: DataFrame, key: str) -> DataFrame:
    """(key, requests, accepted, rejected, share) of limited requests."""
    a = limited.groupBy(key).agg(F.count("*").alias("requests"), F.count_if("accepted").alias("accepted"))
    return a.select("*", (F.col("requests") - F.col("accepted")).alias("rejected"), F.round(F.col("accepted") / F.col("requests"), 6).alias("share"))


def unlimited(requests: DataFrame, key: str, order: str) -> DataFrame:
    """The limiter switched off: every request is accepted."""
    return requests.select(key, order, F.lit(True).alias("accepted"))


def notify(events: DataFrame, kind: str, ts: str, order: str, seconds: float = 60.0) -> DataFrame:
    """Add ``accepted``: at most one notice of each kind in ``seconds`` (a bucket of one token)."""
    return token_bucket(events, kind, ts, order, 1, 1 / seconds)


# --- metrics ----------------------------------------------------------------------------


def cycle_rollup(cycles: DataFrame, last: int = 20) -> DataFrame:
    """Totals over all cycles (cycle, processed, failed, seconds) and means of the last ones."""
    total = cycles.agg(F.count("*").alias("cycles"), F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))
    recent = cycles.orderBy(F.desc("cycle")).limit(last).agg(F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.sum("seconds") / F.sum("processed"), 6).alias("seconds_per_row"))
    return total.join(F.broadcast(recent))


def milestones(daily: DataFrame, marks: tuple[int, ...] = (50, 75, 90, 100)) -> DataFrame:
    """(mark, day): the first day on which the coverage (day, total, embedded; running) reaches each mark."""
    c = daily.select("day", (F.col("embedded") * 100.0 / F.col("total")).alias("c"))
    m = c.select("day", F.explode(F.filter(F.array(*[F.lit(x) for x in marks]), lambda x: F.col("c") >= x)).alias("mark"))
    return m.groupBy("mark").agg(F.min("day").alias("day"))


def prometheus(metrics: DataFrame, prefix: str = "codestrata") -> DataFrame:
    """One text line for each column of a one-row frame of metrics."""
    pairs = F.array(*[F.concat(F.lit(f"{prefix}_{c} "), F.col(c).cast("string")) for c in metrics.columns])
    return metrics.select(F.explode(pairs).alias("line"))
