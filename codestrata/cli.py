"""Command line over a store of Parquet tables: ``python -m codestrata.cli --store DIR VERB ...``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codestrata")
    p.add_argument("--store", required=True, help="folder with code_memory.parquet and edit_history.parquet")
    p.add_argument("--json", action="store_true")
    v = p.add_subparsers(dest="verb", required=True)
    s = v.add_parser("search")
    s.add_argument("query")
    s.add_argument("-l", "--limit", type=int, default=5)
    s.add_argument("-t", "--threshold", type=float, default=0.3)
    s.add_argument("-p", "--path")
    i = v.add_parser("ingest")
    i.add_argument("directory", nargs="?")
    i.add_argument("out", help="folder for the new rows")
    i.add_argument("-f", "--file", help="one transcript instead of a directory")
    i.add_argument("-d", "--dir", help="the directory, as an option")
    i.add_argument("-v", "--verbose", action="store_true", help="print how many rows were stored")
    i.add_argument("--no-embeddings", action="store_true")
    x = v.add_parser("clear")
    x.add_argument("out", help="folder for the emptied code_memory")
    x.add_argument("-y", "--yes", action="store_true", help="do not ask")
    v.add_parser("stats")
    e = v.add_parser("export")
    e.add_argument("-o", "--out", required=True)
    r = v.add_parser("recent")
    r.add_argument("-l", "--limit", type=int, default=10)
    c = v.add_parser("churn")
    c.add_argument("file")
    c.add_argument("-H", "--history", action="store_true")
    c.add_argument("--history-limit", type=int, default=20)
    c.add_argument("-f", "--functions", action="store_true")
    h = v.add_parser("hotspots")
    h.add_argument("-l", "--limit", type=int, default=20)
    f = v.add_parser("files")
    f.add_argument("--tier", choices=["gold", "silver", "bronze", "red"])
    f.add_argument("-l", "--limit", type=int, default=50)
    for x in (c, h, f):
        x.add_argument("--as-of", default=datetime.now(timezone.utc).isoformat())
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    from codestrata.functions import code_filter, embed, paths
    from codestrata.operators import churn, memory, search, timestamps
    from codestrata.session import table
    from codestrata.sources import transcripts

    cm = lambda: table(spark, a.store, "code_memory")
    eh = lambda: table(spark, a.store, "edit_history")

    def timed() -> DataFrame:
        try:
            zones = table(spark, a.store, "sessions")
        except AnalysisException:  # a store without sessions: texts without a zone are UTC
            zones = spark.createDataFrame([], "session_id string, client_zone string")
        return timestamps.timed(cm(), zones)

    if a.verb == "search":
        hits = search.hybrid(cm(), a.query, embed.hash_embed(a.query), a.limit, a.threshold, a.path)
        return hits.join(cm().select("id", "file_path"), "id").orderBy(F.desc("relevance"), "id")
    if a.verb == "stats":
        return memory.stats(timed())
    if a.verb == "recent":
        return memory.newest(timed(), a.limit).select(*memory.LISTED)
    if a.verb == "export":
        memory.export(timed()).drop("at_us").write.mode("errorifexists").json(a.out)
        return None
    if a.verb == "ingest":
        ch = transcripts.changes(transcripts.read_lines(spark, a.file or a.dir or a.directory).select(F.col("path").alias("session_id"), F.col("pos").alias("line_no"), "line"))
        ch = ch.where(code_filter.is_code(F.col("file_path"), F.col("new_code")))
        new = ch.select(F.expr("uuid()").alias("id"), "file_path", "old_code", "new_code", "context", "timestamp", F.col("file").alias("session_id"))
        e = embed.embed(paths.preprocess(paths.embedding_text(F.col("file_path"), F.col("new_code"), F.col("context"))))["vector"]
        new = memory.store(cm(), new).withColumn("embedding", F.lit(None).cast("array<float>") if a.no_embeddings else e)
        new.write.mode("append").parquet(a.out)
        return spark.read.parquet(a.out).agg(F.count("*").alias("stored")) if a.verbose else None
    if a.verb == "clear":
        if not a.yes and input("Remove all rows? [y/N] ").strip().lower() != "y":
            return None
        left, n = memory.clear(cm())
        left.write.mode("errorifexists").parquet(a.out)
        return n
    if a.verb == "churn":
        if a.history:
            return churn.recent_history(eh().where(F.col("file_path") == a.file), a.as_of, a.history_limit)
        if a.functions:
            return churn.function_stats(eh().where(F.col("file_path") == a.file), a.as_of).orderBy(F.desc("edit_count"), "signature_hash")
        return churn.file_stats(eh().where(F.col("file_path") == a.file), a.as_of)
    if a.verb == "hotspots":
        return churn.hotspots(eh(), a.as_of, a.limit)
    s = churn.file_stats(eh(), a.as_of)
    return (s.where(F.col("tier") == a.tier) if a.tier else s).orderBy(F.desc("edits_30d"), "file_path").limit(a.limit)


def main(argv: list[str] | None = None) -> int:
    from codestrata.session import make_session

    a = parser().parse_args(argv)
    out = run(make_session(), a)
    if out is not None:
        if a.json:
            for line in out.toJSON().toLocalIterator():
                print(line)
        else:
            out.show(1000, 100)
    return 0


if __name__ == "__main__":
    sys.exit(main())
