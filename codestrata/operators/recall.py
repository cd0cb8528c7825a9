"""Recall before a write: search, chunk, score, group, fit to a budget, render; for many pending edits at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths, relevance, symbols
from codestrata.operators import budget, chunking, search
from codestrata.session import written

# Results per edit, most shown, groups from this size, groups above this size as a summary line.
FETCH, SHOWN, GROUPED, SUMMARY_FROM, INDIVIDUAL = 10, 5, 2, 3, 3


def pending_terms(pending: DataFrame) -> DataFrame:
    """(query_id, query) of pending edits (change_id, file_path, new_code)."""
    return pending.select(F.col("change_id").alias("query_id"), symbols.search_terms(F.col("new_code"), F.col("file_path")).alias("query"))


def score_hits(hits: DataFrame, as_of: Column, root: Column) -> DataFrame:
    """Hits (query_id, id, file_path, at, current) with their relevance, which all chunks of a hit share; weak ones are dropped."""
    score = relevance.combine(relevance.recency(F.col("at"), as_of), relevance.proximity(F.col("file_path"), F.col("current")), F.lit(0.5), relevance.project(F.col("file_path"), root))
    return hits.withColumn("score", F.round(score, 6)).where(F.col("score") >= relevance.LEAST).select("query_id", "id", "score")


def chunked(memory: DataFrame, scored: DataFrame) -> DataFrame:
    """(query_id, id, score, file_path, chunk_no, code, kind, name): the chunks of the scored hits; a row found by many queries is chunked once."""
    found = memory.join(scored.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    parts = chunking.chunks(found, "id", "file_path", "new_code").select("id", "chunk_no", "code", "kind", "name")
    return scored.join(parts.join(memory.select("id", "file_path").dropDuplicates(["id"]), "id"), "id")


_ENTRY = [("rank", pa.int32()), ("size", pa.int32()), ("score", pa.float64()), *[(x, pa.string()) for x in ("file_path", "code", "name", "kind")], ("files", pa.list_(pa.string()))]


def _entries(rows: list[dict], threshold: float, shown: int) -> list[tuple]:
    """The first ``shown`` entries of one query, whose chunks come by falling score and then by key."""
    alone, many = [], []
    for at in [[i] for i in range(len(rows))] if len(rows) <= INDIVIDUAL else chunking.groups_in_turn(rows, threshold):
        (many if len(at) >= GROUPED else alone).append([rows[i] for i in at])
        if len(alone) == shown:  # groups come by falling score and single chunks before others: these are shown
            break
    out = []
    for xs in (alone + many)[:shown]:
        head = [x for x in xs if x["score"] == xs[0]["score"]][-1]
        b, i = head["at"]
        out.append((len(out) + 1, len(xs), head["score"], head["path"], b.column("code")[i].as_py(), b.column("name")[i].as_py(), head["kind"], list(dict.fromkeys(x["path"] for x in xs))))
    return out


def summarise(scored: DataFrame, threshold: float = 0.7, shown: int = SHOWN) -> DataFrame:
    """(query_id, rank, text, score, size): up to ``INDIVIDUAL`` chunks pass as they are; more are
    grouped greedily, groups become one entry, single chunks come first.

    The chunks of a query meet in one task, in order; only the entries that are shown leave it."""
    kind = scored.schema["query_id"].dataType.simpleString()
    s = scored.repartition("query_id").withColumn("key", F.concat_ws("|", "query_id", "id", F.format_string("%05d", "chunk_no")))
    s = s.sortWithinPartitions("query_id", F.desc("score"), "key")
    s = s.select("query_id", "score", "file_path", "code", "name", "kind", F.coalesce(paths.normalise_shape(F.col("code")), F.lit("")).alias("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, out, schema = None, [], [], None
        for b in batches:
            schema = pa.schema([("query_id", b.schema.field("query_id").type), *_ENTRY])
            for i, (query, *x) in enumerate(zip(*[b.column(c).to_pylist() for c in ("query_id", "score", "file_path", "kind", "norm")], strict=True)):
                if rows and query != current:
                    out += [(current, *e) for e in _entries(rows, threshold, shown)]
                    rows = []
                current = query
                rows.append(dict(zip(("score", "path", "kind", "norm"), x, strict=True), at=(b, i)))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, e, strict=True)) for e in out], schema)
                out = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (current, *e), strict=True)) for e in _entries(rows, threshold, shown)], schema)

    e = s.mapInArrow(run, f"query_id {kind}, rank int, size int, score double, file_path string, code string, name string, kind string, files array<string>")
    # the first distinct short paths, the best scored first
    files = F.array_distinct(F.transform("files", lambda x: paths.short_path(x)))
    single = chunking.render(F.col("file_path"), F.col("code"), F.col("score"), F.lit(None).cast("string"))
    note = F.format_string("Pattern type: %s | Similar occurrences: %d | Example: %s", F.col("kind"), F.col("size"), F.col("name"))
    text = F.when(F.col("size") < GROUPED, single).when(F.col("size") >= SUMMARY_FROM, F.concat(F.lit("### "), note, F.lit("\n"), F.array_join(F.slice(files, 1, 3), ", "))).otherwise(F.concat(single, F.lit("\n"), note))
    return e.select("query_id", "rank", text.alias("text"), "score", "size")


def inject(entries: DataFrame, tier: str = "standard") -> DataFrame:
    """(query_id, snippets, groups, tokens, text): entries in order while they fit, larger ones skipped; the few of a
    query (:func:`summarise`) are one list."""
    e = entries.withColumn("tokens", paths.estimate_tokens(F.col("text"), "summary").cast("int"))
    lists = e.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "size", "tokens", "text"))).alias("l"))
    start = F.struct(F.lit(budget.TIERS[tier]).alias("left"), F.expr("cast(array() as array<int>)").alias("taken"))
    taken = F.aggregate("l", start, lambda acc, x: F.when(x["tokens"] <= acc["left"], F.struct((acc["left"] - x["tokens"]).alias("left"), F.concat(acc["taken"], F.array(x["rank"])).alias("taken"))).otherwise(acc))["taken"]
    k = lists.withColumn("taken", taken).select("query_id", F.filter("l", lambda x: F.array_contains("taken", x["rank"])).alias("l")).where(F.size("l") > 0)
    text = F.array_join(F.transform("l", lambda x: x["text"]), "\n\n")
    n = lambda test: F.size(F.filter("l", test)).cast("bigint")
    out = k.select("query_id", n(lambda x: x["size"] < GROUPED).alias("snippets"), n(lambda x: x["size"] >= GROUPED).alias("groups"), text.alias("text"))
    return out.select("query_id", "snippets", "groups", paths.estimate_tokens(F.col("text"), "mixed").alias("tokens"), "text")


def recall(memory: DataFrame, pending: DataFrame, as_of: Column, root: Column, fallback: bool = False) -> DataFrame:
    """The text to show before each pending edit; edits for which nothing is relevant have no row, or with
    ``fallback`` the previews of their first hits (no counts).
    ``memory`` has ``at_us``, the instant of each row."""
    hits = search.many_bm25(memory, pending_terms(pending), FETCH)
    r = hits.join(memory.select("id", "file_path", F.timestamp_micros("at_us").alias("at")), "id")
    r = r.join(pending.select(F.col("change_id").alias("query_id"), F.col("file_path").alias("current")), "query_id")
    # searched and scored once, without code: what follows reads them several times
    r = written(r, "recall-hits")
    shown = inject(summarise(chunked(memory, score_hits(r, as_of, root))))
    if not fallback:
        return shown
    shown = written(shown, "recall-shown")
    none = F.lit(None).cast("bigint")
    first = r.where(F.col("n") <= PREVIEWS).join(shown.select("query_id"), "query_id", "left_anti")
    more = previews(first.join(memory.select("id", "new_code"), "id"), shown).select("query_id", none.alias("snippets"), none.alias("groups"), paths.estimate_tokens(F.col("text"), "mixed").alias("tokens"), "text")
    return shown.unionByName(more)


PREVIEWS, PREVIEW_CHARS = 3, 400


def previews(hits: DataFrame, injected: DataFrame) -> DataFrame:
    """(query_id, text): for edits with hits (query_id, n, file_path, new_code) of which none was relevant enough,
    the beginnings of the first three, each short path once. The marked length is what a preview is."""
    rest = hits.where(F.col("n") <= PREVIEWS).join(injected.select("query_id"), "query_id", "left_anti")
    short = paths.short_path(F.coalesce("file_path", F.lit("unknown")))
    one = rest.groupBy("query_id", short.alias("p")).agg(F.min(F.struct("n", "new_code")).alias("x"))
    code = F.coalesce("x.new_code", F.lit(""))
    text = F.concat(F.lit("**From:** `"), "p", F.lit("`\n```\n"), F.substring(code, 1, PREVIEW_CHARS), F.when(F.length(code) > PREVIEW_CHARS, "\n... (truncated)").otherwise(""), F.lit("\n```\n"))
    listed = one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("x.n", text.alias("t")))).alias("l"))
    return listed.select("query_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def hook_text(injections: DataFrame, pending: DataFrame) -> DataFrame:
    """(change_id, text): wrapped with what is being done to which file."""
    p = pending.select(F.col("change_id").alias("query_id"), "file_path", "tool_type")
    action = F.when(F.col("tool_type") == "Write", "creating").otherwise("editing")
    head = F.concat(F.lit('<memory context="You are '), action, F.lit(" "), F.element_at(F.split("file_path", "/"), -1), F.lit('">\nPreviously written similar code:\n\n'))
    return injections.join(p, "query_id").select(F.col("query_id").alias("change_id"), F.concat(head, "text", F.lit("\n</memory>")).alias("text"))
