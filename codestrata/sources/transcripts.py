"""Transcript lines to code changes.

Six shapes of tool calls are probed in a fixed order by built-in JSON functions;
malformed lines are dropped, positions are kept. A change gets the texts of the
neighbouring entries (up to five before; after it, up to the next tool call).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTEXT_CHARS = 1000


def read_lines(spark: SparkSession, directory: str, since: str | None = None) -> DataFrame:
    """(path, modified, pos, line) of all ``*.jsonl`` files below a directory.

    A file is split into lines by the scan of whole texts, so ``pos`` is exact; files
    that cannot be read are left out.
    """
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("ignoreCorruptFiles", "true")
    if since:
        r = r.option("modifiedAfter", since)
    files = r.text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    return files.select("path", "modified", F.posexplode(F.split("value", "\n")).alias("pos", "line"))


def entries(lines: DataFrame, group: str = "session_id", pos: str = "line_no") -> DataFrame:
    """Lines that hold a JSON object, with ``pos`` numbered without gaps within the group."""
    t = F.trim("line")
    ok = lines.where(t.startswith("{") & F.try_parse_json(t).isNotNull()).select(F.col(group).alias("file"), F.col(pos).alias("line_no"), t.alias("j"))
    return ok


def _j(path: str) -> Column:
    return F.get_json_object("j", path)


def tool_call(df: DataFrame) -> DataFrame:
    """Add ``tool`` and ``input`` (JSON text, or plain text for a patch); null if the entry is no call."""
    items = "array<struct<type:string,name:string,input:string>>"
    first = lambda p: F.filter(F.from_json(_j(p), items), lambda x: x["type"] == "tool_use")[0]
    df = df.withColumns({"__3": first("$.content"), "__3b": first("$.message.content")})
    payload, kind = _j("$.payload.name"), _j("$.payload.type")
    envelope = (_j("$.type") == "response_item") & payload.isNotNull() & kind.isin("function_call", "custom_tool_call")
    shapes = [
        (_j("$.type") == "tool_use", _j("$.name"), _j("$.input")),
        (_j("$.tool").isNotNull(), _j("$.tool"), F.coalesce(_j("$.input"), F.col("j"))),
        (F.col("__3").isNotNull(), F.col("__3.name"), F.col("__3.input")),
        (F.col("__3b").isNotNull(), F.col("__3b.name"), F.col("__3b.input")),
        (_j("$.toolName").isNotNull(), _j("$.toolName"), _j("$.toolInput")),
        (envelope, payload, F.when(kind == "function_call", _j("$.payload.arguments")).otherwise(_j("$.payload.input"))),
    ]
    shape, tool, value = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (test, t, i) in reversed(list(zip(("1", "2", "3", "3b", "4", "5"), shapes, strict=True))):
        shape, tool, value = F.when(test, name).otherwise(shape), F.when(test, t).otherwise(tool), F.when(test, i).otherwise(value)
    return df.withColumns({"shape": shape, "tool": tool, "input": value}).drop("__3", "__3b")


def _words(path: str) -> Column:
    """The words at a path: a string as it is, or the text parts of a list."""
    raw = _j(path)
    parts = F.from_json(raw, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(parts, lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return F.when(raw.startswith("["), listed).otherwise(raw)


def entry_text(df: DataFrame) -> DataFrame:
    """Add ``text``: ``text``, else a message's words, else null. Of a wrapped
    message the words count, not its JSON."""
    said = F.when(_j("$.role").isin("user", "assistant", "human"), _words("$.content"))
    wrapped = F.when(_j("$.message").startswith("{"), _words("$.message.content")).otherwise(_j("$.message"))
    return df.withColumn("text", F.coalesce(_j("$.text"), said, wrapped))


def entry_time() -> Column:
    return F.coalesce(*[_j(f"$.{k}") for k in ("timestamp", "created_at", "time", "ts")])


def session_ids(lines: DataFrame, group: str, pos: str, stem: Column) -> DataFrame:
    """(file, session): of the first entry's session_id, sessionId or session_meta payload, else the file's stem."""
    e = entries(lines, group, pos)
    own = F.coalesce(_j("$.session_id"), _j("$.sessionId"), F.when(_j("$.type") == "session_meta", _j("$.payload.id")))
    first = e.groupBy("file").agg(F.min_by(own, "line_no").alias("s"))
    return first.select("file", F.coalesce("s", stem).alias("session"))


def with_context(e: DataFrame, reach: int = 5, stretch: int = 4096) -> DataFrame:
    """Add ``context``: texts of up to ``reach`` entries before, and after up to the next tool call.

    The entries of a file are looked at in stretches of line numbers, so a file with a third
    of all lines is many tasks. The first and last ``reach`` entries of each stretch have
    neighbours beyond it: these few and theirs are put in order for the whole file.
    """
    item = F.struct(F.col("text").alias("t"), F.col("tool").isNotNull().alias("c"))

    def near(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("line_no")
        return rows.withColumns({"__b": F.collect_list(item).over(w.rowsBetween(-reach, -1)), "__a": F.collect_list(item).over(w.rowsBetween(1, reach))})

    parts = ["file", "__s"]
    rows = e.withColumn("__s", F.floor(F.col("line_no") / stretch))
    rows = rows.withColumns({"__r": F.row_number().over(Window.partitionBy(*parts).orderBy("line_no")), "__n": F.count("*").over(Window.partitionBy(*parts))})
    inner = lambda n: (F.col("__r") > n) & (F.col("__r") <= F.col("__n") - n)
    border = near(rows.where(~inner(2 * reach)), ["file"]).where(~inner(reach))  # with all neighbours of what is kept
    e = near(rows, parts).where(inner(reach)).unionByName(border).drop("__s", "__r", "__n")
    stop = F.array_position(F.transform("__a", lambda x: x["c"]), True).cast("int")
    after = F.when(stop == 0, F.col("__a")).otherwise(F.slice("__a", F.lit(1), stop - 1))
    said = F.filter(F.transform(F.concat("__b", after), lambda x: x["t"]), lambda x: x.isNotNull() & (x != ""))
    text = F.array_join(said, "\n")
    cut = F.when(F.length(text) > CONTEXT_CHARS, F.concat(F.substring(text, 1, CONTEXT_CHARS), F.lit("..."))).otherwise(text)
    return e.withColumn("context", cut).drop("__b", "__a")


def parse_patch(text: str) -> list[tuple[str, str, str | None, str]]:
    """(path, new, old, tool) of every file that a patch adds lines to."""
    out = []
    path = mode = None
    new: list[str] = []
    old: list[str] = []
    headers = {"*** Update File: ": "Edit", "*** Add File: ": "Write", "*** Delete File: ": None}
    for line in [*text.splitlines(), "*** Delete File: "]:
        kind = next((h for h in headers if line.startswith(h)), None)
        if kind:
            added = "\n".join(new).strip("\n")
            if path and added:
                out.append((path, added, "\n".join(old).strip("\n") or None, mode))
            path, mode = (line[len(kind) :].strip(), headers[kind]) if headers[kind] else (None, None)
            new, old = [], []
        elif path and line[:1] == "+" and line[:3] != "+++":
            new.append(line[1:])
        elif path and line[:1] == "-" and line[:3] != "---":
            old.append(line[1:])
    return out


def changes(lines: DataFrame, group: str = "session_id", pos: str = "line_no") -> DataFrame:
    """(file, line_no, file_path, new_code, old_code, tool_type, context, timestamp) of all edits in order of arrival."""
    e = with_context(entry_text(tool_call(entries(lines, group, pos))))
    i = lambda k: F.nullif(F.get_json_object("input", f"$.{k}"), F.lit(""))
    path = F.coalesce(i("file_path"), i("path"))
    base = ["file", "line_no", "context", entry_time().alias("timestamp")]
    keyed = F.coalesce(i("new_string"), F.get_json_object("input", "$.new"))
    new = F.when(F.col("tool") == "Write", i("content")).when(F.col("tool") == "Edit", keyed)
    plain = e.where(F.col("tool").isin("Write", "Edit")).select(
        *base, path.alias("file_path"), new.alias("new_code"), F.when(F.col("tool") == "Edit", F.coalesce(i("old_string"), i("old"))).alias("old_code"), F.col("tool").alias("tool_type")
    )
    plain = plain.where("file_path is not null and new_code is not null")

    def patches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["file", "line_no", "context", "timestamp", "file_path", "new_code", "old_code", "tool_type"]
        for pdf in batches:
            rows = [(r.file, r.line_no, r.context, r.timestamp, *c) for r in pdf.itertuples() for c in parse_patch(r.patch or "")]
            yield pd.DataFrame(rows, columns=cols)

    patch = F.when(F.col("input").startswith("{"), F.coalesce(i("patch"), i("input"), i("text"))).otherwise(F.col("input"))
    p = e.where("tool = 'apply_patch'").select(*base, patch.alias("patch"))
    kind = dict(e.dtypes)
    p = p.mapInPandas(patches, f"file {kind['file']}, line_no {kind['line_no']}, context string, timestamp string, file_path string, new_code string, old_code string, tool_type string")
    return plain.unionByName(p)
