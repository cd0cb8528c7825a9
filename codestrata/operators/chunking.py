"""Semantic chunks of code, split to a size, and greedy groups of similar snippets."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import outline, pycode
from codestrata.functions.code_filter import extension
from codestrata.functions.paths import normalise_shape

CHUNK = "kind string, name string, start int, end int, code string, parent string, signature string, docstring string, dependencies array<string>, tokens int"
_COLUMNS = ["kind", "name", "start", "end", "code", "parent", "signature", "docstring", "dependencies", "tokens"]


def generic_blocks(code: str) -> list[dict]:
    """Runs of lines between blank lines."""
    out: list[dict] = []
    run: list[str] = []
    for i, line in enumerate([*code.split("\n"), ""], 1):
        if line.strip():
            run.append(line)
        elif run:
            out.append({"kind": "block", "name": f"block_{len(out) + 1}", "start": i - len(run), "end": i - 1, "code": "\n".join(run), "parent": None, "signature": None, "docstring": None, "dependencies": []})
            run = []
    return out


def split(chunk: dict, most: int) -> list[dict]:
    """A chunk as it is, or in parts of whole lines (five at least)."""
    tokens = len(chunk["code"]) // 4 + 1
    if tokens <= most:
        return [chunk | {"tokens": tokens}]
    lines = chunk["code"].split("\n")
    step = max(int(most / max(tokens / len(lines), 1)), 5)
    n = -(-len(lines) // step)
    out = []
    for i in range(n):
        part = lines[i * step : (i + 1) * step]
        code = "\n".join(part)
        first = chunk["start"] + i * step
        out.append(chunk | {"name": f"{chunk['name']}_part{i + 1}of{n}", "code": code, "start": first, "end": first + len(part) - 1, "signature": None, "docstring": None, "dependencies": [], "tokens": len(code) // 4 + 1})
    return out


def chunk_code(code: str | None, ext: str, most: int = 500) -> list[dict]:
    if not code or not code.strip():
        return []
    found = None
    if ext == ".py":
        found = pycode.chunks(code)
    elif ext in outline.BLOCK_LANGUAGES:
        found = outline.blocks(code, ext)
    if found is None:
        found = generic_blocks(code)
    return [p for c in found for p in split(c, most)]


def chunks(df: DataFrame, key: str, path: str, code: str, most: int = 500) -> DataFrame:
    """(key, chunk_no, kind, name, ...): narrow, one row per chunk."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *[c[x] for x in _COLUMNS]) for k, e, t in zip(pdf[key], pdf["__ext"], pdf[code], strict=True) for i, c in enumerate(chunk_code(t, e, most), 1)]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", *_COLUMNS])

    return df.select(key, extension(F.col(path)).alias("__ext"), code).mapInPandas(run, f"{key} {kind}, chunk_no int, {CHUNK}")


def generic_chunks(df: DataFrame, key: str, code: str) -> DataFrame:
    """Blank-line blocks by built-in expressions alone: (key, block, start, end, lines)."""
    lines = df.select(key, F.posexplode(F.split(code, "\n")).alias("i", "line"))
    blank = F.trim(F.regexp_replace("line", r"\s", "")) == ""
    w = Window.partitionBy(key).orderBy("i")
    lines = lines.withColumn("b", F.count_if(blank).over(w)).where(~blank)
    g = lines.groupBy(key, "b").agg((F.min("i") + 1).alias("start"), (F.max("i") + 1).alias("end"), F.count("*").alias("lines"))
    return g.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("b"))).drop("b")


def path_similarity(a: str, b: str) -> float:
    x, y = a.split("/")[::-1], b.split("/")[::-1]
    n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return n / max(len(x), len(y))


def similarity(a: dict, b: dict, matcher: SequenceMatcher | None = None) -> float:
    """0.7 code + 0.2 path ending + 0.1 kind (half of it if they differ); codes are normalised.
    A ``matcher`` of ``b`` may serve for many ``a``."""
    matcher = matcher or SequenceMatcher(None, "", b["norm"])
    matcher.set_seq1(a["norm"])
    code = matcher.ratio()
    return 0.7 * code + 0.2 * path_similarity(a["path"], b["path"]) + 0.1 * (1.0 if a["kind"] == b["kind"] else 0.5)


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each text has each character (those beyond ASCII together)."""
    out = np.zeros((len(texts), 129), np.int32)
    for i, t in enumerate(texts):
        if t:
            out[i] = np.bincount(np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), 128), minlength=129)
    return out


def places(text: str) -> dict[str, int]:
    """Where each character stands, as the bits of a number."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, all of ``b`` (its ``places``) at once."""
    at = places(b) if at is None else at
    v = full = (1 << len(b)) - 1
    for c in a:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(b) - v.bit_count()


class Grouper:
    """Greedy groups of snippets that come by falling score; ``add`` gives the group number, from 1.

    A snippet belongs to the first representative it is like, and is the next one if there is
    none: the same groups as when each representative in turn takes all later ones like it, but
    only representatives are kept, and of the others a digest. Characters in common, then the longest common
    subsequence bound the ratio from above, so only pairs that may pass are aligned.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.representatives: list[dict] = []
        self.counts, self.size = np.zeros((16, 129), np.int32), np.zeros(16, np.int64)
        self.known: dict[bytes, int] = {}

    def add(self, b: dict) -> int:
        digest = md5(repr((b["norm"], b["path"], b["kind"])).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        if digest not in self.known:  # equal snippets meet the same representatives
            self.known[digest] = self._find(b)
        return self.known[digest]

    def _find(self, b: dict) -> int:
        n = len(self.representatives)
        count = letter_counts([b["norm"]])[0]
        both = self.size[:n] + len(b["norm"])
        most = np.where(both == 0, 1.0, 2 * np.minimum(self.counts[:n], count).sum(1) / np.maximum(both, 1))
        # a little below the threshold: bounds are rounded otherwise than similarities
        low = self.threshold - 1e-9
        at, matcher = None, None
        for i in np.flatnonzero(0.7 * most + 0.3 >= low).tolist():
            a = self.representatives[i]
            other = 0.2 * path_similarity(a["path"], b["path"]) + 0.1 * (1.0 if a["kind"] == b["kind"] else 0.5)
            if 0.7 * most[i] + other < low:
                continue
            at = at or places(b["norm"])
            if a["norm"] != b["norm"] and 0.7 * 2 * common_length(a["norm"], b["norm"], at) / both[i] + other < low:
                continue
            matcher = matcher or SequenceMatcher(None, "", b["norm"])
            if similarity(a, b, matcher) >= self.threshold:
                return i + 1
        if n == len(self.counts):
            self.counts, self.size = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.counts[n], self.size[n] = count, len(b["norm"])
        self.representatives.append(b)
        return n + 1


def groups_in_turn(rows: list[dict], threshold: float) -> Iterator[list[int]]:
    """The groups of :class:`Grouper` one after the other, as places in ``rows``: each representative in turn takes all
    later snippets like it. Who needs only the first groups stops there and the others are not compared."""
    same: dict[tuple, list[int]] = {}
    for i, x in enumerate(rows):
        same.setdefault((x["norm"], x["path"], x["kind"]), []).append(i)
    every = list(same.values())
    each = [rows[at[0]] for at in every]
    counts, size = letter_counts([x["norm"] for x in each]), np.array([len(x["norm"]) for x in each], np.int64)
    low = threshold - 1e-9  # bounds are rounded otherwise than similarities
    bits: dict[int, dict[str, int]] = {}
    matchers: dict[int, SequenceMatcher] = {}
    ends: dict[tuple[str, str], float] = {}
    rest = np.arange(len(each))
    while len(rest):
        r, rest = int(rest[0]), rest[1:]
        a, taken = each[r], []
        both = size[rest] + size[r]
        most = np.where(both == 0, 1.0, 2 * np.minimum(counts[rest], counts[r]).sum(1) / np.maximum(both, 1))
        for k in np.flatnonzero(0.7 * most + 0.3 >= low).tolist():
            i = int(rest[k])
            b = each[i]
            pair = (a["path"], b["path"])
            if pair not in ends:
                ends[pair] = path_similarity(*pair)
            other = 0.2 * ends[pair] + 0.1 * (1.0 if a["kind"] == b["kind"] else 0.5)
            if 0.7 * most[k] + other < low:
                continue
            if a["norm"] != b["norm"]:
                if i not in bits:
                    bits[i] = places(b["norm"])
                if 0.7 * 2 * common_length(a["norm"], b["norm"], bits[i]) / both[k] + other < low:
                    continue
            if i not in matchers:
                matchers[i] = SequenceMatcher(None, "", b["norm"])
            if similarity(a, b, matchers[i]) >= threshold:
                taken.append(k)
        yield sorted(every[r] + [j for k in taken for j in every[rest[k]]])
        rest = np.delete(rest, taken)


def group_snippets(df: DataFrame, query: str, key: str, path: str, code: str, kind: Column, score: Column, threshold: float = 0.7) -> DataFrame:
    """(query, key, group_no, size): greedy groups of all snippets of each query by falling score.

    Rows of a query come sorted and pass in batches, whatever their number; a task keeps
    the representatives and digests.
    """
    qt, kt = df.schema[query].dataType.simpleString(), df.schema[key].dataType.simpleString()
    s = df.select(query, key, F.col(path).alias("path"), F.coalesce(normalise_shape(F.col(code)), F.lit("")).alias("norm"), kind.alias("kind"), score.alias("__score"))
    s = s.repartition(query).sortWithinPartitions(query, F.desc("__score"), key).drop("__score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, grouper = None, None
        for pdf in batches:
            group = []
            for x in pdf.to_dict("records"):
                if grouper is None or x[query] != current:
                    current, grouper = x[query], Grouper(threshold)
                group.append(grouper.add(x))
            yield pd.DataFrame({query: pdf[query], key: pdf[key], "group_no": group})

    g = s.mapInPandas(run, f"{query} {qt}, {key} {kt}, group_no int")
    return g.withColumn("size", F.count("*").over(Window.partitionBy(query, "group_no")).cast("int"))


# How a group is called by its most frequent kind.
LABELS = {"function": "functions", "class": "classes", "method": "methods", "imports": "import blocks", "constants": "constant blocks", "block": "code blocks"}


def group_labels(groups: DataFrame, query: str, kind: str, path: str) -> DataFrame:
    """(query, group_no, label, found_in): modal kind (the least on a tie) and up to three directories of half the paths."""
    kinds = groups.groupBy(query, "group_no", kind).agg(F.count("*").alias("n"))
    modal = kinds.groupBy(query, "group_no").agg(F.min_by(kind, F.struct((-F.col("n")).alias("a"), F.col(kind))).alias("k"), F.sum("n").alias("size"))
    parts = groups.select(query, "group_no", F.explode(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))).alias("p")).where("p <> ''")
    common = parts.groupBy(query, "group_no", "p").agg(F.count("*").alias("c")).join(modal, [query, "group_no"]).where("c >= 0.5 * size")
    listed = common.groupBy(query, "group_no").agg(F.array_join(F.slice(F.array_sort(F.collect_list("p")), 1, 3), ", ").alias("found_in"))
    name = F.coalesce(*[F.when(F.col("k") == a, b) for a, b in LABELS.items()], F.lit("code snippets"))
    return modal.join(listed, [query, "group_no"], "left").select(query, "group_no", "size", name.alias("label"), "found_in")


FENCES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx", ".rs": "rust", ".go": "go", ".java": "java", ".rb": "ruby", ".sh": "bash", ".sql": "sql", ".c": "c", ".cpp": "cpp"}


def render(path: Column, code: Column, score: Column, context: Column) -> Column:
    """One result as Markdown: short path and relevance, shortened context, fenced code."""
    from codestrata.functions.paths import short_path, truncate_code

    fence = F.coalesce(*[F.when(extension(path) == e, lang) for e, lang in FENCES.items()], F.lit(""))
    note = F.when(F.length(context) > 200, F.concat(F.substring(context, 1, 200), F.lit("..."))).otherwise(context)
    head = F.concat(F.lit("### "), short_path(path), F.format_string(" (%d%% relevant)", F.floor(score * 100 + 0.5).cast("int")))
    return F.concat_ws("\n", head, F.when(F.length(note) > 0, F.concat(F.lit("> "), F.regexp_replace(note, "\n", " "))), F.concat(F.lit("```"), fence, F.lit("\n"), truncate_code(code), F.lit("\n```")))
