"""What did an edit do? Functions before and after, matched by signature, then by name."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import outline, pycode
from codestrata.functions.code_filter import extension

REPETITIVE = 3
_COMMENTS = [re.compile(p, f) for p, f in ((r"#.*$", re.M), (r"//.*$", re.M), (r"/\*.*?\*/", re.S), (r'""".*?"""', re.S), (r"'''.*?'''", re.S))]


def functions_of(code: str | None, ext: str) -> list[dict]:
    if not code:
        return []
    found = pycode.functions(code) if ext == ".py" else None
    return outline.line_functions(code, ext) if found is None else found


def signature_hash(signature: str) -> str:
    return hashlib.sha256(" ".join(signature.lower().split()).encode()).hexdigest()[:16]


def normalise(code: str) -> str:
    for p in _COMMENTS:
        code = p.sub("", code)
    return " ".join(code.split())


def refactor_ratio(old: str, new: str) -> float:
    """Similarity of the normalised codes; an upper bound settles most pairs without alignment."""
    a, b = normalise(old), normalise(new)
    if not a and not b:
        return 1.0
    m = SequenceMatcher(None, a, b)
    return 0.0 if m.real_quick_ratio() <= 0.8 or m.quick_ratio() <= 0.8 else m.ratio()


def classify(old: str | None, new: str | None, ext: str) -> tuple[str, list, list, list]:
    """(kind, added, modified, deleted). Lists hold (name, signature hash).

    A null old text makes everything new: add. Else, in this order: more functions deleted
    than added and modified together is delete; some added and none modified is add; some
    modified is modify; what is left is a refactor if the texts are much alike, else modify.
    """
    key = lambda fs: {signature_hash(f["signature"]): f for f in fs}
    ha = key(functions_of(new, ext))
    if old is None:
        return "add", sorted((f["name"], h) for h, f in ha.items()), [], []
    hb = key(functions_of(old, ext))
    names_b, names_a = {f["name"] for f in hb.values()}, {f["name"] for f in ha.values()}
    lines_b, lines_a = old.split("\n"), (new or "").split("\n")
    body = lambda f, lines: normalise("\n".join(lines[f["start"] - 1 : f["end"]]))
    stayed = {h for h in ha.keys() & hb.keys() if body(ha[h], lines_a) != body(hb[h], lines_b)}
    fresh = ha.keys() - hb.keys()
    renewed = {h for h in fresh if ha[h]["name"] in names_b}  # the signature changed, the name stayed
    added = sorted((ha[h]["name"], h) for h in fresh - renewed)
    modified = sorted((ha[h]["name"], h) for h in stayed | renewed)
    deleted = sorted((hb[h]["name"], h) for h in hb.keys() - ha.keys() if hb[h]["name"] not in names_a)
    if len(deleted) > len(added) + len(modified):
        kind = "delete"
    elif added and not modified:
        kind = "add"
    elif modified or refactor_ratio(old, new or "") <= 0.8:
        kind = "modify"
    else:
        kind = "refactor"
    return kind, added, modified, deleted


_PAIRS = "array<struct<name:string,hash:string>>"


def changes(df: DataFrame, key: str, path: str = "file_path", old: str = "old_code", new: str = "new_code") -> DataFrame:
    """(key, file_path, kind, added, modified, deleted, additive, total) of every edit; narrow."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p, e, a, b in zip(pdf[key], pdf["p"], pdf["e"], pdf["a"], pdf["b"], strict=True):
                c, *lists = classify(a, b, e)
                rows.append((k, p, c, *[[{"name": n, "hash": h} for n, h in x] for x in lists]))
            yield pd.DataFrame(rows, columns=[key, "file_path", "kind", "added", "modified", "deleted"])

    s = df.select(key, F.col(path).alias("p"), extension(F.col(path)).alias("e"), F.col(old).alias("a"), F.col(new).alias("b"))
    out = s.mapInPandas(run, f"{key} {kind}, file_path string, kind string, added {_PAIRS}, modified {_PAIRS}, deleted {_PAIRS}")
    n = F.size("added") + F.size("modified") + F.size("deleted")
    additive = (F.size("added") > 0) & (F.size("modified") == 0) & (F.size("deleted") == 0)
    return out.withColumns({"additive": additive, "total": n})


def history_rows(changed: DataFrame, key: str) -> DataFrame:
    """One row per touched function, as the edit log keeps them; edits without functions keep one row of their own."""
    part = lambda c, k: F.transform(c, lambda x: F.struct(x["name"].alias("function_name"), x["hash"].alias("signature_hash"), F.lit(k).alias("change_type")))
    rows = F.concat(part("added", "add"), part("modified", "modify"), part("deleted", "delete"))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("function_name"), F.lit(None).cast("string").alias("signature_hash"), F.col("kind").alias("change_type")))
    return changed.select(key, "file_path", F.explode(F.when(F.size(rows) > 0, rows).otherwise(bare)).alias("r")).select(key, "file_path", "r.*")


def repetitive_warnings(changed: DataFrame, edits_24h: DataFrame, key: str) -> DataFrame:
    """Edits that modify a function edited three times in 24 hours: (key, function_name, edits_24h), the first by name."""
    m = changed.select(key, "file_path", F.explode("modified").alias("m")).select(key, "file_path", F.col("m.name").alias("function_name"), F.col("m.hash").alias("signature_hash"))
    hot = edits_24h.where(F.col("edits_24h") >= REPETITIVE).select("file_path", "signature_hash", "edits_24h")
    return m.join(hot, ["file_path", "signature_hash"]).groupBy(key).agg(F.min_by(F.struct("function_name", "edits_24h"), "function_name").alias("w")).select(key, "w.*")
