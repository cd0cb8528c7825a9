"""Paths, hashes and token estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_path(path: Column, parts: int = 3) -> Column:
    p = F.split(path, "/")
    return F.when(F.size(p) > parts, F.concat(F.lit(".../"), F.array_join(F.slice(p, -parts, parts), "/"))).otherwise(path)


def module_name(path: Column) -> Column:
    """``a/b/__init__.py`` and ``a/b.py`` are the module ``a.b``."""
    p = F.regexp_replace(F.regexp_replace(path, r"^\./", ""), r"\.py$", "")
    p = F.regexp_replace(p, r"(^|/)__init__$", "")
    return F.translate(F.regexp_replace(p, "^/+", ""), "/", ".")


def relative_import(module: Column, current: Column, is_package: Column, strict: bool = False) -> Column:
    """``..x`` seen from ``current`` as an absolute name. One dot is the own package. Too many
    dots leave the name unchanged, or give null if ``strict``."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    name = F.regexp_replace(module, r"^\.+", "")
    base = F.split(current, r"\.")
    keep = F.size(base) - dots + F.when(is_package, 1).otherwise(0)
    head = F.array_join(F.slice(base, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    joined = F.when(head == "", name).when(name == "", head).otherwise(F.concat(head, F.lit("."), name))
    return F.when(dots == 0, module).when(keep < 0, F.lit(None) if strict else module).otherwise(joined)


def signature_hash(signature: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(F.trim(F.lower(signature)), r"\s+", " "), 256), 1, 16)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def shown_hash(path: Column, content: Column) -> Column:
    """Key of the show-once gate: the path and the first 500 characters."""
    return F.md5(F.concat(path, F.lit(":"), F.substring(content, 1, 500)))


def estimate_tokens(text: Column, kind: str = "chunk") -> Column:
    """Token estimates: ``inject`` n/4, ``chunk`` n/4 + 1, ``code``/``prose``/``mixed`` 1.1 n / ratio + 1 (0 for empty), ``summary`` n/4."""
    n = F.length(text)
    if kind in ("code", "prose", "mixed"):
        ratio = {"code": 4.0, "prose": 5.0, "mixed": 4.5}[kind]
        return F.when(n == 0, 0).otherwise(F.floor(n / ratio * 1.1).cast("int") + 1)
    return (F.floor(n / 4) + (1 if kind == "chunk" else 0)).cast("int")


def estimate_block(code: Column, fence: bool = True) -> Column:
    return estimate_tokens(code, "code") + (4 if fence else 0)


def human_bytes(n: Column) -> Column:
    out = F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1))
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1), ("B", 0)):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1))).otherwise(out)
    return out


def truncate_code(code: Column, most: int = 30) -> Column:
    """Head and tail of a long code with a note of what is left out."""
    lines = F.split(code, "\n")
    half = most // 2
    note = F.format_string("    # ... (%d lines omitted) ...", F.size(lines) - 2 * half)
    short = F.array_join(F.concat(F.slice(lines, 1, half), F.array(F.lit(""), note, F.lit("")), F.slice(lines, -half, half)), "\n")
    return F.when(F.size(lines) > most, short).otherwise(code)


def preprocess(text: Column, most: int = 1500) -> Column:
    """Text for an embedding: tabs widened, a long middle left out, ends stripped."""
    t = F.regexp_replace(text, "\t", "    ")
    half = most // 2
    cut = F.when(F.length(t) > most, F.concat(F.substring(t, 1, half), F.lit("\n...\n"), F.substring(t, -half, half))).otherwise(t)
    return F.regexp_replace(cut, r"^\s+|\s+$", "")


def embedding_text(path: Column, code: Column, context: Column) -> Column:
    head = F.concat(F.lit("File: "), F.array_join(F.slice(F.split(path, "/"), F.greatest(-F.size(F.split(path, "/")), F.lit(-3)), F.lit(3)), "/"))
    tail = F.when(F.length(context) > 0, F.concat(F.lit("Context: "), F.substring(context, 1, 200)))
    return F.concat_ws("\n\n", F.when(path != "", head), code, tail)


def normalise_change(code: Column) -> Column:
    """Code without comments and runs of space, to tell whether a body changed."""
    for pattern in (r"(?m)#.*$", r"(?m)//.*$", r"(?s)/\*.*?\*/", r'(?s)""".*?"""', r"(?s)'''.*?'''"):
        code = F.regexp_replace(code, pattern, "")
    return F.trim(F.regexp_replace(code, r"\s+", " "))


def normalise_shape(code: Column) -> Column:
    """Code without comments, with placeholders for strings and numbers, in lower case."""
    for pattern, by in ((r"(?m)#.*$", ""), (r"(?m)//.*$", ""), (r"(?s)/\*.*?\*/", ""), (r'"[^"]*"', '"STR"'), (r"'[^']*'", "'STR'"), (r"\b\d+\b", "NUM"), (r"\s+", " ")):
        code = F.regexp_replace(code, pattern, by)
    return F.trim(F.lower(code))
