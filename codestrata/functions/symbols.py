"""Names that a piece of code defines or mentions, by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One pattern for each family of definitions; the name is group 1.
DEFINITIONS = [
    r"\bdef\s+(\w+)\s*\(",
    r"\bclass\s+(\w+)",
    r"\bfunction\s+(\w+)\s*\(",
    r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:\([^)]*\)|[^=])\s*=>",
    r"(?m)^\s*(\w+)\s*\([^)]*\)\s*\{",
    r"\bfn\s+(\w+)\s*[<(]",
    r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*\(",
]
SEARCHED = [(r"from\s+(\w+)|import\s+(\w+)", 2), (r"def\s+(\w+)|class\s+(\w+)", 2), (r"@(\w+)", 1)]


def code_symbols(code: Column) -> Column:
    """Sorted distinct names of functions, classes and methods."""
    found = [F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in DEFINITIONS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def search_terms(code: Column, path: Column, most: int = 8) -> Column:
    """Imports, definitions, decorators and the file's stem in order of appearance, each once, more than two letters, ``most`` of them."""
    terms = []
    for pattern, groups in SEARCHED:
        per = [F.regexp_extract_all(code, F.lit(pattern), F.lit(g + 1)) for g in range(groups)]
        terms.append(per[0] if groups == 1 else F.zip_with(per[0], per[1], lambda a, b: F.when(a != "", a).otherwise(b)))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    kept = F.filter(F.array_distinct(F.concat(*terms, F.array(stem))), lambda t: F.length(t) > 2)
    return F.array_join(F.slice(kept, 1, most), " ")
