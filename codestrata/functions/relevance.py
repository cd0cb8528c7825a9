"""Relevance of a snippet for the file being edited, from four partial scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of recency, proximity, semantic and project scores; half life, oldest age, least score.
WEIGHTS = (0.20, 0.25, 0.35, 0.20)
HALF_LIFE_DAYS, OLDEST_DAYS, LEAST = 7.0, 90.0, 0.3


def recency(at: Column, as_of: Column) -> Column:
    """Halves every week, 0 beyond 90 days, 0.5 if unknown."""
    days = (F.unix_micros(as_of) - F.unix_micros(at)) / 86_400_000_000
    return F.when(days.isNull(), 0.5).when(days > OLDEST_DAYS, 0.0).otherwise(F.least(F.lit(1.0), F.exp(-F.log(F.lit(2.0)) / HALF_LIFE_DAYS * days)))


def leading_equal(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def proximity(path: Column, current: Column) -> Column:
    a, b = F.split(path, "/"), F.split(current, "/")
    up = lambda p, n: F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - n, F.lit(0))), "/")
    depth = F.greatest(F.size(a), F.size(b)) - 1
    far = F.when(depth <= 0, 0.3).otherwise(0.3 + 0.4 * leading_equal(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(1), F.size(b) - 1)) / depth)
    return (
        F.when(path.isNull() | current.isNull() | (path == "") | (current == ""), 0.5)
        .when(path == current, 1.0)
        .when(up(a, 1) == up(b, 1), 0.8)
        .when(up(a, 2) == up(b, 2), 0.6)
        .otherwise(far)
    )


def project(path: Column, root: Column) -> Column:
    return F.when(root.isNull() | path.isNull(), 0.5).when(path.startswith(root), 1.0).otherwise(0.3)


def shifted(cosine: Column, default: float = 0.5) -> Column:
    return F.when(cosine.isNull(), default).otherwise((cosine + 1) / 2)


def combine(recency_: Column, proximity_: Column, semantic: Column, project_: Column) -> Column:
    s = sum((w * c for w, c in zip(WEIGHTS, (recency_, proximity_, semantic, project_), strict=True)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def dependency_boost(score: Column, name: Column, code: Column, dependencies: Column) -> Column:
    """1.2 if a dependency bears the snippet's name, else 1.15 once if the code defines one; at most 1."""
    named = F.coalesce(F.array_contains(dependencies, name), F.lit(False))
    defines = F.exists(dependencies, lambda d: code.contains(F.concat(F.lit("def "), d)) | code.contains(F.concat(F.lit("class "), d)))
    factor = F.when(named, 1.2).otherwise(1.0) * F.when(F.coalesce(defines, F.lit(False)), 1.15).otherwise(1.0)
    return F.least(F.lit(1.0), score * factor)


def clean_context(value: Column) -> Column:
    """A context value without NULs; blank is none."""
    v = F.trim(F.translate(value, "\0", ""))
    return F.when(v != "", v)
