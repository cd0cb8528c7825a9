"""Project roots: which directories hold a project, and which project a file belongs to.

Files and roots meet by equality: a path is exploded into the directories above it,
so no file is compared with every root. No file system is probed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files that mark the root of a project.
MARKERS = (".git", "pyproject.toml", "setup.py", "package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Makefile", ".project")


def clean(path: Column) -> Column:
    """One kind of separator, none doubled, none at the end."""
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), "(?<=.)/$", "")


def above(path: Column) -> Column:
    """All directories above a file, the nearest first."""
    parts = F.split(clean(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def roots(files: DataFrame, path: str = "file_path", markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(root): directories that hold a marker, also as a directory (``.git/config``)."""
    f = files.select(F.explode(F.concat(F.array(clean(F.col(path))), above(F.col(path)))).alias("p"))
    return f.where(F.element_at(F.split("p", "/"), -1).isin(*markers)).select(F.regexp_replace("p", "/?[^/]*$", "").alias("root")).distinct()


def detect(files: DataFrame, roots_: DataFrame, key: str = "id", path: str = "file_path") -> DataFrame:
    """(key, root): the deepest root above each file; files outside all roots have no row."""
    up = files.select(key, F.explode(above(F.col(path))).alias("root"))
    hit = up.join(roots_.select(clean(F.col("root")).alias("root")).distinct(), "root")
    return hit.groupBy(key).agg(F.max_by("root", F.length("root")).alias("root"))


def name(root: Column) -> Column:
    return F.element_at(F.split(clean(root), "/"), -1)


def same(a: Column, b: Column) -> Column:
    """Are two detected roots one project? Unknown ones are of none."""
    return F.coalesce(a == b, F.lit(False))
