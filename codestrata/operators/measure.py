"""Measured runs: statistics, regressions against a baseline, generated sources to measure parsers with."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import index

#: One function and one class of each language; ``{i}`` is their number.
TEMPLATES = {
    ".py": ("def function_{i}(a, b={i}):\n    total = a + b\n    return function_{i}(total)\n\n", "class Class{i}:\n    def method_{i}(self, x):\n        return x + {i}\n\n"),
    ".js": ("function function{i}(a, b = {i}) {{\n  const total = a + b;\n  return function{i}(total);\n}}\n\n", "class Class{i} {{\n  method{i}(x) {{ return x + {i}; }}\n}}\n\n"),
    ".ts": ("export function function{i}(a: number, b = {i}): number {{\n  const total = a + b;\n  return total;\n}}\n\n", "export class Class{i} {{\n  method{i}(x: number): number {{ return x + {i}; }}\n}}\n\n"),
    ".rs": ("pub fn function_{i}(a: i64, b: i64) -> i64 {{\n    let total = a + b;\n    total + {i}\n}}\n\n", "pub struct Class{i} {{ value: i64 }}\nimpl Class{i} {{\n    pub fn method_{i}(&self, x: i64) -> i64 {{ x + {i} }}\n}}\n\n"),
    ".go": ("func Function{i}(a, b int) int {{\n\ttotal := a + b\n\treturn total + {i}\n}}\n\n", "type Class{i} struct {{\n\tvalue int\n}}\nfunc (c *Class{i}) Method{i}(x int) int {{ return x + {i} }}\n\n"),
    ".c": ("int function_{i}(int a, int b) {{\n    int total = a + b;\n    return total + {i};\n}}\n\n", "struct class_{i} {{ int value; }};\n\n"),
    ".cpp": ("int function_{i}(int a, int b) {{\n    int total = a + b;\n    return total + {i};\n}}\n\n", "class Class{i} {{\n  int method_{i}(int x) {{ return x + {i}; }}\n}};\n\n"),
}


def generate(ext: str, functions: int = 50, classes: int = 10) -> str:
    """A source with that many functions and classes."""
    one, two = TEMPLATES[ext]
    return "".join(one.format(i=i) for i in range(functions)) + "".join(two.format(i=i) for i in range(classes))


def run_stats(runs: DataFrame, group: list[str], seconds: str) -> DataFrame:
    """(group, runs, mean, median, least, most) of measured seconds."""
    return runs.groupBy(*group).agg(
        F.count(seconds).alias("runs"), F.round(F.avg(seconds), 6).alias("mean"), F.round(F.median(seconds), 6).alias("median"), F.min(seconds).alias("least"), F.max(seconds).alias("most")
    )


def regressions(baseline: DataFrame, current: DataFrame, key: str, threshold: float = 20.0) -> DataFrame:
    """(key, before, after, change) of means that grew by more than ``threshold`` per cent."""
    both = baseline.select(key, F.col("mean").alias("before")).join(current.select(key, F.col("mean").alias("after")), key)
    change: Column = F.round((F.col("after") - F.col("before")) * 100.0 / F.col("before"), 6)
    return both.where("before > 0").withColumn("change", change).where(F.col("change") > threshold)


def parser_runs(spark: SparkSession, exts: tuple[str, ...] = tuple(TEMPLATES), functions: int = 50, classes: int = 10, runs: int = 3, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """(ext, run, seconds, symbols): what indexing a generated source of each language takes."""
    rows = []
    for ext in exts:
        files = spark.createDataFrame([(f"bench{ext}", generate(ext, functions, classes))], "file_path string, code string")
        for run in range(runs):
            start = clock()
            n = index.facts(files).where("what = 'symbols'").count()
            rows.append((ext, run, clock() - start, n))
    return spark.createDataFrame(rows, "ext string, run int, seconds double, symbols bigint")
