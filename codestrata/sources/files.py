"""Source files of a directory as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.code_filter import extension
from codestrata.functions.outline import LANGUAGES


def read_sources(spark: SparkSession, directory: str, pattern: str = "*", exclude: list[str] | None = None, supported_only: bool = False) -> DataFrame:
    """(file_path, modified, code) of all files below a directory whose name fits the
    pattern and whose path has none of ``exclude``; partitions take the place of a thread pool."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true")
    df = r.text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("code"))
    for part in exclude or []:
        df = df.where(~F.col("file_path").contains(part))
    return df.where(extension(F.col("file_path")).isin(".py", *LANGUAGES)) if supported_only else df
