"""Inventory operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_sources(files: DataFrame) -> DataFrame:
    """(sha256, n, first_path, rel_path) of contents that occur more than once: a row for each path, as a common content may have any number."""
    several = files.groupBy("sha256").agg(F.count("*").alias("n"), F.min("rel_path").alias("first_path")).where("n > 1")
    return files.join(several, "sha256").select("sha256", "n", "first_path", "rel_path")


def summed_by_extension(files: DataFrame) -> DataFrame:
    """Counts and sizes by directory and extension, by directory and in all, in one pass."""
    return files.rollup("grp", "ext").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
