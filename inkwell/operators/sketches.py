"""Distinct counts that are kept for parts of a corpus and merged later.

A part's sketch is a few kilobytes whatever it counts; new folders add theirs, and any
union of parts is estimated without reading them again. The exact counts stay the default.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of a sketch's registers.
REGISTERS = 12


def relative_error(registers: int = REGISTERS) -> float:
    """The standard error of an estimate."""
    return 1.04 / math.sqrt(2**registers)


def distinct_sketches(rows: DataFrame, by: list[str], value: str, registers: int = REGISTERS) -> DataFrame:
    """(by, sketch, n_rows): one sketch of a column's distinct values for each part; null values don't count."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(value).cast("string"), F.lit(registers)).alias("sketch"), F.count(value).alias("n_rows"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, sketch, n_rows) of coarser parts."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n_rows").alias("n_rows"))


def estimates(sketches: DataFrame, by: list[str], merged: bool = False) -> DataFrame:
    """(by, n_distinct, n_rows), merged to ``by`` unless that is done."""
    whole = sketches if merged else merged_sketches(sketches, by)
    return whole.select(*by, F.hll_sketch_estimate("sketch").alias("n_distinct"), "n_rows")
