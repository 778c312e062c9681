"""All registered queries of the reference family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.plans import base, corpus, detection, rasters, reports, streams, vectors, workbooks  # noqa: F401  registers the queries
from inkwell.plans.base import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and signer: matches with their similarities."""
    return QUERIES["f21_target_by_signer"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
