"""Cutting the lineage of iterative operators in a folder that all executors share, and ranks over all rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fresh_folder(spark: SparkSession, what: str = "stage") -> str:
    """A new folder below spark.checkpoint.dir; below one of our own only in a local session where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to a folder that all executors share and read again."""
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.__dict__["_written_to"] = path
    return found


def discarded(*tables: DataFrame) -> None:
    """Deletes what ``materialised`` wrote for tables that nothing reads any more."""
    for df in tables:
        path = df.__dict__.get("_written_to")
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the place of each row, from 1, in one order over all rows.

    Rows are dealt out by ranges of the order and numbered within; only the sizes of the
    ranges, a row for each, are added up in one place.
    """
    parts = materialised(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return parts.join(F.broadcast(before), "_part").withColumn(name, place.cast("bigint")).drop("_part", "_before")


def leading_values(rows: DataFrame, by: list[str], value: str, most: int = 500, parts: int = 64) -> DataFrame:
    """(by, first): the ``most`` smallest distinct values of each key, in order.

    A key's values are ranked in ``parts`` first and those that lead there together then, so
    that no task holds all of a key's.
    """
    place = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(value))
    own = rows.select(*by, value).distinct().withColumn("_part", F.pmod(F.xxhash64(value), F.lit(parts)))
    some = own.withColumn("_r", place(*by, "_part")).where(F.col("_r") <= most)
    top = some.withColumn("_r", place(*by)).where(F.col("_r") <= most)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("first"))


def ranked_within(df: DataFrame, by: str, order: list, name: str) -> DataFrame:
    """``df`` with the place of each row, from 1, among those of its key.

    Rows are dealt out by ranges of key and order, so that a key of any size falls into several;
    what is added up by key is a row for each range that it touches.
    """
    parts = materialised(df.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), (F.sum("_n").over(W.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = parts.withColumn("_own", F.row_number().over(W.partitionBy(by, "_part").orderBy(*order)))
    joined = own.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_part", "_own", "_by", "_at", "_before")


def sent_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` for all tasks if it has at most ``most`` rows, else as it is; it is counted up to there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
