"""Page streams: per-file rollup with state, and windows over event time (an extension).

A stream is read from a landing folder until what is there is done (``availableNow``); each
result is written by ``foreachBatch`` to a folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.staging import fresh_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def landing(spark: SparkSession, folder: str, pattern: str, schema: str = EVENTS, files_per_trigger: int = 16) -> DataFrame:
    """Files of a folder that fit a pattern, as a stream; ``ts`` as a time stamp that watermarks accept."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(result: DataFrame, mode: str = "complete", base: str | None = None) -> DataFrame:
    """Runs a streaming result to its end and returns its table.

    Complete mode overwrites it with each batch; append mode adds to it, by batch number, so
    that a repeated batch replaces itself. With ``base``, a folder of an earlier run, it goes on
    where that one ended.
    """
    spark = result.sparkSession
    base = base or fresh_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out").select(result.columns)


#: Pages of a file, and of a part of a file's page numbers.
FILE_PAGES = 50


def file_rollup(pages: DataFrame, least: float) -> DataFrame:
    """By page of a file: its detections; state is kept by page across batches, and grows with the pages alone.

    ``page_lists`` makes a row for each file of it.
    """
    page = F.col("user_id")
    return pages.groupBy(F.expr(f"user_id div {FILE_PAGES}").alias("file"), page.alias("page")).agg(F.count_if(F.col("value") > least).alias("n"))


def page_lists(rollup: DataFrame) -> DataFrame:
    """(file, total_pages, pages, n): a file holds at most ``FILE_PAGES`` pages, so that its list is bounded."""
    hits = F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("page")))), ",")
    return rollup.groupBy("file").agg(F.count("*").alias("total_pages"), hits.alias("pages"), F.sum("n").alias("n"))


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step))
    return w.agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("window.start").alias("start"), "n", "top")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
