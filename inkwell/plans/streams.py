"""Streaming queries over ``events``; the windows are an extension of the reference family."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators.staging import fresh_folder
from inkwell.plans.base import query, read
from inkwell.streaming import files as sf
from inkwell.streaming import pages as sp


def events(spark, d):
    return sp.landing(spark, d, "events.parquet")


@query("l1_l2_stream_rollup", """SELECT user_id // 50 AS file, count(DISTINCT user_id) AS total_pages, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN value > 30 THEN user_id END)), ','), '') AS pages, count_if(value > 30) AS n FROM events GROUP BY 1""")
def l1(spark, d):
    """Pages of files, 50 to a file, by a streaming aggregate."""
    return sp.page_lists(sp.finished(sp.file_rollup(events(spark, d), 30)))


PAGES_SQL = """WITH p AS (SELECT user_id // 5 AS file, user_id AS page, count_if(value > 30) AS detections FROM events GROUP BY 1, 2),
t AS (SELECT file, count(*) + (file % 7 = 3)::BIGINT AS total_pages, count(*) AS seen_pages, array_to_string(list_sort(list(CASE WHEN detections > 0 THEN page END)), ',') AS pages, sum(detections)::BIGINT AS total_detections FROM p GROUP BY file)"""


@query("l2_files_when_complete", PAGES_SQL + " SELECT file, total_pages, seen_pages, coalesce(pages, '') AS pages, total_detections, CASE WHEN file % 7 = 3 THEN 'incomplete' ELSE 'success' END AS status FROM t")
def l2(spark, d):
    """Files of five pages, emitted when all have arrived, over several triggers.

    Every seventh announces a page that never comes and is closed at the end of the input.
    """
    e = read(spark, d, "events")
    p = e.groupBy(F.expr("user_id div 5").alias("file"), F.col("user_id").alias("page")).agg(F.count_if(F.col("value") > 30).alias("detections"), F.max("ts").cast("timestamp").alias("ts"))
    total = p.groupBy("file").agg((F.count("*") + (F.col("file") % 7 == 3).cast("bigint")).alias("total_pages"))
    whole = p.join(total, "file").select("file", "page", "total_pages", "detections", F.timestamp_seconds(F.lit(1_000_000_000)).alias("ts"))
    ends = whole.select("file", F.lit(None).cast("bigint").alias("page"), "total_pages", F.lit(0).cast("bigint").alias("detections"), "ts").distinct()
    folder = fresh_folder(spark, "pages")
    # the pages of a file come in several files of the folder, the ends after them
    whole.repartition(6, "page").write.parquet(folder)
    stream = sp.landing(spark, folder, "*.parquet", sf.PAGES, 2)
    base = fresh_folder(spark, "files")
    sp.finished(sf.completed_files(stream), "append", base)
    ends.coalesce(1).write.mode("append").parquet(folder)
    return sp.finished(sf.completed_files(sp.landing(spark, folder, "*.parquet", sf.PAGES, 2)), "append", base)


@query("x_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    w = sp.finished(sp.tumbling(events(spark, d), "1 hour"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("x_sliding_windows", "SELECT s - CASE k WHEN 0 THEN INTERVAL 0 MINUTE ELSE INTERVAL 30 MINUTE END AS start, count(*) AS n, max(value) AS top FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS s, value, unnest([0, 1]) AS k FROM events) q GROUP BY 1")
def sliding(spark, d):
    w = sp.finished(sp.sliding(events(spark, d), "1 hour", "30 minutes"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "top")


@query("x_session_windows", """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    w = sp.finished(sp.sessions(events(spark, d), "2 hours"))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
