"""URL filter against dated lists (operator 5), in DataFrame functions only.

List events (key, verdict, day, action) become validity intervals; an as-of join meets
every capture with the entries active on its day. A key is a host, a parent domain or a
host with its first path segment; the longest active key decides, allow before block.

Defined cases: a null or unparsable URL or a null day matches nothing and stays; repeated
captures keep their rows; very long URLs are matched like any other; an "add" while active renews the entry; two events of a day
apply in the order add, remove; an empty list keeps every capture; other columns of the
captures are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import join_salted, join_weighted, table, written

FAR_DAY = "9999-12-31"


def intervals(events: DataFrame) -> DataFrame:
    """(key, verdict, valid_from, valid_to): half-open, one for each "add" event."""
    order = W.partitionBy("key", "verdict").orderBy("day", "action")
    nxt = F.lead("day").over(order)
    return (
        events.where("key is not null and day is not null")
        .select("key", "verdict", "action", F.col("day").alias("valid_from"), F.coalesce(nxt, F.lit(FAR_DAY).cast("date")).alias("valid_to"))
        .where((F.col("action") == "add") & (F.col("valid_from") < F.col("valid_to")))
        .drop("action")
    )


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def keys_of(url):
    """The keys that can list a URL: host, parents of two labels or more, host and first segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    segment = F.regexp_extract(url, r"^[^:]+://[^/?#]+/([^/?#]+)", 1)
    prefix = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefix))).otherwise(F.array().cast("array<string>"))


def url_filter(captures: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, url, fetched, verdict, matched_key, kept) of captures (page_id, url, fetched).

    The verdict depends on the URL and the day alone: it is found once for each pair, so
    that a URL captured often does not load one task.
    """
    captures = written(captures.select("page_id", "url", "fetched"), "captures")
    times = written(captures.where("url is not null and fetched is not null").groupBy("url", "fetched").agg(F.count("*").alias("n")), "captured")
    asked = times.select("url", "fetched")
    keyed = asked.select("url", "fetched", F.explode(keys_of(F.col("url"))).alias("key"))
    spans = written(intervals(events), "url-list")
    # a host may hold a third of all pages
    active = join_salted(keyed, spans, "key", "url", "inner").where((F.col("valid_from") <= F.col("fetched")) & (F.col("fetched") < F.col("valid_to")))
    rank = F.struct(F.length("key").alias("n"), (F.col("verdict") == "allow").alias("allow"), "key", "verdict")
    best = active.groupBy("url", "fetched").agg(F.max(rank).alias("best"))
    found = best.select("url", "fetched", "best.verdict", F.col("best.key").alias("matched_key"))
    verdicts = written(times.join(found, ["url", "fetched"]), "url-verdicts")
    return join_weighted(captures, verdicts, ["url", "fetched"], "left").select(
        "page_id",
        "url",
        "fetched",
        F.coalesce("verdict", F.lit("none")).alias("verdict"),
        F.coalesce("matched_key", F.lit("")).alias("matched_key"),
        (F.coalesce("verdict", F.lit("none")) != "block").alias("kept"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures; the tables hold no dates, so the day follows from the id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def events_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and first segments that occur in the pages.

    A digest of the key picks what is listed: of 16 keys, four are blocked for a while,
    two of these come back, and one is allowed from a later day on.
    """
    host = host_of(F.col("url"))
    segment = F.regexp_extract("url", r"^[^:]+://[^/?#]+/([^/?#]+)", 1)
    prefix = F.when(segment != "", F.concat(host, F.lit("/"), segment))
    domain = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    keys = pages.select(F.explode(F.array(host, domain, prefix)).alias("key")).where("key <> ''").distinct()
    digit = lambda a, n: F.conv(F.substring(F.md5("key"), a, n), 16, 10).cast("int")
    kind, first, last = digit(1, 1), F.pmod(digit(2, 3), F.lit(200)), F.pmod(digit(5, 3), F.lit(90)) + 30
    start = F.lit("2024-01-01").cast("date")
    event = lambda verdict, action, day: F.struct(F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), F.date_add(start, day).alias("day"))
    once = F.array(event("block", "add", first), event("block", "remove", first + last))
    again = F.concat(once, F.array(event("block", "add", first + last + 20)))
    allow = F.array(event("allow", "add", first + 10))
    listed = F.when(kind < 2, once).when(kind < 4, again).when(kind == 4, allow)
    return keys.select("key", F.explode(listed).alias("e")).select("key", "e.*")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(captures_of(pages), events_of(pages))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]+)', 1) AS seg
  FROM pages),
k AS (
  SELECT DISTINCT key FROM (
    SELECT host AS key FROM p UNION ALL
    SELECT regexp_replace(host, '^(www|m|blog)\.', '') FROM p UNION ALL
    SELECT host || '/' || seg FROM p WHERE seg <> '') t WHERE key <> ''),
d AS (
  SELECT key, CAST('0x' || substr(md5(key), 1, 1) AS INTEGER) AS kind,
         CAST('0x' || substr(md5(key), 2, 3) AS INTEGER) % 200 AS first,
         CAST('0x' || substr(md5(key), 5, 3) AS INTEGER) % 90 + 30 AS last
  FROM k),
ev AS (
  SELECT key, 'block' AS verdict, 'add' AS action, first AS day FROM d WHERE kind < 4 UNION ALL
  SELECT key, 'block', 'remove', first + last FROM d WHERE kind < 4 UNION ALL
  SELECT key, 'block', 'add', first + last + 20 FROM d WHERE kind BETWEEN 2 AND 3 UNION ALL
  SELECT key, 'allow', 'add', first + 10 FROM d WHERE kind = 4),
iv AS (
  SELECT key, verdict, action, DATE '2024-01-01' + CAST(day AS INTEGER) AS valid_from,
         coalesce(DATE '2024-01-01' + CAST(lead(day) OVER (PARTITION BY key, verdict ORDER BY day, action) AS INTEGER), DATE '9999-12-31') AS valid_to
  FROM ev),
asked AS (
  SELECT DISTINCT page_id, url, fetched, host AS key FROM p UNION
  SELECT page_id, url, fetched, host || '/' || seg FROM p WHERE seg <> '' UNION
  SELECT page_id, url, fetched, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
  FROM (SELECT p.*, unnest(range(1, len(string_split(host, '.')))) AS i FROM p) s),
best AS (
  SELECT a.page_id, iv.verdict, a.key,
         row_number() OVER (PARTITION BY a.page_id ORDER BY length(a.key) DESC, iv.verdict = 'allow' DESC, a.key DESC) AS r
  FROM asked a JOIN iv ON a.key = iv.key AND iv.action = 'add' AND iv.valid_from <= a.fetched AND a.fetched < iv.valid_to)
SELECT p.page_id, p.url, p.fetched, coalesce(b.verdict, 'none') AS verdict, coalesce(b.key, '') AS matched_key,
       coalesce(b.verdict, 'none') <> 'block' AS kept
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND b.r = 1
"""
