"""Registration of queries and the views they run on.

Each view has two forms with the same rows: a DataFrame and SQL text for DuckDB. ``with_views``
puts the SQL forms in front of an oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.geometry import box

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "sig": """sig AS (SELECT vec_id AS sig_id, label AS writer, embedding::DOUBLE[] AS v, vec_id // 50 AS pdf, vec_id % 7 + 1 AS page,
        CASE WHEN vec_id % 10 < 2 THEN 'reference' WHEN vec_id % 10 < 4 THEN 'control' ELSE 'questioned' END AS role FROM embeddings)""",
    "uni": """uni AS (SELECT sig_id, writer, pdf, page, role, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM sig)""",
    "box": """box AS (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM (SELECT user_id AS page, event_id AS id, value AS score, (event_id * 37 % 400)::DOUBLE AS x0,
        (event_id * 53 % 500)::DOUBLE AS y0, (40 + event_id % 60)::DOUBLE AS w, (12 + event_id % 20)::DOUBLE AS h FROM events) q)""",
    "obj": """obj AS (SELECT page, id, CASE id % 4 WHEN 0 THEN 'ink' WHEN 1 THEN 'placed_image' WHEN 2 THEN 'full_page_scan' ELSE 'other' END AS role,
        x0 - id % 9 AS x0, y0 - 2 AS y0, x1 + id % 5 - 20 AS x1, y1 + 3 AS y1 FROM box WHERE id % 3 = 0)""",
    "gt": """gt AS (SELECT page, id + 1000000 AS id, x0 + id % 5 AS x0, y0 + id % 3 AS y0, x1 + id % 5 AS x1, y1 + id % 3 AS y1 FROM box WHERE id % 2 = 0)""",
    "files": """files AS (SELECT doc_id, source, lang, text, n_chars AS size, source || '/' || lang AS grp,
        source || '/' || lang || '/doc ' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '' WHEN 3 THEN '.zip' ELSE '.docx' END AS rel_path,
        CASE doc_id % 15 WHEN 2 THEN '%PDF-1.7 ' WHEN 7 THEN 'BM' WHEN 4 THEN 'Rar!' ELSE '' END || text AS content FROM documents)""",
    "pg": """pg AS (SELECT page_id, url, html, length(html) - length(replace(html, '<p', '')) AS n_chars_raw,
        (length(html) - length(replace(html, '<a ', ''))) // 3 AS n_links, (length(html) - length(replace(html, '<p', ''))) // 2 AS n_images, page_id % 3 AS n_full, length(html) % 120 AS n_chars, page_id % 2 AS n_drawings,
        regexp_extract(url, '://([^/]+)', 1) AS host FROM pages)""",
    "ann": """ann AS (SELECT l_orderkey AS image_id, l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 4 ELSE l_linenumber END AS category_id,
        '[' || printf('%.2f', l_discount) || ', ' || printf('%.2f', l_tax) || ', ' || printf('%.2f', l_quantity / 100) || ', ' || printf('%.2f', l_linenumber / 20.0) || ']' AS bbox FROM lineitem)""",
    "pairs": """pairs AS (SELECT a.sig_id AS sig_a, b.sig_id AS sig_b, a.writer AS wa, b.writer AS wb, a.role AS ra, b.role AS rb, a.pdf AS pa, b.pdf AS pb, list_dot_product(a.u, b.u) AS cosine
        FROM uni a JOIN uni b ON a.sig_id < b.sig_id)""",
    "docpairs": """docpairs AS (SELECT a.pdf, a.sig_id AS sig_a, b.sig_id AS sig_b, list_dot_product(a.u, b.u) AS cosine,
        list_dot_product(a.v1, b.v1) / sqrt(list_dot_product(a.v1, a.v1) * list_dot_product(b.v1, b.v1)) AS vgg,
        list_dot_product(a.v2, b.v2) / sqrt(list_dot_product(a.v2, a.v2) * list_dot_product(b.v2, b.v2)) AS vit
        FROM (SELECT uni.*, list_slice(u, 1, 32) AS v1, list_slice(u, 33, 64) AS v2 FROM uni) a JOIN (SELECT uni.*, list_slice(u, 1, 32) AS v1, list_slice(u, 33, 64) AS v2 FROM uni) b ON a.pdf = b.pdf AND a.sig_id < b.sig_id)""",
}
NEEDS = {"uni": ["sig"], "obj": ["box"], "gt": ["box"], "pairs": ["uni"], "docpairs": ["uni"]}


def with_views(*names: str) -> str:
    """WITH clause of the views and what they stand on; further CTEs may follow after a comma."""
    found: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in found:
            found.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(VIEWS[n] for n in found)


def query(name: str, oracle: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sig(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("vec_id") % 10 < 2, "reference").when(F.col("vec_id") % 10 < 4, "control").otherwise("questioned")
    return read(spark, d, "embeddings").select(
        F.col("vec_id").alias("sig_id"), F.col("label").alias("writer"), F.col("embedding").cast("array<double>").alias("v"),
        F.expr("vec_id div 50").alias("pdf"), (F.col("vec_id") % 7 + 1).alias("page"), role.alias("role"),
    )


def boxes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    x0, y0, w, h = (e * 37 % 400).cast("double"), (e * 53 % 500).cast("double"), (40 + e % 60).cast("double"), (12 + e % 20).cast("double")
    return read(spark, d, "events").select(F.col("user_id").alias("page"), e.alias("id"), F.col("value").alias("score"), box(x0, y0, x0 + w, y0 + h).alias("b"))


def objects(spark: SparkSession, d: str) -> DataFrame:
    i, b = F.col("id"), F.col("b")
    role = F.when(i % 4 == 0, "ink").when(i % 4 == 1, "placed_image").when(i % 4 == 2, "full_page_scan").otherwise("other")
    grown = box(b["x0"] - i % 9, b["y0"] - 2, b["x1"] + i % 5 - 20, b["y1"] + 3)
    return boxes(spark, d).where("id % 3 = 0").select("page", "id", role.alias("role"), grown.alias("b"))


def truths(spark: SparkSession, d: str) -> DataFrame:
    i, b = F.col("id"), F.col("b")
    return boxes(spark, d).where("id % 2 = 0").select("page", (i + 1000000).alias("id"), box(b["x0"] + i % 5, b["y0"] + i % 3, b["x1"] + i % 5, b["y1"] + i % 3).alias("b"))


def files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    ext = F.when(i % 5 == 0, ".pdf").when(i % 5 == 1, ".PNG").when(i % 5 == 2, "").when(i % 5 == 3, ".zip").otherwise(".docx")
    head = F.when(i % 15 == 2, "%PDF-1.7 ").when(i % 15 == 7, "BM").when(i % 15 == 4, "Rar!").otherwise("")
    group = F.concat_ws("/", "source", "lang")
    return read(spark, d, "documents").select(
        "doc_id", "source", "lang", "text", F.col("n_chars").alias("size"), group.alias("grp"),
        F.concat(group, F.lit("/doc "), i.cast("string"), ext).alias("rel_path"), F.concat(head, F.col("text")).alias("content"),
    )


def page_objects(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    count = lambda part: ((F.length(html) - F.length(F.replace(html, F.lit(part), F.lit("")))) / len(part)).cast("bigint")
    return read(spark, d, "pages").select(
        "page_id", "url", "html", count("<a ").alias("n_links"), count("<p").alias("n_images"), (F.col("page_id") % 3).alias("n_full"),
        (F.length(html) % 120).cast("bigint").alias("n_chars"), (F.col("page_id") % 2).alias("n_drawings"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"),
    )


def annotations(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 4).otherwise(F.col("l_linenumber"))
    bbox = F.format_string("[%.2f, %.2f, %.2f, %.2f]", "l_discount", "l_tax", F.col("l_quantity") / 100, F.col("l_linenumber") / 20.0)
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), category.cast("int").alias("category_id"), bbox.alias("bbox")
    )
