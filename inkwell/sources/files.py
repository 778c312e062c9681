"""Corpus folders, probe tables and annotations as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import strings

#: Schemas of the tables that the readers give.
CANDIDATES = "rel_path string, page int, kind string, x0 double, y0 double, x1 double, y1 double, stream_sha256 string, signed boolean, signer string"
DETECTIONS = "rel_path string, file_name string, page int, detector_class string, score double, x0 double, y0 double, x1 double, y1 double, classification string, page_composition string"
ANNOTATIONS = "id int, image_id int, category_id int, bbox string"


def relative(root: str):
    """Path below a root, whatever the file system's prefix."""
    below, path = root.rstrip("/").split(":")[-1].lstrip("/") + "/", F.col("path")
    return F.substring(path, F.locate(below, path) + len(below), F.length(path))


def discover(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(rel_path, grp, kind, how, sha256, size_bytes, mtime_utc) of a folder tree, in path order.

    Hidden files are skipped by the reader. Contents are hashed and sniffed where they are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = relative(root)
    rows = raw.select(rel.alias("rel_path"), "content", F.col("length").alias("size_bytes"), "modificationTime")
    folder = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    c = strings.classified(F.col("rel_path"), F.col("content"))
    return rows.select(
        "rel_path", F.when(folder == "", ".").otherwise(folder).alias("grp"), c["kind"].alias("kind"), c["how"].alias("how"),
        F.sha2("content", 256).alias("sha256"), "size_bytes", strings.iso_seconds(F.col("modificationTime")).alias("mtime_utc"),
    ).orderBy("rel_path")


def resolved(spark: SparkSession, target: str) -> DataFrame:
    """(rel_path, kind, size_bytes) of the inputs that a target names: one file, or the documents and pictures below a folder.

    A single file that is neither raises an error when it is read; in a folder such files are passed over.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    alone = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    if not alone:
        return discover(spark, target).where(F.col("kind").isNotNull()).select("rel_path", "kind", "size_bytes")
    raw = spark.read.format("binaryFile").load(target)
    kind = strings.classified(F.col("path"), F.col("content"))["kind"]
    known = F.when(kind.isNotNull(), kind).otherwise(F.raise_error(F.concat(F.lit("neither a document nor a picture: "), F.col("path"))))
    return raw.select(F.substring_index("path", "/", -1).alias("rel_path"), known.alias("kind"), F.col("length").alias("size_bytes"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(directory, name, extension, size_bytes): the content column is pruned, so files aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = relative(root)
    return raw.select(
        F.regexp_extract(rel, "^(.*)/[^/]*$", 1).alias("directory"), F.substring_index(rel, "/", -1).alias("name"), strings.extension(rel).alias("extension"), F.col("length").alias("size_bytes")
    )


def typed_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV table by its header; values that don't fit are null, rows without a required value go.

    Every column is read as text and cast, so that extra or reordered columns do no harm.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    typed = []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        column = F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")
        if kind == "boolean":
            typed.append((F.lower(F.trim(column)) == "true").alias(name))
        else:
            typed.append(column.try_cast(kind).alias(name))
    out = raw.select(*typed)
    for name in required:
        out = out.where(F.col(name).isNotNull())
    return out


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return typed_csv(spark, path, CANDIDATES, ("x0", "y0", "x1", "y1"))


def detections(spark: SparkSession, path: str, classes: list[str], least: float) -> DataFrame:
    return typed_csv(spark, path, DETECTIONS).where(F.col("detector_class").isin(classes) & (F.col("score") >= least))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows with the box parsed once; bad boxes are null."""
    raw = typed_csv(spark, path, ANNOTATIONS)
    return raw.withColumn("box", F.from_json("bbox", "array<double>"))


def numbered_files(paths: DataFrame, shards: int) -> DataFrame:
    """Contiguous shards of sorted paths for batch workers."""
    return paths.repartitionByRange(shards, "rel_path").sortWithinPartitions("rel_path").withColumn("shard", F.spark_partition_id())
