"""Folder trees as a table, one partition for each directory.

The reader lists what Spark's own file sources hide: files whose names begin with ``_``. Files
that begin with a dot, directories that do and ``__pycache__`` are noise and never appear;
links are listed as skipped. Filters on name and size are pushed to the listing, so that the
content of other files isn't read; without ``content`` none is.

Directories are found by the driver, a name for each; files are listed where a partition is
read. Paths may be of any store that pyarrow opens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from inkwell.functions import strings

LISTING = "directory string, name string, size_bytes bigint, modified timestamp, is_link boolean, content binary"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
TESTS = {
    EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y,
    StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__,
}


class Directory(InputPartition):
    """One directory, by its path below the root."""


def hidden(name: str) -> bool:
    return name.startswith(".") or name == "__pycache__"


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def entries(path: str) -> list:
    """What stands in a directory, in name order."""
    from pyarrow import fs

    store, base = store_of(path)
    return sorted(store.get_file_info(fs.FileSelector(base)), key=lambda f: f.base_name)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.content = options.get("content", "false").lower() == "true"
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of name and size; the others are left to Spark."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("name",), ("size_bytes",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def is_link(self, below: str) -> bool:
        store, base = store_of(self.root)
        return store.type_name == "local" and os.path.islink(f"{base}/{below}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        found, waiting = [], [""]
        while waiting:
            below = waiting.pop()
            found.append(Directory(below))
            own = [f"{below}/{e.base_name}".lstrip("/") for e in entries(f"{self.root}/{below}".rstrip("/")) if e.type == fs.FileType.Directory and not hidden(e.base_name)]
            waiting += [d for d in reversed(own) if not self.is_link(d)]
        return found

    def wanted(self, name: str, size: int) -> bool:
        own = {"name": name, "size_bytes": size}
        return all(TESTS[kind](own[column], value) for column, kind, value in self.tests)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        below = partition.value
        for e in entries(f"{self.root}/{below}".rstrip("/")):
            path = f"{below}/{e.base_name}".lstrip("/")
            link = self.is_link(path)
            if hidden(e.base_name) or (e.type != fs.FileType.File and not link):
                continue
            size = e.size or 0
            if not self.wanted(e.base_name, size):
                continue
            content = None
            if self.content and not link:
                store, _ = store_of(self.root)
                with store.open_input_stream(e.path, compression=None) as f:
                    content = f.read()
            time = e.mtime.astimezone(UTC) if e.mtime else None
            columns = [([below], pa.string()), ([e.base_name], pa.string()), ([size], pa.int64()), ([time], pa.timestamp("us", "UTC")), ([link], pa.bool_()), ([content], pa.binary())]
            yield pa.record_batch([pa.array(v, t) for v, t in columns], names=["directory", "name", "size_bytes", "modified", "is_link", "content"])


class FolderSource(DataSource):
    """``spark.read.format("folder_tree").option("content", "true").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(rel_path, directory, name, size_bytes, modified, is_link, content) of all files below a root; content is null unless asked for."""
    spark.dataSource.register(FolderSource)
    spark.conf.set(PUSHDOWN, "true")
    rows = spark.read.format("folder_tree").option("content", str(content).lower()).load(root)
    return rows.withColumn("rel_path", F.when(F.col("directory") == "", F.col("name")).otherwise(F.concat_ws("/", "directory", "name")))


def judged(files: DataFrame) -> DataFrame:
    """A listing with content, and of each file kind, how it was told, and the reason if it is skipped."""
    c = strings.classified(F.col("rel_path"), F.col("content"))
    found = files.withColumn("c", c).select(*files.columns, "c.kind", "c.how")
    archive = strings.extension(F.col("name")).isin(*strings.ARCHIVES)
    return found.withColumn("reason", F.when(F.col("is_link"), "link").when(archive, "archive").when(F.col("kind").isNull(), "unknown kind"))


def records_and_skipped(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a listing with content: records (rel_path, grp, kind, how, sha256, size_bytes, mtime_utc), and (rel_path, reason) of what isn't one."""
    known = judged(files)
    group = F.when(F.col("directory") == "", ".").otherwise(F.col("directory"))
    records = known.where("reason is null").select(
        "rel_path", group.alias("grp"), "kind", "how", F.sha2("content", 256).alias("sha256"), "size_bytes", strings.iso_seconds(F.col("modified")).alias("mtime_utc")
    )
    return records, known.where("reason is not null").select("rel_path", "reason")
