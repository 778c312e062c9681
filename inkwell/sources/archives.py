"""Archives unpacked by a table function: one row for each member, statuses instead of errors."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MEMBERS = "archive string, depth int, member string, status string, size_bytes long, content binary"


def unsafe(name: str) -> bool:
    """Absolute, drive or parent paths."""
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or (len(parts[0]) == 2 and parts[0].endswith(":"))


#: First bytes of single compressed files, and what opens them.
STREAMS = ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ\x00", lzma.open))


#: First bytes of archives that nothing here opens: RAR and 7z.
UNSUPPORTED = (b"Rar!\x1a\x07", b"7z\xbc\xaf\x27\x1c")


def single(content: bytes, most_bytes: int) -> Iterator[tuple[str, str, int, bytes | None]]:
    """The one file in a compressed stream; it has no name of its own."""
    for magic, opened in STREAMS:
        if content.startswith(magic):
            try:
                with opened(io.BytesIO(content)) as f:
                    data = f.read(most_bytes + 1)
            except (OSError, EOFError, lzma.LZMAError):
                break
            yield ("content", "too_large", len(data), None) if len(data) > most_bytes else ("content", "ok", len(data), data)
            return
    yield "", "bad", len(content), None


def members(content: bytes, most_bytes: int) -> Iterator[tuple[str, str, int, bytes | None]]:
    """(name, status, size, content) of each file in a zip or tar archive, or of the one in a compressed stream."""
    if content.startswith(UNSUPPORTED):
        yield "", "unsupported", len(content), None
        return
    try:
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    if unsafe(info.filename):
                        yield info.filename, "unsafe", info.file_size, None
                    elif info.flag_bits & 1:
                        yield info.filename, "encrypted", info.file_size, None
                    elif info.file_size > most_bytes:
                        yield info.filename, "too_large", info.file_size, None
                    else:
                        try:
                            yield info.filename, "ok", info.file_size, z.read(info)
                        except (zipfile.BadZipFile, OSError, RuntimeError):
                            yield info.filename, "failed", info.file_size, None
            return
        try:
            tar = tarfile.open(fileobj=io.BytesIO(content))
        except (tarfile.TarError, OSError, EOFError, lzma.LZMAError):
            yield from single(content, most_bytes)
            return
        with tar as t:
            for info in t:
                if info.isdir():
                    continue
                if unsafe(info.name) or not info.isfile():
                    yield info.name, "unsafe", info.size, None
                elif info.size > most_bytes:
                    yield info.name, "too_large", info.size, None
                else:
                    yield info.name, "ok", info.size, t.extractfile(info).read()
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError):
        yield "", "bad", len(content), None


def arrow_schema(columns: str) -> pa.Schema:
    """The Arrow form of a schema's text; made on the driver."""
    return to_arrow_schema(T._parse_datatype_string(columns))


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 1000, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches that end with the row that reaches ``most_rows``, or ``most_bytes`` of text and content."""
    some, held = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        some.append(row)
        held += sum(len(v) for v in row if isinstance(v, bytes | str))
        if len(some) >= most_rows or held >= most_bytes:
            yield made()
            some, held = [], 0
    if some:
        yield made()


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def unpacked(archives: DataFrame, depth: int, most_bytes: int) -> DataFrame:
    """Members of rows (rel_path, content)."""
    schema = arrow_schema(MEMBERS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((path, depth, *m) for path, content in rows_of(batches) for m in members(content, most_bytes))
        return in_batches(found, schema)

    return archives.select("rel_path", "content").mapInArrow(step, MEMBERS)


def is_archive(name, content):
    """By name, else by magic; zip-based documents and later volumes aren't."""
    from inkwell.functions.strings import container_kind

    return container_kind(name, content).isNotNull()


def unpack_all(archives: DataFrame, max_depth: int = 3, most_bytes: int = 1 << 28) -> DataFrame:
    """Members of archives and of the archives in them, breadth first down to ``max_depth``.

    A member is a row and must fit a task: those above ``most_bytes`` are listed as
    ``too_large``, without content. RAR and 7z archives need a library that isn't there and are
    ``unsupported``.
    """
    from inkwell.operators.staging import materialised

    found, level = None, archives
    for depth in range(max_depth):
        out = materialised(unpacked(level, depth, most_bytes))
        found = out if found is None else found.unionByName(out)
        inner = out.where((F.col("status") == "ok") & is_archive(F.col("member"), F.col("content")))
        level = inner.select(F.concat_ws("!", "archive", "member").alias("rel_path"), "content")
        if not level.limit(1).count():
            break
    return found


def extraction_manifest(members_: DataFrame) -> DataFrame:
    """(archive, depth, files, bytes, unsafe_entries_skipped, failed_members, status)."""
    status = F.col("status")
    m = members_.groupBy("archive", "depth").agg(
        F.count_if(status == "ok").alias("files"), F.coalesce(F.sum(F.when(status == "ok", F.col("size_bytes"))), F.lit(0)).alias("bytes"), F.count_if(status == "unsafe").alias("unsafe_entries_skipped"),
        F.count_if(status.isin("failed", "encrypted", "too_large")).alias("failed_members"), F.count_if(status == "bad").alias("_bad"), F.count_if(status == "unsupported").alias("_unsupported"),
    )
    return m.withColumn("status", F.when(F.col("_bad") > 0, "bad").when(F.col("_unsupported") > 0, "unsupported").when(F.col("failed_members") + F.col("unsafe_entries_skipped") > 0, "partial").otherwise("ok")).drop("_bad", "_unsupported")
