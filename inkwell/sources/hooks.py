"""Extractors and scorers by name: a column says for each row which one is meant.

``extract_archive`` is a polymorphic table function: SQL calls it by lateral join, and whether it
has a content column follows from its arguments when the query is planned. What it may call
stands in ``EXTRACTORS``; further kinds are added with ``extractor``. Scorers are column
expressions, so that pairs stay in the JVM. A name that nothing is registered for is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import BinaryType, LongType, StringType, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from inkwell.functions.vectors import cosine
from inkwell.sources import archives

Extractor = Callable[[bytes, int], Iterator[tuple[str, str, int, bytes | None]]]
#: By kind: yields (member, status, size, content) of an archive's bytes.
EXTRACTORS: dict[str, Extractor] = {"zip": archives.members, "tar": archives.members, "rar": archives.members, "7z": archives.members}
#: By name: the score of two vectors.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine,
    "vgg": lambda a, b: cosine(F.slice(a, 1, 32), F.slice(b, 1, 32)),
    "vit": lambda a, b: cosine(F.slice(a, 33, 32), F.slice(b, 33, 32)),
}


def extractor(kind: str) -> Callable[[Extractor], Extractor]:
    """Registers an extractor of a kind, before the function is registered with a session."""

    def register(f: Extractor) -> Extractor:
        EXTRACTORS[kind] = f
        return f

    return register


class ExtractArchive:
    """``extract_archive(kind, content, with_content, most_bytes)``: a row for each member."""

    @staticmethod
    def analyze(kind: AnalyzeArgument, content: AnalyzeArgument, with_content: AnalyzeArgument, most_bytes: AnalyzeArgument) -> AnalyzeResult:
        if kind.dataType != StringType() or content.dataType != BinaryType():
            raise ValueError("extract_archive takes a kind (string) and a content (binary)")
        if with_content.value is None or most_bytes.value is None:
            raise ValueError("with_content and most_bytes must be constants")
        schema = StructType().add("member", StringType()).add("status", StringType()).add("size_bytes", LongType())
        return AnalyzeResult(schema.add("content", BinaryType()) if with_content.value else schema)

    def __init__(self):
        self.known = dict(EXTRACTORS)

    def eval(self, kind, content, with_content, most_bytes):
        if kind not in self.known:
            raise ValueError(f"no extractor of the name {kind!r}; there are {', '.join(sorted(self.known))}")
        for name, status, size, data in self.known[kind](bytes(content), most_bytes):
            yield (name, status, size, data) if with_content else (name, status, size)


def register(spark: SparkSession) -> None:
    """Makes ``extract_archive`` known to a session's SQL."""
    spark.udtf.register("extract_archive", UserDefinedTableFunction(ExtractArchive, returnType=None, name="extract_archive"))


def extracted(archives_: DataFrame, kind: str = "kind", with_content: bool = True, most_bytes: int = 1 << 28) -> DataFrame:
    """The columns of ``archives_`` but ``content``, and those of each member: a lateral join with the function."""
    spark = archives_.sparkSession
    register(spark)
    keep = ", ".join(f"a.`{c}`" for c in archives_.columns if c != "content")
    call = f"SELECT {keep}, m.* FROM {{archives}} a, LATERAL extract_archive(a.`{kind}`, a.content, {str(with_content).lower()}, {most_bytes}) m"
    return spark.sql(call, archives=archives_)


def scored(pairs: DataFrame, scorer: str, a: str, b: str) -> Column:
    """The score of columns ``a`` and ``b`` of ``pairs`` by the scorer that column ``scorer`` names."""
    found = F.raise_error(F.concat(F.lit("no scorer of the name "), F.coalesce(F.col(scorer), F.lit("null")))).cast("double")
    for name, score in SCORERS.items():
        found = F.when(F.col(scorer) == name, score(F.col(a), F.col(b))).otherwise(found)
    return found
