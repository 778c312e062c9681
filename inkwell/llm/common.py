"""What several operators share: inputs, Arrow steps, written cuts and components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch: texts can be long, so that batches stay small.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in a local session where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for as long as a block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors.

    What the write shuffled is of no use afterwards and is removed with it.
    """
    path = fresh_path(session_of(df), what)
    with setting(session_of(df), CLEAN_UP, "true"):
        df.write.parquet(path)
    found = session_of(df).read.schema(df.schema).parquet(path)
    found.__dict__["_written_to"] = path
    return found


def discarded(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``df``, once nothing reads it any more."""
    path = df.__dict__.get("_written_to")
    if path:
        spark = session_of(df)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows."""
    spark = session_of(df)
    if int(spark.conf.get(ARROW_ROWS)) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    return df.mapInArrow(step, schema)


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_verdict(docs: DataFrame, name: str, judge: Callable[[list[bytes]], list[bool]], text_col: str = "text") -> DataFrame:
    """``docs`` with a boolean column that ``judge`` gives for the texts of a batch; no row moves."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BooleanType())])

    def step(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(judge(utf8(batch, text_col)), pa.bool_())], names=[*batch.schema.names, name])

    return map_arrow(docs, step, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def buckets_of(*columns: Column, n: int) -> Column:
    """A number from 0 to n - 1 that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def join_salted(rows: DataFrame, small: DataFrame, key: str, by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Equi-join on ``key`` where one key may hold a third of ``rows``: they go to ``salts`` tasks by ``by``."""
    left = rows.withColumn("_salt", buckets_of(F.col(by), n=salts))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def join_weighted(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", weight: str = "n", most: int = 1000) -> DataFrame:
    """Equi-join on ``keys`` where ``small`` says by ``weight`` how many rows a key has.

    Keys of at least one in ``most`` rows, ``most`` of them at the outside, go to all tasks
    with what ``small`` has of them; the others meet by hash, and none of them fills a task.
    Both tables are read twice and had better be written ones.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    heavy = F.broadcast(small.where(F.col(weight) * most >= total).drop(weight))
    light = small.where(F.col(weight) * most < total).drop(weight)
    there = rows.join(heavy, keys)
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how)
    return there.unionByName(rest)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every end of the undirected edges (a, b): the smallest id reachable.

    Alternates two steps until no edge changes: every node links its larger neighbours
    to its smallest one, then its smaller ones to that. Each is an aggregate and a join
    that deals a hot node's edges out; the edges are written after each round.
    """

    def canonical(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(canonical(edges), "edges")
    before = state(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a hub's edges go to several tasks; dealt out once, the new links serve both uses below
        large = join_salted(both.where("b > a"), least, "a", "b", "inner", salts=4)
        large = canonical(large.select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        old, now = now, written(canonical(small), "edges")
        discarded(old)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id").union(
        now.select("b", F.col("b")).distinct()
    ).toDF("id", "component_id")
