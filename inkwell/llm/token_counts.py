"""Token counts kept in a digest cache (operator 3).

The cache is a Parquet folder of (tokenizer, digest, n_tokens): the tokenizer's version is
the digest of its model file, a text's key the SHA-256 of its normalised content (the
model's normaliser is the identity, so that is the text itself). A run joins the digests
of its texts to the cache, encodes one text of each distinct miss and appends the counts.

Defined cases: a null text counts as empty (0 tokens); equal texts are encoded once; rows
may repeat and ids may be null; with no rows there are none; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import fresh_path, join_weighted, map_arrow, session_of, utf8, written

MODEL = "piece_bpe_32k.model"
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


@functools.cache
def processor(model_path: str):
    """The library's processor, one for each Python worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def tokenizer_version(model_path: str) -> str:
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_counts(texts: DataFrame, model_path: str, version: str) -> DataFrame:
    """(tokenizer, digest, n_tokens) of rows (digest, text)."""

    def step(batches):
        for batch in batches:
            found = processor(model_path).encode([b.decode() for b in utf8(batch, "text")], num_threads=1)
            counts = pa.array([len(ids) for ids in found], pa.int64())
            yield pa.record_batch(
                [pa.array([version] * batch.num_rows, pa.string()), batch.column(0), counts],
                names=["tokenizer", "digest", "n_tokens"],
            )

    return map_arrow(texts.select("digest", "text"), step, CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache: str | None = None, model_path: str | None = None, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``cache``: a folder that all executors share; without one, the run starts with an
    empty cache of its own. Each run adds a folder of its own below it.
    """
    spark = session_of(docs)
    model_path = model_path or public_tokenizers.path(MODEL)
    version = tokenizer_version(model_path)
    run = uuid.uuid4().hex
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"))
    keyed = written(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    chosen = written(keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "misses")
    if cache is None:
        known, counts_path = None, fresh_path(spark, "token-counts")
    else:
        stored = spark.read.schema(CACHE_SCHEMA + ", run string").parquet(cache) if has_rows(spark, cache) else None
        known = stored and stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        counts_path = f"{cache.rstrip('/')}/run={run}"
    misses = chosen.drop("n")
    misses = misses if known is None else misses.join(known, "digest", "left_anti")
    of_text = F.unhex(F.sha2("text", 256))
    rows = texts.select("doc_id", of_text.alias("digest"), "text")
    # by digest and id together, equal texts spread over all tasks
    once = rows.join(misses.hint("shuffle_hash"), (rows.digest == misses.digest) & rows.doc_id.eqNullSafe(misses.first_id), "left_semi")
    encode_counts(once, model_path, version).write.parquet(counts_path)
    fresh = spark.read.schema(CACHE_SCHEMA).parquet(counts_path).select("digest", "n_tokens")
    if known is not None:
        path = fresh_path(spark, "token-lookup")
        hits = known.join(chosen, "digest", "left_semi")
        fresh.union(hits).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).write.parquet(path)
        fresh = spark.read.schema("digest binary, n_tokens long").parquet(path)
    elif has_repeated_rows(fresh):
        path = fresh_path(spark, "token-lookup")
        fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).write.parquet(path)
        fresh = spark.read.schema("digest binary, n_tokens long").parquet(path)
    # a common text's rows don't meet in one task
    counted = written(fresh.join(chosen.select("digest", "n"), "digest"), "token-lookup")
    return join_weighted(keyed, counted, ["digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def has_repeated_rows(lookup: DataFrame) -> bool:
    """True if one (id, text) row occurs twice, so that its text was encoded twice."""
    return bool(lookup.groupBy("digest").count().where("count > 1").limit(1).count())


def has_rows(spark, path: str) -> bool:
    """True if the cache folder holds a finished run; asks the file system that owns it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and any(x.isDirectory() and x.getPath().getName().startswith("run=") for x in files.listStatus(where))
