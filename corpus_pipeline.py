"""From documents to pieces: five stages, each written as Parquet before the next reads it.

Defined cases: rows without an id pass every stage on their text alone (they are never
near-duplicates of another row); null texts are empty and fall to the quality rules; an
empty table gives an empty result; further columns of the documents are carried to the
last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import minhash, mixing, piece_transducer, quality_classifier, quality_rules
from inkwell.llm.common import table, written

#: Exponents of the mixture's target shares: nearer to the observed ones than the operator's own.
MIXTURE = {"source": 0.7, "lang": 0.85, "topic": 0.85}


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's record keep."""
    return quality_rules.accepted(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is trained on what is left."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8."""
    return minhash.deduplicated(docs, width=5, threshold=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their target shares."""
    return mixing.sampled(docs, MIXTURE)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the piece ids of the whole texts."""
    return piece_transducer.encode(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("minhash_dedup", near_dedup),
    ("mixing", mixture),
    ("piece_transducer", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, near-duplicates and pieces are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None
