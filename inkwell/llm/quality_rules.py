"""Quality rules whose verdict also looks at the host (operator 10).

Each document is measured by itself. Failures are then counted by host, the rates are
shrunk towards an empirical beta prior, and each host's verdict is joined back. A host is
refused when its shrunk failure rate reaches ``host_limit``.

Defined cases: a null or empty text has no words and fails; a null host is a host of its
own; repeated rows are measured each; with no rows there are none; a host of one document
moves little from the prior; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import join_salted, map_arrow, spare, utf8, with_verdict, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: Neither white space nor the later bytes of a code point.
NOT_FIRST_IN_WORD = SPACES + bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at least twice."""
    if len(words) <= width:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(words) - width + 1
    keys = codes[:n]
    for k in range(1, width):
        if len(ids) ** (k + 1) >= 2**62:  # too many distinct words for exact keys: number the windows so far
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        keys = keys * len(ids) + codes[k : n + k]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(keys, twice))
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The five measures of one text, in the order of ``MEASURES``."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, NOT_FIRST_IN_WORD)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, host, the measures) of every row."""

    def step(batches):
        for batch in batches:
            columns = zip(*map(measure, utf8(batch, "text")), strict=True) if batch.num_rows else [[]] * 5
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *(pa.array(list(c), pa.int64()) for c in columns)],
                names=["doc_id", "host", *MEASURES],
            )

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return map_arrow(rows, step, f"doc_id {kind}, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def host_verdicts(failures: DataFrame, host_limit: float) -> DataFrame:
    """(host, host_rate, host_refused) from rows (host, failed).

    The prior's mean is the failure rate of all documents; its strength comes from the
    spread of the hosts' rates (method of moments), and is at least one document's worth.
    """
    return shrunk_verdicts(failures.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k")), host_limit)


def shrunk_verdicts(hosts: DataFrame, host_limit: float) -> DataFrame:
    """The same from counts (host, n, k) of a host's documents and failures."""
    rate = F.col("k") / F.col("n")
    prior = hosts.agg(
        (F.sum("k") / F.sum("n")).alias("mean"),
        F.avg(rate * rate).alias("m2"),
        F.avg(rate).alias("m1"),
        F.avg(1 / F.col("n")).alias("inv"),
    )
    noise = F.col("mean") * (1 - F.col("mean"))
    between = F.col("m2") - F.col("m1") * F.col("m1") - noise * F.col("inv")
    prior = prior.select(
        "mean",
        F.when(between > 0, F.greatest(noise / between - 1, F.lit(1.0))).otherwise(F.lit(1e6)).alias("strength"),
    )
    shrunk = (F.col("k") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    # the prior is one row: an aggregate over all hosts
    return hosts.join(F.broadcast(prior)).select("host", shrunk.alias("host_rate"), (shrunk >= host_limit).alias("host_refused"))


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    host_limit: float = 0.6,
) -> DataFrame:
    """One row per document: measures, base verdict, the host's shrunk rate and ``kept``."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = written(measured(docs, text_col).withColumn("base_failed", failed), "rules")
    verdicts = host_verdicts(rows.select("host", F.col("base_failed").alias("failed")), host_limit)
    return join_salted(rows, verdicts, "host", "doc_id").select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~F.col("host_refused")).alias("kept"), "host", "host_rate"
    )


def accepted(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, host_limit: float = 0.6, max_broadcast_hosts: int = 10_000) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns; texts don't move.

    The refused hosts go to all tasks where they are at most ``max_broadcast_hosts``, else they are joined.
    """

    def fails(texts: list[bytes]) -> list[bool]:
        return [n < min_words or 100 * r > max_repeat_percent * n for n, *_, r in map(measure, texts)]

    # texts are measured once: what passes is written, and each host's failures are its rows less those
    failed, refused_host = spare(docs, "_failed"), spare(docs, "_host")
    passed = written(with_verdict(docs, failed, fails, text_col).where(~F.col(failed)).drop(failed), "passed")
    host = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")
    every, kept = (df.groupBy(host).agg(F.count("*").alias(n)) for df, n in ((docs, "n"), (passed, "passed")))
    counts = every.join(kept, "host", "left").select("host", "n", (F.col("n") - F.coalesce("passed", F.lit(0))).alias("k"))
    refused = written(shrunk_verdicts(counts, host_limit).where("host_refused").select(F.col("host").alias(refused_host)), "hosts")
    n = refused.limit(max_broadcast_hosts + 1).count()
    if not n:
        return passed
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return passed.join(F.broadcast(refused) if n <= max_broadcast_hosts else refused, host == F.col(refused_host), "left_anti")
