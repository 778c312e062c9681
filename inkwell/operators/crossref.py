"""Cross-reference of targets against signers: statistics, pivots and summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.staging import materialised

#: Signers of a part, and parts of the targets that meet it.
SIGNERS, SALTS = 1000, 64


def by_target_and_signer(matches: DataFrame, signers: DataFrame) -> DataFrame:
    """(pdf, signer, n, mean, top, low) for every target and signer, zero where nothing matched.

    ``matches``: (pdf, signer, similarity), signer null where unmatched. The result has a row
    for every target and signer: signers are dealt to parts of about ``SIGNERS``, and a target
    meets each part's whole list. A single part goes to all tasks, several are copied for
    ``SALTS`` parts of the targets each.
    """
    names = materialised(signers.select("signer").distinct())
    parts = max(1, math.ceil(names.count() / SIGNERS))
    lists = names.groupBy(F.pmod(F.xxhash64("signer"), F.lit(parts)).cast("int").alias("_part")).agg(F.collect_list("signer").alias("_signers"))
    targets = matches.select("pdf").distinct()
    if parts == 1:
        met = targets.withColumn("_part", F.lit(0)).join(F.broadcast(lists), "_part")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        targets = targets.withColumn("_part", every).withColumn("_salt", F.pmod(F.xxhash64("pdf"), F.lit(SALTS)).cast("int"))
        met = targets.join(lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_part", "_salt"])
    frame = met.select("pdf", F.explode("_signers").alias("signer"))
    stats = matches.where("signer is not null").groupBy("pdf", "signer").agg(F.count("*").alias("n"), F.avg("similarity").alias("mean"), F.max("similarity").alias("top"), F.min("similarity").alias("low"))
    joined = frame.join(stats, ["pdf", "signer"], "left")
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return joined.select("pdf", "signer", zero("n", 0), zero("mean", 0.0), zero("top", 0.0), zero("low", 0.0))


def pivot_signers(signers: DataFrame, most: int = 1000) -> list:
    """The distinct signers of a one-column table in order; an error beyond ``most``, as none may go missing."""
    found = sorted(r[0] for r in signers.distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} signers for the columns of a pivot: take the long form (f25_presence_long)")
    return found


def presence_pivot(stats: DataFrame, signers: list) -> DataFrame:
    """A row for each target with count, presence and similarity of each signer."""
    wide = stats.groupBy("pdf").pivot("signer", signers).agg(F.first("n").alias("Count"), F.first("mean").alias("Similarity"))
    columns = [F.col("pdf")]
    for s in signers:
        columns += [F.col(f"{s}_Count").alias(f"signer_{s}_count"), F.when(F.col(f"{s}_Count") > 0, "Yes").otherwise("No").alias(f"signer_{s}_present"), F.round(F.col(f"{s}_Similarity"), 4).alias(f"signer_{s}_similarity")]
    found = sum((F.when(F.col(f"{s}_Count") > 0, 1).otherwise(0) for s in signers), F.lit(0))
    return wide.select(*columns, found.alias("signers_found"))


def bitmaps(sets: list, known: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each set; bit k stands for the k-th of the ``known`` values."""
    words = np.zeros((len(sets), max(1, -(-len(known) // 64))), np.uint64)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.searchsorted(known, np.concatenate(sets))
    np.bitwise_or.at(words, (rows, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return words


def names_of(words: np.ndarray, known: np.ndarray) -> list[str]:
    """The values of each bitmap, in order, joined by commas."""
    kinds, where = np.unique(np.ascontiguousarray(words).view([("", np.uint64)] * words.shape[1]).ravel(), return_inverse=True)
    bits = np.unpackbits(kinds.view(np.uint8).reshape(len(kinds), -1), axis=1, bitorder="little")[:, : len(known)]
    texts = np.array([",".join(map(str, known[b.astype(bool)])) for b in bits], object)
    return texts[where].tolist()


def shared_signers(assignments: DataFrame, left: str = "pdf", least: int = 1, block_rows: int = 1000) -> DataFrame:
    """(pdf_a, pdf_b, common, signers) of document pairs that share at least ``least`` signers.

    Each document's signers are a bitmap; pairs of blocks of documents meet in tasks, where the
    bitmaps of both are and-ed and their bits counted, 64 documents against a block at a time.
    A signer whom most documents share costs a bit, not a join; what is made are the pairs alone.
    """
    kind = dict(assignments.dtypes)
    sets = assignments.select(left, "signer").distinct().groupBy(left).agg(F.collect_list("signer").alias("signers"))  # of one document
    sets = materialised(sets)
    n = max(1, math.ceil(sets.count() / block_rows))
    own = sets.withColumn("own", F.pmod(F.xxhash64(left), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = own.select(left, "signers", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
        one, two = part[part["own"] == lo], part[part["own"] == hi]
        found = []
        if len(one) and len(two):
            known = np.unique(np.concatenate(part["signers"].tolist()))
            x, y = (bitmaps(side["signers"].tolist(), known) for side in (one, two))
            ids, others = one[left].to_numpy(), two[left].to_numpy()
            for at in range(0, len(one), 64):
                both = x[at : at + 64, None] & y[None]
                counts = np.bitwise_count(both).sum(2)
                enough = counts >= least
                if lo == hi:
                    enough &= ids[at : at + 64, None] < others[None]
                i, j = np.nonzero(enough)
                a, b = ids[at + i], others[j]
                found.append(pd.DataFrame({"pdf_a": np.minimum(a, b), "pdf_b": np.maximum(a, b), "common": counts[i, j].astype("int64"), "signers": names_of(both[i, j], known) if len(i) else []}))
        return pd.concat(found) if found else pd.DataFrame(columns=["pdf_a", "pdf_b", "common", "signers"])

    return rows.groupBy("lo", "hi").applyInPandas(cell, f"pdf_a {kind[left]}, pdf_b {kind[left]}, common long, signers string")
