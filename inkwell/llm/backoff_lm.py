"""Stupid-backoff scores of all documents under trigram counts of the same corpus (operator 6).

S(w | u v) is c(u v w) / c(u v) where c(u v w) reaches ``min_count``, else ``alpha`` S(w | v);
S(w | v) is c(v w) / c(v) where c(v w) reaches it, else ``alpha`` c(w) / N. A first word
scores c(w) / N, a second one S(w | v). A document's score is the sum of their logs.

1. Documents are written as packs of about two megabytes.
2. A pack is exploded into its n-grams of one to ``ORDERS`` words. Its distinct ones are dealt to
   parts of the 64-bit hashes, one row for each pack and part: sorted, as differences of about
   six bytes, with how often they occur in the pack.
3. A part adds up its n-grams over all packs, which is its count table, and joins the table to
   each pack's row: the corpus-wide counts of the pack's n-grams, in their order.
4. A pack and its counts from all parts meet; every word finds the counts of the n-grams that
   end there and of their contexts, and the logs are summed by document.

The most frequent n-gram is one entry of each pack, so that no part is larger than others.
Hashes are taken in ``slices``, so that only a slice's rows are on disk at a time; each slice
reads the packs again. A task holds one pack, or one part of about ``PART_BYTES`` of text.

Words are what white space parts, A-Z folded. Words and n-grams are known by 64-bit
hashes; two that share one would be taken as one.

Defined cases: a null or empty text has no tokens, log score 0 and null mean; very long
texts are a pack of their own, hashed piece by piece; repeated rows count and are scored each;
null ids stay; with no rows there are none; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import ARROW_ROWS, discarded, map_arrow, session_of, setting, utf8, written
from inkwell.llm.minhash import ODD, mix

ORDERS = 3
#: Bytes of text that are hashed at a time, of a pack, and whose n-grams a part holds about.
CHUNK_BYTES, PACK_BYTES, PART_BYTES = 1 << 20, 2 << 20, 8 << 20
#: Parts of a slice at least.
PARTS = 64
_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(_rng.integers(0, 2**63)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.cumprod(found)


class Hasher:
    """Hashes of the words of a byte string: sums of byte values times powers, moved to the word's start."""

    def __init__(self):
        self.up, self.down = powers(BASE, CHUNK_BYTES + 1), powers(INVERSE, CHUNK_BYTES + 1)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of a string of at most ``CHUNK_BYTES``."""
        raw = UPPER[np.frombuffer(text, np.uint8)]
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = SPACE[raw]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * self.up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * ODD), starts


@functools.cache
def hasher() -> Hasher:
    """One for each Python worker."""
    return Hasher()


def pieces(text: bytes):
    """``text`` in parts of at most ``CHUNK_BYTES``, cut after white space where there is any."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        part = text[at : at + CHUNK_BYTES]
        end = max((part.rfind(c) for c in b"\t\n\x0b\x0c\r "), default=-1) + 1
        yield part[:end] if end else part
        at += end or CHUNK_BYTES
    yield text[at:]


def words_of(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words by document) of documents that end at ``ends``, a line break between two."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for part in pieces(text):
        found, begin = hasher()(part)
        hashes.append(found)
        starts.append(begin + at)
        at += len(part)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def n_grams(words: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order: the places where an n-gram ends, and their hashes."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    mixed = mix(words)
    pair = np.zeros(len(words), np.uint64)
    pair[1:] = mix(words[:-1] * ODD + mixed[1:])
    second, third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
    return [(np.arange(len(words)), words), (second, pair[second]), (third, mix(pair[third - 1] * ODD + mixed[third]))]


def packs(docs: DataFrame, text_col: str) -> DataFrame:
    """(pack, size, ids, ends, text), written: documents side by side, a line break between two."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def step(batches):
        number, ids, found, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row():
            ends = np.cumsum([len(t) + 1 for t in found]) - 1
            columns = [pa.array([number]), pa.array([size]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([b"\n".join(found)], pa.binary())]
            return pa.record_batch(columns, names=["pack", "size", "ids", "ends", "text"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch, "text"), strict=True):
                if found and size + len(text) > PACK_BYTES:
                    yield row()
                    number, ids, found, size = number + 1, [], [], 0
                ids.append(i)
                found.append(text)
                size += len(text) + 1
        if found:
            yield row()

    return written(map_arrow(texts, step, "pack long, size long, ids array<long>, ends array<long>, text binary"), "packs")


def rows_of(table: pa.RecordBatch | pa.Table):
    """Yields (pack, ends, text) of packs."""
    for pack, ends, text in zip(*(table.column(n) for n in ("pack", "ends", "text")), strict=True):
        yield pack.as_py(), ends.values.to_numpy(), text.as_py()


def edges_of(slices: int, parts: int) -> np.ndarray:
    """Where the parts of all slices begin in the 64-bit hashes."""
    return np.array([(k << 64) // (slices * parts) for k in range(slices * parts)], np.uint64)


def small_numbers(n: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers as single bytes, and those from 255 on besides."""
    return np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.int64).tobytes()


def numbers(low: bytes, more: bytes) -> np.ndarray:
    n = np.frombuffer(low, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(more, np.int64)
    return n


def differences(values: np.ndarray, begin: np.uint64) -> bytes:
    """Sorted values as differences of as many bytes as the largest takes."""
    d = np.diff(values, prepend=begin).astype("<u8")
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def summed_up(data: bytes, n: int, begin: np.uint64) -> np.ndarray:
    d = np.zeros((n, 8), np.uint8)
    d[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return begin + np.cumsum(d.view("<u8").ravel())


def dealt(packed: DataFrame, number: int, slices: int, parts: int) -> DataFrame:
    """(part, pack, grams, low, more): the distinct n-grams of each pack in a slice, by part, and how often they occur there."""
    edges = edges_of(slices, parts)
    own = slice(number * parts, (number + 1) * parts)

    def step(batches):
        for batch in batches:
            for pack, ends, text in rows_of(batch):
                low = edges[own][0]
                grams = np.concatenate([g for _, g in n_grams(*words_of(text, ends))])
                grams = grams[grams >= low] if own.stop == len(edges) else grams[(grams >= low) & (grams < edges[own.stop])]
                found, n = np.unique(grams, return_counts=True)
                cuts = np.append(np.searchsorted(found, edges[own]), len(found))
                rows = [(k, pack, differences(found[a:b], edges[k]), *small_numbers(n[a:b])) for k, a, b in zip(range(own.start, own.stop), cuts.tolist(), cuts[1:].tolist(), strict=False) if b > a]
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "pack", "grams", "low", "more"]) if rows else EMPTY

    EMPTY = pa.record_batch([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())], names=["part", "pack", "grams", "low", "more"])  # noqa: N806
    return map_arrow(packed.select("pack", "ends", "text"), step, "part long, pack long, grams binary, low binary, more binary")


def counted(rows: DataFrame, slices: int, parts: int) -> DataFrame:
    """(part, pack, low, more): for each pack's n-grams of a part, how often they occur in the corpus."""
    edges = edges_of(slices, parts)

    def join(table: pa.Table) -> pa.Table:
        begin = edges[table.column("part")[0].as_py()]
        data = list(zip(*(table.column(n).to_pylist() for n in ("grams", "low", "more")), strict=True))
        sizes = [len(low) for _, low, _ in data]
        grams = np.concatenate([summed_up(g, n, begin) for (g, _, _), n in zip(data, sizes, strict=True)])
        found, where = np.unique(grams, return_inverse=True)
        total = np.bincount(where, np.concatenate([numbers(low, more) for _, low, more in data]), len(found)).astype(np.int64)
        sent = [small_numbers(n) for n in np.split(total[where], np.cumsum(sizes)[:-1])]
        return pa.table([table.column("part"), table.column("pack"), pa.array([x for x, _ in sent], pa.binary()), pa.array([y for _, y in sent], pa.binary())], names=["part", "pack", "low", "more"])

    return rows.groupBy("part").applyInArrow(join, "part long, pack long, low binary, more binary")


def scored(packed: DataFrame, counts: DataFrame, min_count: int, alpha: float) -> DataFrame:
    """(doc_id, n_tokens, part_score, n_words): the sum of logs but for the size of the corpus, which counts once for each of ``n_words``."""

    def join(pack: pa.Table, table: pa.Table) -> pa.Table:
        ids, n_tokens, sums, rest = [], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for (_, ends, text), own in zip(rows_of(pack), pack.column("ids"), strict=True):
            words, n = words_of(text, ends)
            orders = n_grams(words, n)
            order = np.argsort(table.column("part").to_numpy())
            low, more = (table.column(c).to_pylist() for c in ("low", "more"))
            known = np.concatenate([np.zeros(0, np.int64), *(numbers(low[k], more[k]) for k in order.tolist())])
            _, where = np.unique(np.concatenate([g for _, g in orders]), return_inverse=True)
            c1, c2, c3 = np.split(known[where], np.cumsum([len(g) for _, g in orders])[:-1])
            place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            logs, single = np.log(np.maximum(c1, 1)) + math.log(alpha) * np.minimum(place, 2), np.ones(len(words), bool)
            two = np.zeros(len(words), np.int64)
            two[orders[1][0]] = c2
            at = orders[1][0][c2 >= min_count]
            logs[at] = np.log(two[at]) - np.log(c1[at - 1]) + math.log(alpha) * (place[at] > 1)
            single[at] = False
            often = c3 >= min_count
            at = orders[2][0][often]
            logs[at] = np.log(c3[often]) - np.log(two[at - 1])
            single[at] = False
            text_of = np.repeat(np.arange(len(n)), n)
            ids += own.as_py()
            n_tokens.append(n)
            sums.append(np.bincount(text_of, logs, len(n)))
            rest.append(np.bincount(text_of[single], minlength=len(n)))
        columns = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(c)) for c in (n_tokens, sums, rest))]
        return pa.table(columns, names=["doc_id", "n_tokens", "part_score", "n_words"])

    both = packed.select("pack", "ids", "ends", "text").groupBy("pack").cogroup(counts.groupBy("pack"))
    return both.applyInArrow(join, "doc_id long, n_tokens long, part_score double, n_words long")


def backoff_scores(docs: DataFrame, min_count: int = 2, alpha: float = 0.4, slices: int = 2, text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, log_score, mean_log_score."""
    packed = packs(docs, text_col)
    size = packed.agg(F.sum("size")).first()[0] or 0
    parts = max(PARTS, -(-size // (slices * PART_BYTES)))
    with setting(session_of(docs), ARROW_ROWS, "4"):  # rows of packs are large
        counts = [written(counted(dealt(packed, k, slices, parts), slices, parts), "counts") for k in range(slices)]
        rows = written(scored(packed, reduce(DataFrame.unionByName, counts), min_count, alpha), "scores")
    for table in (packed, *counts):
        discarded(table)
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    log_score = F.col("part_score") - F.col("n_words") * math.log(max(total, 1))
    return rows.select("doc_id", "n_tokens", log_score.alias("log_score"), F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).alias("mean_log_score"))
