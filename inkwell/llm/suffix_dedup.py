"""Removal of repeated passages by distributed prefix doubling (operator 13).

A byte is removed if a string of ``threshold`` bytes that covers it also starts earlier. Strings
are told apart by ranks, as in the construction of a suffix array: positions get the rank of a
short string, Spark sorts the pairs of a position's rank and of what the string grows by,
equal pairs get one new rank, and positions whose rank is unique leave. Two things make the
rows few enough to sort:

* A row is not one position but a run of them: all strings of ``threshold`` bytes whose leftmost
  ``CORE``-byte part of least hash stands at one place, the anchor. Equal strings have it
  at the same offset, so a rank of that part alone, the first one, already parts most runs.
* Then the strings grow: a run is cut by a fixed grid of offsets, and all strings of a cell
  share a core that is longer the narrower the cell is (36, 85, 97, 100 bytes for cells of
  65, 16, 4, 1 offsets). A cell's pair is its run's rank and its core. Cells whose whole
  strings are equal need no further split: all but the first are covered. Of the others
  those stay open whose core has a second cell; those alone hold no repeated string.

Sorting is by ranges of (rank, added, position), so that a class of any size is dealt to
several tasks; what classes at the borders of ranges lack is added from two rows a range.
Ranks are numbers of sorted classes; only what a string grows by is compared by 64-bit
hashes, of the core and of the cell's whole string.

Defined cases: null and empty texts, and those shorter than the threshold, keep all their
bytes; null ids come after all others; of rows that share an id the one with the smaller hash
of its text comes first, and of rows equal in both the second and later ones count as repeats;
with no rows there are none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.backoff_lm import BASE, BYTE_VALUES, INVERSE, powers
from inkwell.llm.common import ARROW_ROWS, discarded, map_arrow, session_of, setting, utf8, written
from inkwell.llm.minhash import mix

CORE = 36
#: Offsets in a cell of each round; a whole run first.
WIDTHS = (None, 16, 4, 1)
#: Bytes of a long text, and of short ones together, that are hashed at a time.
PIECE, TOGETHER = 1 << 20, 1 << 17
#: Narrow rows travel in larger Arrow batches than texts.
NARROW = "20000"
KEY = ["doc_id", "tie"]
#: ``place`` holds the anchor's position and its least and greatest offset in a string.
BITS = 12


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Runs:
    """Runs of the strings of ``threshold`` bytes in texts, by their anchors."""

    def __init__(self, threshold: int):
        self.threshold, self.width = threshold, threshold - CORE + 1
        self.up, self.down = powers(BASE, PIECE), powers(INVERSE, PIECE)

    def of(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first and last starts, anchors, ranks) of the runs in texts side by side that end at ``ends``."""
        n, width = len(raw), self.width
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * self.up[:n], out=sums[1:])
        hashes = mix((sums[CORE:] - sums[:-CORE]) * self.down[: n - CORE + 1])
        least = sliding_least(hashes, width)
        inside = np.ones(len(least), bool)  # starts of strings that don't cross into the next text
        inside[(ends[:-1, None] - np.arange(1, self.threshold)).ravel()] = False
        edges = np.flatnonzero((least[1:] != least[:-1]) | (inside[1:] != inside[:-1])) + 1
        first, last = np.append(0, edges), np.append(edges, len(least)) - 1
        first, last = first[inside[first]], last[inside[first]]
        at = first + width - 1  # a hash below all before it has just come in
        known = (first > 0) & (least[first] < least[first - 1])
        search = first[~known]  # the least hash has gone: the leftmost of those that follow it
        at[~known] = search + (hashes[search[:, None] + np.arange(width)] == least[search][:, None]).argmax(1)
        several = np.flatnonzero(at < last)  # the least hash again: the leftmost one changes within
        if len(several):
            firsts, lasts, ats = [np.delete(first, several)], [np.delete(last, several)], [np.delete(at, several)]
            for i in several:
                s, e = first[i], last[i]
                places = s + np.flatnonzero(hashes[s : e + width] == least[s])
                begin = np.append(s, places[:-1] + 1)
                own = begin <= e
                firsts.append(begin[own])
                ats.append(places[own])
                lasts.append(np.minimum(places[own], e))
            first, last, at = (np.concatenate(x) for x in (firsts, lasts, ats))
            order = np.argsort(first)
            first, last, at = first[order], last[order], at[order]
        return first, last, at, least[first].view(np.int64)

    def of_long(self, text: bytes):
        """Yields (anchors, least and greatest offsets, ranks) of a long text, piece by piece."""
        begin = 0
        while len(text) - begin >= self.threshold:
            end = min(begin + PIECE, len(text))
            first, last, at, rank = self.of(np.frombuffer(text, np.uint8, end - begin, begin), np.array([end - begin]))
            keep = len(first) - (end < len(text))  # the last run may go on in the next piece
            yield (at + begin)[:keep], (at - last)[:keep], (at - first)[:keep], rank[:keep]
            if end == len(text):
                return
            begin += int(first[-1])

    def __call__(self, texts: list[bytes]):
        """Yields (rows, anchors, least and greatest offsets, ranks) of the texts, several at a time."""
        waiting, size = [], 0

        def done():
            row, ends = np.array(waiting), np.cumsum([len(texts[i]) for i in waiting])
            first, last, at, rank = self.of(np.frombuffer(b"".join(texts[i] for i in waiting), np.uint8), ends)
            k = np.searchsorted(ends, first, "right")
            return row[k], at - np.append(0, ends)[k], at - last, at - first, rank

        for i, text in enumerate(texts):
            if len(text) < self.threshold:
                continue
            if len(text) > TOGETHER:
                for at, lo, hi, rank in self.of_long(text):
                    yield np.full(len(at), i), at, lo, hi, rank
                continue
            if size + len(text) > TOGETHER:
                yield done()
                waiting, size = [], 0
            waiting.append(i)
            size += len(text)
        if waiting:
            yield done()


def packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (at.astype(np.int64) << 2 * BITS) | (lo << BITS) | hi


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 2 * BITS, (place >> BITS) & ((1 << BITS) - 1), place & ((1 << BITS) - 1)


def repeated(batch: pa.RecordBatch, rows: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch's key with further columns."""
    key = [batch.column(batch.schema.get_field_index(k)).take(pa.array(rows)) for k in KEY]
    return pa.record_batch([*key, *map(pa.array, more.values())], names=[*KEY, *more])


def first_ranks(texts: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, tie, place, rank) of all runs."""

    def step(batches):
        runs = Runs(threshold)
        for batch in batches:
            for row, at, lo, hi, rank in runs(utf8(batch, "text")):
                yield repeated(batch, row, place=packed(at, lo, hi), rank=rank)

    return map_arrow(texts, step, "doc_id long, tie long, place long, rank long")


def with_open_runs(source: DataFrame, key: list[str], open_runs: DataFrame) -> DataFrame:
    """Rows of ``source`` that have open runs, with their ``places`` and ``ranks``."""
    runs = open_runs.withColumn("anchor", F.shiftright("place", 2 * BITS)).groupBy(*key).agg(F.collect_list("place").alias("places"), F.collect_list("rank").alias("ranks"))
    other = {k: f"_{k}" for k in key}
    same = [F.col(k).eqNullSafe(F.col(o)) if k == "doc_id" else F.col(k) == F.col(o) for k, o in other.items()]
    return source.join(runs.hint("shuffle_hash").withColumnsRenamed(other), same).drop(*other.values())


def open_in(batch: pa.RecordBatch):
    """(texts, row, position in it, anchor, least and greatest offset, rank) of all open runs of a batch."""
    columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("places", "ranks", "begin")}
    place, rank = (np.asarray(columns[n].flatten()) for n in ("places", "ranks"))
    row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(columns["places"])))
    at, lo, hi = unpacked(place)
    return utf8(batch, "text"), row, at - np.asarray(columns["begin"])[row], at, lo, hi, rank


def pieces_of(texts: list[bytes], row: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """The stretches of the rows' texts."""
    return (texts[i][a:e] for i, a, e in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True))


def digests(pieces, seeds: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(p, s) for p, s in zip(pieces, seeds.tolist(), strict=True)], np.uint64).view(np.int64)


def contexts(texts: DataFrame, open_runs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, tie, anchor, begin, text), written: of each open run the bytes that its strings hold together."""

    def step(batches):
        for batch in batches:
            texts, row, here, at, lo, hi, _ = open_in(batch)
            own = list(pieces_of(texts, row, here - hi, here - lo + threshold))
            yield repeated(batch, row, anchor=at, begin=at - hi, text=own)

    rows = map_arrow(with_open_runs(texts, KEY, open_runs), step, "doc_id long, tie long, anchor long, begin long, text binary")
    return written(rows, "contexts")


def grown(source: DataFrame, key: list[str], open_runs: DataFrame, threshold: int, width: int | None) -> DataFrame:
    """(doc_id, tie, place, rank, added, whole): the cells of open runs, their core and their whole string as hashes."""
    top = threshold - CORE

    def step(batches):
        for batch in batches:
            texts, row, here, at, lo, hi, rank = open_in(batch)
            added = whole = np.zeros(len(at), np.int64)
            if width is not None:
                n = hi // width - lo // width + 1
                cell = np.repeat(lo // width, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, here, at, lo, hi, rank = (np.repeat(x, n) for x in (row, here, at, lo, hi, rank))
                lo, hi = np.maximum(lo, cell * width), np.minimum(hi, cell * width + width - 1)
                end = here - np.minimum(cell * width + width - 1, top) + threshold
                added = digests(pieces_of(texts, row, here - cell * width, end), cell)
                whole = np.zeros(len(at), np.int64)
            if width != 1:
                whole = digests(pieces_of(texts, row, here - hi, here - lo + threshold), lo << BITS | hi)
            yield repeated(batch, row, place=packed(at, lo, hi), rank=rank, added=added, whole=whole)

    return map_arrow(with_open_runs(source, key, open_runs), step, "doc_id long, tie long, place long, rank long, added long, whole long")


def reranked(rows: DataFrame, keys: list[str], alone: bool = True) -> DataFrame:
    """``rows`` with ``rank``, the number of their class by ``keys`` in sorted order, ``first``, true at a class's first position, and ``alone``.

    Rows are sorted by ranges. A task numbers the classes that it reads one after the other;
    a class that goes on in the next range is known from the ranges' first classes and last
    rows. ``alone=False`` leaves out classes of one row.
    """
    order = [*keys, F.col("doc_id").asc_nulls_last(), "tie", "place"]
    names = [*KEY, "place", *keys]
    schema = T.StructType([rows.schema[n] for n in names])
    for name, kind in (("class", T.LongType()), ("is_first", T.BooleanType()), ("is_alone", T.BooleanType()), ("border", T.BooleanType())):
        schema = schema.add(name, kind)

    def step(batches):
        part = TaskContext.get().partitionId()
        # of the row that waits for the next one: the class's number, same class as the row before, behind its first position
        held, number, went_on, behind = None, -1, False, False

        def judged(table: pa.RecordBatch, same_next: bool, final: bool):
            columns = {n: table.column(i) for i, n in enumerate(names)}
            values = [np.asarray(columns[k]) for k in keys]
            same = np.empty(len(values[0]), bool)
            same[0] = went_on
            same[1:] = np.logical_and.reduce([v[1:] == v[:-1] for v in values])
            position = [columns["doc_id"].is_null().to_numpy(zero_copy_only=False), columns["doc_id"].fill_null(0).to_numpy(), np.asarray(columns["tie"]), np.asarray(columns["place"])]
            moved = np.zeros(len(same), np.int64)
            moved[1:] = same[1:] & np.logical_or.reduce([p[1:] != p[:-1] for p in position])
            moved = np.cumsum(moved)
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            start[0] = 0
            later = (moved > moved[start]) | ((start == 0) & behind)
            classes = number + np.cumsum(~same) if held is None else number + np.cumsum(np.append(False, ~same[1:]))
            single = ~same & ~np.append(same[1:], same_next)
            border = classes == 0
            if final:
                border[-1] = True
            return same, later, classes, single, border

        def out(table, later, classes, single, border, rows):
            keep = np.arange(rows)[(~single | border)[:rows]] if not alone else np.arange(rows)
            made = [pa.array(c[:rows][keep]) for c in ((part << 40) + classes, ~later, single, border)]
            return pa.record_batch([*(c.take(pa.array(keep)) for c in table.columns), *made], names=schema.fieldNames())

        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch.select(names)
            if held is not None:
                table = pa.Table.from_batches([held, table]).combine_chunks().to_batches()[0]
            same, later, classes, single, border = judged(table, False, False)
            if table.num_rows > 1:
                yield out(table, later, classes, single, border, table.num_rows - 1)
            held = table.slice(table.num_rows - 1)
            number, went_on, behind = int(classes[-1]), bool(same[-1]), bool(later[-1])
        if held is not None:
            _, later, classes, single, border = judged(held, False, True)
            yield out(held, later, classes, single, border, 1)

    with setting(session_of(rows), ARROW_ROWS, NARROW):
        found = written(rows.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(step, schema), "ranks")
    # two rows a range: a class at its beginning, and its last row's
    borders = found.where("border").groupBy(*keys).agg(F.count("*").alias("_n"), F.min("class").alias("_class"))
    sorted_rows, found = found, found.join(F.broadcast(borders), keys, "left")
    first = F.col("is_first") & (F.col("_class").isNull() | (F.col("_class") == F.col("class")))
    single = F.col("is_alone") & (F.coalesce("_n", F.lit(1)) == 1)
    found = found.select(*KEY, "place", *[k for k in keys if k != "rank"], F.col("rank").alias("old_rank"), F.coalesce("_class", "class").alias("rank"), first.alias("first"), single.alias("alone"))
    found = found if alone else found.where("NOT alone")
    found.__dict__["_parts"] = sorted_rows
    return found


def covered_runs(texts: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, tie, place) of all runs of strings that also start earlier, written."""
    with setting(session_of(texts), ARROW_ROWS, "1000"):
        runs = written(first_ranks(texts, threshold), "runs")
    sorted_runs = reranked(runs, ["rank"], alone=False)
    discarded(runs)
    now, covered, used = sorted_runs.select(*KEY, "place", "rank"), [], [sorted_runs.__dict__["_parts"]]
    whole_texts, pieces = texts.withColumn("begin", F.lit(0).cast("long")), None
    for width in WIDTHS:
        if width is None:
            cells = written(grown(whole_texts, KEY, now, threshold, width), "cells")
        else:
            if pieces is None:  # few bytes are still open: they serve all further rounds
                pieces = contexts(whole_texts, now, threshold)
            cells = written(grown(pieces, [*KEY, "anchor"], now, threshold, width), "cells")
        for table in used:
            discarded(table)
        by_string = reranked(cells, ["rank", "added", "whole"])
        discarded(cells)
        covered.append(written(by_string.where("NOT first").select(*KEY, "place"), "covered"))
        if width == 1:
            break
        # equal cells are settled; different ones with one core stay open
        firsts = by_string.where("first").select(*KEY, "place", F.col("old_rank").alias("rank"), "added")
        by_core = reranked(firsts, ["rank", "added"], alone=False)
        now, used = by_core.select(*KEY, "place", "rank"), [by_string.__dict__["_parts"], by_core.__dict__["_parts"]]
    discarded(pieces)
    return reduce(DataFrame.unionByName, covered)


def spans(places: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the maximal runs of bytes that the strings cover."""
    at, lo, hi = unpacked(places)
    begin, end = at - hi, at - lo + threshold
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.append(True, begin[1:] > end[:-1])
    return begin[fresh], end[np.append(fresh[1:], True)]


def kept_bytes(text: bytes, begins: np.ndarray, ends: np.ndarray) -> bytes:
    edges = np.concatenate(([0], np.column_stack((begins, ends)).ravel(), [len(text)])).tolist()
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def without_repeats(docs: DataFrame, threshold: int = 100, text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the remaining bytes."""
    if not CORE < threshold < 1 << BITS:
        raise ValueError(f"threshold must be above {CORE} and below {1 << BITS}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    covered = covered_runs(texts, threshold).groupBy(*KEY).agg(F.collect_list("place").alias("places"))
    right = covered.hint("shuffle_hash").withColumnsRenamed({"doc_id": "_doc", "tie": "_tie"})
    joined = texts.join(right, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left").drop("_doc", "_tie")

    def step(batches):
        for batch in batches:
            rows, places = [], batch.column(batch.schema.get_field_index("places"))
            for i, text in enumerate(utf8(batch, "text")):
                own = places[i].values
                begins, ends = spans(own.to_numpy(), threshold) if own is not None and len(own) else (np.zeros(0, np.int64),) * 2
                kept = kept_bytes(text, begins, ends)
                rows.append((len(text), len(text) - len(kept), len(begins), hashlib.sha256(kept).hexdigest(), kept))
            sizes = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *sizes], names=[*KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_arrow(joined, step, "doc_id long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, threshold: int = 100, text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Rows that share id and text are added up before one of them is told from its repeats, so
    that no task gathers them.
    """
    found = without_repeats(docs, threshold, text_col).drop("kept")
    names = [n for n in found.columns if n != "tie"]
    same = found.groupBy(*found.columns).agg(F.count("*").alias("_n"))
    copies = same.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    gone = (F.col("_copy") > 1) & (F.col("n_bytes") >= threshold)
    nothing = hashlib.sha256(b"").hexdigest()
    return copies.withColumns({
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")),
        "n_spans": F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")),
        "kept_sha256": F.when(gone, F.lit(nothing)).otherwise(F.col("kept_sha256")),
    }).select(*names)
