"""Detector boxes: suppression, reconciliation with page objects, evaluation."""

from __future__ import annotations

import bisect
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.functions.geometry import covered_fraction, iou, overlap_of_smaller
from inkwell.operators.staging import materialised, sent_if_small

BOX = "struct<id:bigint,score:double,b:struct<x0:double,y0:double,x1:double,y1:double>>"
#: What explains a box, the most specific first.
PRIORITY = ("vector_ink", "pasted_image", "scanned_wet_ink")
ROLE_OF = {"ink": 1, "placed_image": 2, "full_page_scan": 3}


def suppress_nested(boxes: DataFrame, keys: list[str], threshold: float = 0.70) -> DataFrame:
    """Greedy by score (ties: the smaller id): a box that overlaps a kept one goes.

    One page's boxes are one group; pages are bounded by what a detector returns for one.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id", "b")))
    kept = F.aggregate(
        F.transform(ordered, lambda d: F.struct(d.id.cast("bigint").alias("id"), (-d.neg).alias("score"), d.b.alias("b"))),
        F.array().cast(f"array<{BOX}>"),
        lambda acc, d: F.when(F.exists(acc, lambda k: overlap_of_smaller(d["b"], k["b"]) >= threshold), acc).otherwise(F.concat(acc, F.array(d))),
    )
    return boxes.groupBy(*keys).agg(kept.alias("kept")).select(*keys, F.explode("kept").alias("k")).select(*keys, "k.id", "k.score", "k.b")


def reconcile(boxes: DataFrame, objects: DataFrame, keys: list[str], least: float = 0.50) -> DataFrame:
    """Each box with the class of the first object kind that covers ``least`` of it.

    Ink is tested before placed images, these before the full-page scan: the joined objects
    are reduced to the lowest priority of each box.
    """
    rank = F.when(F.col("o.role") == "ink", 1).when(F.col("o.role") == "placed_image", 2).when(F.col("o.role") == "full_page_scan", 3)
    on = covered_fraction(F.col("x.b"), F.col("o.b")) >= least
    for k in keys:
        on = on & (F.col(f"x.{k}") == F.col(f"o.{k}"))
    best = boxes.alias("x").join(objects.alias("o"), on, "left").groupBy(*(F.col(f"x.{k}") for k in keys), F.col("x.id").alias("id")).agg(F.min(rank).alias("r"))
    name = F.when(F.col("r") == 1, PRIORITY[0]).when(F.col("r") == 2, PRIORITY[1]).when(F.col("r") == 3, PRIORITY[2]).otherwise("unmatched")
    return best.select(*keys, "id", name.alias("classification"))


def reconcile_on_grid(boxes: DataFrame, objects: DataFrame, keys: list[str], cell: float = 100.0, least: float = 0.50) -> DataFrame:
    """The same for dense pages: only boxes and objects that touch a grid cell meet."""

    def celled(df: DataFrame) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(f"b.{a}") / cell), F.floor(F.col(f"b.{b}") / cell))
        return df.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))

    rank = F.when(F.col("role") == "ink", 1).when(F.col("role") == "placed_image", 2).when(F.col("role") == "full_page_scan", 3)
    near = celled(boxes).join(celled(objects.withColumnsRenamed({"b": "ob"}).withColumn("b", F.col("ob"))).drop("b", "id"), [*keys, "_cx", "_cy"])
    best = near.where(covered_fraction(F.col("b"), F.col("ob")) >= least).groupBy(*keys, "id").agg(F.min(rank).alias("r"))
    name = F.when(F.col("r") == 1, PRIORITY[0]).when(F.col("r") == 2, PRIORITY[1]).when(F.col("r") == 3, PRIORITY[2]).otherwise("unmatched")
    return boxes.select(*keys, "id").join(best, [*keys, "id"], "left").select(*keys, "id", name.alias("classification"))


#: Boxes of a sample that a leaf of a quad-tree holds, of a page's whole sample, and its deepest level.
LEAF, SAMPLE, DEEPEST = 16, 2048, 8
SQUARE = "struct<x:double,y:double,size:double>"


def quad_trees(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, square, level, cx, cy): the leaves of each page's quad-tree over a sample of its boxes' corners.

    Squares of a level are numbered from the page's lowest corner; of a page's boxes those of the
    least digests, ``SAMPLE`` at most, decide where squares are split.
    """
    b = F.col("b")
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    order = W.partitionBy(*keys, part).orderBy(F.xxhash64("id", F.lit(1)), "id")
    some = boxes.select(*keys, "id", "b").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE // 64)
    ends = boxes.groupBy(*keys).agg(*(f(b[c]).alias(f"_{c}") for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))))
    kinds = dict(boxes.dtypes)

    def leaves(part: pd.DataFrame) -> pd.DataFrame:
        x0, y0, x1, y1 = (float(part[f"_{c}"].iloc[0]) for c in ("x0", "y0", "x1", "y1"))
        size = max(x1 - x0, y1 - y0, 1e-9) * 1.0000001
        px, py = (part["px"].to_numpy() - x0) / size, (part["py"].to_numpy() - y0) / size
        found, waiting = [], [(0, 0, 0, np.arange(len(part)))]
        while waiting:
            level, cx, cy, own = waiting.pop()
            if len(own) <= LEAF or level == DEEPEST:
                found.append((level, cx, cy))
                continue
            n = 2 << level
            ix, iy = np.minimum((px[own] * n).astype(int), n - 1), np.minimum((py[own] * n).astype(int), n - 1)
            waiting += [(level + 1, 2 * cx + i, 2 * cy + j, own[(ix == 2 * cx + i) & (iy == 2 * cy + j)]) for i in (0, 1) for j in (0, 1)]
        rows = pd.DataFrame(found, columns=["level", "cx", "cy"])
        rows["square"] = [{"x": x0, "y": y0, "size": size}] * len(rows)
        return rows.assign(**{k: part[k].iloc[0] for k in keys})[[*keys, "square", "level", "cx", "cy"]]

    sample = some.join(ends, keys).select(*keys, "_x0", "_y0", "_x1", "_y1", b["x0"].alias("px"), b["y0"].alias("py"))
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + f"square {SQUARE}, level int, cx long, cy long"
    return sample.groupBy(*keys).applyInPandas(leaves, schema)


def in_leaves(rows: DataFrame, trees: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a box ``b``, once for each leaf that it touches: with level, cx, cy and the leaf's square."""
    used = trees.groupBy(*keys, "square").agg(F.array_sort(F.collect_set("level")).alias("_levels"))  # DEEPEST numbers at most
    found = rows.join(used, keys).withColumn("level", F.explode("_levels")).withColumn("_n", F.pow(F.lit(2.0), F.col("level")))
    cell = lambda edge, low: F.greatest(F.lit(0), F.least(F.col("_n").cast("long") - 1, F.floor((F.col("b")[edge] - F.col("square")[low]) / F.col("square")["size"] * F.col("_n"))))
    for c, low in (("cx", "x"), ("cy", "y")):
        found = found.withColumn(c, F.explode(F.sequence(cell(f"{low}0", low), cell(f"{low}1", low))))
    return found.drop("_levels", "_n").join(trees.drop("square"), [*keys, "level", "cx", "cy"])


def reconcile_on_tree(boxes: DataFrame, objects: DataFrame, keys: list[str], least: float = 0.50) -> DataFrame:
    """``reconcile`` for dense pages: only boxes and objects of one leaf of the page's quad-tree meet.

    A pair that shares several leaves is taken in that which holds the lower corner of its overlap.
    """
    trees = materialised(quad_trees(objects, keys))
    x = in_leaves(boxes.select(*keys, "id", "b"), trees, keys)
    o = in_leaves(objects.select(*keys, "role", "b"), trees, keys).withColumnRenamed("b", "ob").drop("square")
    corner = {low: F.greatest(F.col("b")[f"{low}0"], F.col("ob")[f"{low}0"]) for low in ("x", "y")}
    n = F.pow(F.lit(2.0), F.col("level"))
    own = lambda low: F.greatest(F.lit(0), F.least(n.cast("long") - 1, F.floor((corner[low] - F.col("square")[low]) / F.col("square")["size"] * n)))
    near = x.join(o, [*keys, "level", "cx", "cy"]).where((own("x") == F.col("cx")) & (own("y") == F.col("cy")) & (covered_fraction(F.col("b"), F.col("ob")) >= least))
    rank = F.when(F.col("role") == "ink", 1).when(F.col("role") == "placed_image", 2).when(F.col("role") == "full_page_scan", 3)
    best = near.groupBy(*keys, "id").agg(F.min(rank).alias("r"))
    name = F.when(F.col("r") == 1, PRIORITY[0]).when(F.col("r") == 2, PRIORITY[1]).when(F.col("r") == 3, PRIORITY[2]).otherwise("unmatched")
    return boxes.select(*keys, "id").join(best, [*keys, "id"], "left").select(*keys, "id", name.alias("classification"))


def candidates(predictions: DataFrame, truths: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, id, score, b, truth_id, tb, iou): predictions with each truth they overlap by ``least``, or with none."""
    on = [F.col(f"p.{k}") == F.col(f"t.{k}") for k in keys]
    apart = (F.col("p.b.x0") < F.col("t.b.x1")) & (F.col("t.b.x0") < F.col("p.b.x1")) & (F.col("p.b.y0") < F.col("t.b.y1")) & (F.col("t.b.y0") < F.col("p.b.y1"))
    overlap = iou(F.col("p.b"), F.col("t.b"))
    if least > 0:
        on += [apart, overlap >= least]
    joined = predictions.alias("p").join(truths.alias("t"), reduce(and_, on), "left")
    return joined.select(*(F.col(f"p.{k}").alias(k) for k in keys), "p.id", "p.score", "p.b", F.col("t.id").alias("truth_id"), F.col("t.b").alias("tb"), F.when(F.col("t.id").isNotNull(), overlap).alias("iou"))


def in_turn(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of a key in one task, predictions by falling score (ties: the smaller id), the best overlap first."""
    order = [*keys, F.desc("score"), "id", F.desc("iou"), "truth_id"]
    return rows.repartition(*keys).sortWithinPartitions(*order)


def greedy_matches(predictions: DataFrame, truths: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, id, score, truth_id): predictions by score (ties: the smaller id), each to its best free truth.

    The best truth is the one of largest IoU (ties: the smaller id) among those not taken;
    null where none reaches ``least``. A prediction without any is a false positive. Only
    pairs that reach ``least`` are taken in turn; what is kept meanwhile is a key's taken truths.
    """
    kinds = dict(predictions.dtypes)
    rows = in_turn(candidates(predictions, truths, [key], least), [key]).select(key, "id", "score", F.col("truth_id").cast("long").alias("truth_id"))

    def take(batches):
        here, taken, last = None, set(), None  # last: the prediction whose turn it is, and its truth
        for batch in batches:
            out = []
            for k, i, s, t in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if last is not None and (k, i) != last[:2]:
                    out.append(last)
                    last = None
                if k != here:
                    here, taken = k, set()
                free = t if t is not None and t not in taken else None
                if last is None:
                    last = (k, i, s, free)
                elif last[3] is None and free is not None:
                    last = (k, i, s, free)
                else:
                    continue
                if free is not None:
                    taken.add(free)
            yield pa.RecordBatch.from_pylist([dict(zip((key, "id", "score", "truth_id"), r, strict=True)) for r in out], schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((key, "id", "score", "truth_id"), last, strict=True))], schema)

    columns = f"`{key}` {kinds[key]}, id {kinds['id']}, score {kinds['score']}, truth_id long"
    schema = to_arrow_schema(T._parse_datatype_string(columns))
    return rows.mapInArrow(take, columns)


#: Overlaps and size ranges (squared pixels) of detection benchmarks.
OVERLAPS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
SIZES = (("all", 0.0, 1e10), ("small", 0.0, 32.0**2), ("medium", 32.0**2, 96.0**2), ("large", 96.0**2, 1e10))
HIT, MISS, IGNORED = 1, 0, 2


def benchmark_matches(predictions: DataFrame, truths: DataFrame, most: int = 100) -> DataFrame:
    """(page, label, id, score, codes) of the ``most`` best predictions of a page and label.

    ``codes`` holds HIT, MISS or IGNORED, a byte for every size range and overlap. In each of them
    predictions take their best free truth of the range in turn; what finds only truths of
    other sizes, or finds none and is of another size itself, is ignored.
    """
    keys = ["page", "label"]
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    kept = predictions.withColumn("_r", best).where(F.col("_r") <= most).drop("_r")
    area = lambda b: (F.col(f"{b}.x1") - F.col(f"{b}.x0")) * (F.col(f"{b}.y1") - F.col(f"{b}.y0"))
    rows = in_turn(candidates(kept, truths, keys, OVERLAPS[0]), keys).select(*keys, "id", "score", area("b").alias("area"), "truth_id", area("tb").alias("t_area"), "iou")

    least_of = [o - 1e-10 for o in OVERLAPS]

    def judged(area: float, found: list, taken: list[set]) -> bytes:
        codes = bytearray()
        # overlaps beyond the best one found leave nothing to choose
        within = bisect.bisect_right(least_of, max(v for _, _, v in found)) if found else 0
        for s, (_, low, high) in enumerate(SIZES):
            none = MISS if low <= area <= high else IGNORED
            for o in range(within):
                mine, other, code = taken[s * len(OVERLAPS) + o], None, none
                for t, a, v in found:
                    if v >= least_of[o] and t not in mine:
                        if low <= a <= high:
                            mine.add(t)
                            code = HIT
                            break
                        other = t if other is None else other
                else:
                    if other is not None:
                        mine.add(other)
                        code = IGNORED
                codes.append(code)
            codes.extend([none] * (len(OVERLAPS) - within))
        return bytes(codes)

    def take(batches):
        here, taken, turn, found = None, [], None, []

        def closed():
            return (*turn[:4], judged(turn[4], found, taken))

        for batch in batches:
            out = []
            for p, label, i, s, a, t, ta, v in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if turn is None or (p, label, i) != turn[:3]:
                    if turn is not None:
                        out.append(closed())
                    if (p, label) != here:
                        here, taken = (p, label), [set() for _ in range(len(SIZES) * len(OVERLAPS))]
                    turn, found = (p, label, i, s, a), []
                if t is not None:
                    found.append((t, ta, v))
            yield from rows_of(out)
        if turn is not None:
            yield from rows_of([closed()])

    def rows_of(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kinds = dict(kept.dtypes)
    columns = ", ".join(f"{c} {kinds[c]}" for c in ("page", "label", "id", "score")) + ", codes binary"
    schema = to_arrow_schema(T._parse_datatype_string(columns))
    return rows.mapInArrow(take, columns)


def running_totals(rows: DataFrame, by: list[str], order: list, sums: list[str]) -> DataFrame:
    """``rows`` with ``run_x`` for each column x of ``sums``: its total up to the row within ``by``, in one order.

    Rows are dealt out by ranges of the order and summed within; only a range's totals, a
    row for each, meet in one place.
    """
    parts = materialised(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    earlier = W.partitionBy(*by).orderBy("_part")
    before = totals.select(*by, "_part", *((F.sum(f"_t_{c}").over(earlier) - F.col(f"_t_{c}")).alias(f"_b_{c}") for c in sums))
    inside = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = parts.join(before, [*by, "_part"])
    return found.select(*rows.columns, *((F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(f"run_{c}") for c in sums))


CELLS = [(name, least) for name, _, _ in SIZES for least in OVERLAPS]
#: Recalls at which precision is read.
POINTS = 101


def benchmark_points(matches: DataFrame, counted: DataFrame) -> DataFrame:
    """(label, cell, up_to, p, recall) of what ``benchmark_matches`` gives and of (label, truths), a number for each cell.

    The predictions of a label in one order, by falling score, page and id: ``p`` is the best
    precision of those that reach a recall of ``up_to`` hundredths and no more, ``recall`` the
    largest of them. A prediction is one row with the codes of all cells. Rows are dealt out by
    ranges of the order; a range's totals travel to the next ones as one row for each label, ahead
    of its predictions, and what leaves a range is at most a row for each label, cell and recall.
    """
    order = [F.desc("score"), "page", "id"]
    kinds, n = dict(matches.dtypes), len(CELLS)
    parts = materialised(materialised(matches).repartitionByRange("label", *order).withColumn("_part", F.spark_partition_id()))

    def codes_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, n)

    def runs(batch: pa.RecordBatch, *keys: str) -> list[tuple]:
        """(first, end, values of the keys) of consecutive rows that agree in them."""
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        starts = [i for i in range(len(values)) if not i or values[i] != values[i - 1]]
        return [(i, j, *values[i]) for i, j in zip(starts, [*starts[1:], len(values)], strict=True)]

    def summed(batches):
        for batch in batches:
            codes, out = codes_of(batch), []
            for i, j, label, part in runs(batch, "label", "_part"):
                hits, counts = (codes[i:j] == HIT).sum(0), (codes[i:j] != IGNORED).sum(0)
                out.append((label, part, hits.tolist(), counts.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), totals_schema, strict=True)], schema=totals_schema)

    columns = f"label {kinds['label']}, _part int, hits array<long>, counts array<long>"
    totals_schema = to_arrow_schema(T._parse_datatype_string(columns))
    sums = parts.select("label", "_part", "codes").mapInArrow(summed, columns)
    cell = sums.select("label", "_part", F.posexplode(F.arrays_zip("hits", "counts")).alias("cell", "x"))
    cell = cell.groupBy("label", "_part", "cell").agg(F.sum("x.hits").alias("h"), F.sum("x.counts").alias("c"))
    earlier = W.partitionBy("label", "cell").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    cell = cell.select("label", "_part", "cell", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ("h", "c")))
    listed = F.array_sort(F.collect_list(F.struct("cell", "h", "c")))
    text = lambda values: F.array_join(values.cast("array<string>"), ",")
    before = cell.groupBy("label", "_part").agg(listed.alias("x")).join(sent_if_small(counted), "label").select("label", "_part", F.concat_ws(";", text(F.col("x.h")), text(F.col("x.c")), text(F.col("truths"))).alias("totals"))

    heads = before.select("label", "_part", F.lit(0).alias("_row"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("score", "page", "id")), F.lit(None).cast("binary").alias("codes"), "totals")
    rows = parts.select("label", "_part", F.lit(1).alias("_row"), "score", "page", "id", "codes", F.lit(None).cast("string").alias("totals"))
    whole = heads.unionByName(rows).repartition("_part").sortWithinPartitions("_part", "label", "_row", *order).select("label", "_part", "_row", "codes", "totals")

    def read(batches):
        hits = counts = truths = best = top = None

        def closed(label):
            at, up = np.nonzero(best >= 0)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), schema.field(0).type), pa.array(at, pa.int32()), pa.array(up, pa.int64()), pa.array(best[at, up]), pa.array(top[at])], schema=schema)

        here = None
        for batch in batches:
            for i, j, label, part, row in runs(batch, "label", "_part", "_row"):
                if (label, part) != here:
                    if best is not None:
                        yield from closed(here[0])
                    here, best = (label, part), None
                if row == 0:
                    hits, counts, truths = (np.array(x.split(","), np.int64) for x in batch.column("totals")[i].as_py().split(";"))
                    best, top = np.full((n, POINTS), -1.0), np.zeros(n)
                elif best is not None:  # else a label without truths
                    codes = codes_of(batch.slice(i, j - i))
                    hit = codes == HIT
                    run_hits, run_counts = hits + hit.cumsum(0), counts + (codes != IGNORED).cumsum(0)
                    k, at = np.nonzero(hit.T)  # precision peaks and recall grows at hits alone
                    if len(k):
                        recall = run_hits[at, k] / truths[k]
                        place = k * POINTS + np.minimum(np.floor(recall * 100 + 1e-9), 100).astype(int)
                        first = np.flatnonzero(np.diff(place, prepend=-1))  # places don't fall within a cell
                        peaks, flat = np.maximum.reduceat(run_hits[at, k] / run_counts[at, k], first), best.reshape(-1)
                        flat[place[first]] = np.maximum(flat[place[first]], peaks)
                        last = np.flatnonzero(np.diff(k, append=n))
                        top[k[last]] = recall[last]
                    hits, counts = run_hits[-1], run_counts[-1]
        if best is not None:
            yield from closed(here[0])

    columns = f"label {kinds['label']}, cell int, up_to long, p double, recall double"
    schema = to_arrow_schema(T._parse_datatype_string(columns))
    return whole.mapInArrow(read, columns)


def benchmark_table(predictions: DataFrame, truths: DataFrame, most: int = 100) -> DataFrame:
    """(label, size, overlap, truths, ap, ar): 101-point average precision and recall of every label, size and overlap.

    Labels and sizes without truths are left out.
    """
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    sized = [F.count_if((area >= lo) & (area <= hi)) for _, lo, hi in SIZES]
    counted = materialised(truths.groupBy("label").agg(F.array(*(x for x in sized for _ in OVERLAPS)).alias("truths")))
    points = materialised(benchmark_points(benchmark_matches(predictions, truths, most), counted))
    by = ["label", "cell"]
    reached = points.groupBy(*by).agg(F.max("recall").alias("ar"))
    every = counted.select("label", F.posexplode("truths").alias("cell", "truths")).where("truths > 0")
    found = every.join(steps(points, by), by, "left").join(reached, by, "left")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    return found.select("label", at([n for n, _ in CELLS]).alias("size"), at([o for _, o in CELLS]).alias("overlap"), "truths", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"))


def operating_points(predictions: DataFrame, truths: DataFrame, key: str, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9), least: float = 0.5) -> DataFrame:
    """(conf, tp, fp, fn, recall, precision, pred_over_true) at score thresholds (bounds included).

    Matching goes by falling score, so what a threshold leaves is a head of the one order:
    predictions are matched once and counted at each threshold.
    """
    matched = greedy_matches(predictions, truths, key, least)
    counts = matched.agg(*(x for t in thresholds for x in (
        F.count_if(F.col("score") >= t).alias(f"n_{t}"), F.count_if((F.col("score") >= t) & F.col("truth_id").isNotNull()).alias(f"tp_{t}"),
    )))
    parts = ", ".join(f"{t}D, `n_{t}`, `tp_{t}`" for t in thresholds)
    rows = counts.join(F.broadcast(truths.agg(F.count("*").alias("t")))).select("t", F.expr(f"stack({len(thresholds)}, {parts}) as (conf, n, tp)"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return rows.select(
        "conf", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"),
        ratio(F.col("tp"), F.col("t")).alias("recall"), ratio(F.col("tp"), F.col("n")).alias("precision"), ratio(F.col("n"), F.col("t")).alias("pred_over_true"),
    )


def interpolated(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap) of (by, recall, precision): the mean over 101 recalls of the best precision there or beyond."""
    return steps(curve.select(*by, F.least(F.floor(F.col("recall") * 100 + 1e-9), F.lit(100)).alias("up_to"), F.col("precision").alias("p")), by)


def steps(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap) of (by, up_to, p): precisions at recalls in hundredths."""
    best = points.groupBy(*by, "up_to").agg(F.max("p").alias("p"))
    each = best.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("up_to"))).alias("at"), "p").groupBy(*by, "at").agg(F.max("p").alias("p"))
    return each.groupBy(*by).agg((F.sum("p") / POINTS).alias("ap"))


def average_precision(matches: DataFrame, n_truths: DataFrame) -> DataFrame:
    """101-point interpolated average precision by label from (label, id, score, truth_id)."""
    rows = matches.select("label", "score", "id", F.col("truth_id").isNotNull().cast("long").alias("hit"), F.lit(1).cast("long").alias("one"))
    run = running_totals(rows, ["label"], [F.desc("score"), "id"], ["hit", "one"])
    curve = run.join(sent_if_small(n_truths), "label").select("label", (F.col("run_hit") / F.col("t")).alias("recall"), (F.col("run_hit") / F.col("run_one")).alias("precision"))
    return n_truths.join(interpolated(curve, ["label"]), "label", "left").select("label", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def evaluation_report(points: DataFrame) -> DataFrame:
    """(report): one JSON document of operating points (conf, tp, fp, fn, recall, precision, pred_over_true), a handful of rows."""
    share = lambda c, digits: F.format_string(f"%.{digits}f", F.col(c)).alias(c)
    body = F.to_json(F.struct("tp", "fp", "fn", share("recall", 3), share("precision", 3), share("pred_over_true", 2)))
    one = points.select(F.struct("conf", F.concat(F.lit('"'), F.format_string("%.1f", "conf"), F.lit('":'), body).alias("text")).alias("p"), (F.col("tp") + F.col("fn")).alias("n_gt"), (F.col("tp") + F.col("fp")).alias("n_pred"))
    all_ = one.agg(F.max("n_gt").alias("n_gt"), F.max("n_pred").alias("n_pred"), F.array_sort(F.collect_list("p")).alias("ps"))
    return all_.select(F.concat(F.lit('{"n_gt":'), F.col("n_gt").cast("string"), F.lit(',"n_pred":'), F.col("n_pred").cast("string"), F.lit(',"operating_points":{'), F.array_join("ps.text", ","), F.lit("}}")).alias("report"))
