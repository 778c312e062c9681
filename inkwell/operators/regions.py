"""Connected parts of pictures of any size: tiles are labelled apart and united over their borders.

A task holds one tile. A part goes by its first pixel in reading order; parts that touch over a
border are joined by their border pixels, and the smallest id that a part can reach names the
whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.functions.rasters import labelled
from inkwell.operators.staging import discarded, materialised

#: Ids hold a pixel's row and column.
ROW = 1 << 31


def packed(pixels: DataFrame, keys: list[str], side: int) -> DataFrame:
    """(keys, _ty, _tx, places): dark pixels (keys, y, x) of a tile that come in one batch, as one row with eight bytes for each."""
    kinds = dict(pixels.dtypes)
    tile = [*keys, "_ty", "_tx"]
    columns = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "_ty long, _tx long, places binary"
    schema = to_arrow_schema(T._parse_datatype_string(columns))

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                found = pa.Table.from_batches([batch]).group_by(tile, use_threads=False).aggregate([("_at", "list")]).combine_chunks()
                places = [np.asarray(p.values).tobytes() for p in found.column("_at_list")]
                values = [found.column(k).combine_chunks().cast(schema.field(k).type) for k in tile]
                yield pa.RecordBatch.from_arrays([*values, pa.array(places, pa.binary())], schema=schema)

    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    rows = pixels.select(*keys, F.expr(f"cast(y as long) div {side}").alias("_ty"), F.expr(f"cast(x as long) div {side}").alias("_tx"), (y * ROW + x).alias("_at"))
    return rows.mapInArrow(pack, columns)


def tile_parts(pixels: DataFrame, keys: list[str], side: int) -> DataFrame:
    """(keys, id, n, y0, x0, y1, x1, border) of each tile's parts of dark pixels (keys, y, x); ``border``: those on the tile's edge.

    A pixel may come more than once.
    """
    kinds = dict(pixels.dtypes)

    def label(tile: pd.DataFrame) -> pd.DataFrame:
        place = np.unique(np.frombuffer(b"".join(tile["places"]), np.int64))
        y, x = place // ROW, place % ROW
        top, left = y[0] // side * side, x[0] // side * side
        mask = np.zeros((side, side), bool)
        mask[y - top, x - left] = True
        parts = labelled(mask)[y - top, x - left]
        order = np.argsort(parts, kind="stable")
        y, x, place = y[order], x[order], place[order]
        first = np.flatnonzero(np.diff(parts[order], prepend=0))
        edge = (y == top) | (y == top + side - 1) | (x == left) | (x == left + side - 1)
        least, most = np.minimum.reduceat, np.maximum.reduceat
        found = pd.DataFrame({"id": place[first], "n": np.diff(first, append=len(place)), "y0": least(y, first), "x0": least(x, first), "y1": most(y, first), "x1": most(x, first)})
        found["border"] = [p[e].tolist() for p, e in zip(np.split(place, first[1:]), np.split(edge, first[1:]), strict=True)]
        return found.assign(**{k: tile[k].iloc[0] for k in keys})[[*keys, *found.columns]]

    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "id long, n long, y0 long, x0 long, y1 long, x1 long, border array<long>"
    return packed(pixels, keys, side).groupBy(*keys, "_ty", "_tx").applyInPandas(label, schema)


def touching(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b), a < b: parts of different tiles with pixels next to each other."""
    border = materialised(parts.select(*keys, "id", F.explode("border").alias("at")))
    later = F.explode(F.array(*(F.col("at") + dy * ROW + dx for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    ahead = border.select(*keys, F.col("id").alias("other"), later.alias("at"))
    pairs = ahead.join(border, [*keys, "at"]).where("id <> other")
    return pairs.select(*keys, F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def reached(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, root) of all ends of edges (keys, a, b): the smallest id that can be reached, in rounds of two hops."""
    both = materialised(edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    state = materialised(both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        near = both.join(state.select(*keys, F.col("a").alias("b"), F.col("root").alias("r")), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("r").alias("r"))
        lower = state.join(near, [*keys, "a"]).select(*keys, "a", "root", F.least("root", "r").alias("now"))
        up = state.select(*keys, F.col("a").alias("now"), F.col("root").alias("up"))
        moved = materialised(lower.join(up, [*keys, "now"], "left").select(*keys, "a", "root", F.least("now", F.coalesce("up", "now")).alias("now")))
        changed = moved.where("root <> now").limit(1).count()
        discarded(state)
        state = moved.select(*keys, "a", F.col("now").alias("root"))
        if not changed:
            return state.withColumnRenamed("a", "id")
        state = materialised(state)
        discarded(moved)


def connected_parts(pixels: DataFrame, keys: list[str], side: int = 2048) -> DataFrame:
    """(keys, part, n, y0, x0, y1, x1): 8-connected parts of dark pixels (keys, y, x), by their first pixel in reading order."""
    tiles = materialised(tile_parts(pixels, keys, side))
    roots = reached(touching(tiles, keys), keys)
    named = tiles.join(roots, [*keys, "id"], "left").withColumn("part", F.coalesce("root", "id"))
    return named.groupBy(*keys, "part").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("y0", "x0")), *(F.max(c).alias(c) for c in ("y1", "x1")))


def kept_parts(parts: DataFrame, keys: list[str], width: int, least: int = 8, share: float = 0.30) -> DataFrame:
    """Parts without specks, those shaped like a rule, and those far smaller than the largest left.

    Where every part is shaped like a rule, none is taken for one.
    """
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    sized = parts.where(F.col("n") >= least).withColumns({"_size": F.hypot(w, h), "_rule": (w >= 0.55 * width) & (h <= 0.06 * w)})
    tops = sized.groupBy(*keys).agg(F.max(F.when(~F.col("_rule"), F.col("_size"))).alias("_top"), F.max("_size").alias("_any"))
    joined = sized.join(tops, keys).where((~F.col("_rule") | F.col("_top").isNull()) & (F.col("_size") >= share * F.coalesce("_top", "_any")))
    return joined.drop("_size", "_rule", "_top", "_any")
