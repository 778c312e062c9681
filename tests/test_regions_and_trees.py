"""Parts put together from tiles, and dense pages on quad-trees, against the plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import rasters
from inkwell.operators import boxes, regions


def pixels_of(spark, masks):
    rows = [(p, int(y), int(x)) for p, m in masks.items() for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "page long, y long, x long")


def spiral(n):
    """One part that winds through all tiles, and one that winds inside it."""
    m = np.zeros((n, n), bool)
    for k in range(0, n // 2, 4):
        m[k, k : n - k] = m[n - 1 - k, k : n - k] = True
        m[k : n - k, n - 1 - k] = True
        m[k + 4 : n - k, k] = True
        m[min(k + 4, n - 1), k : k + 5] = True
    return m


@pytest.mark.parametrize("side", [5, 16])
def test_parts_by_tiles(spark, side):
    rng = np.random.default_rng(1)
    masks = {0: rng.random((40, 53)) < 0.35, 1: spiral(41), 2: np.ones((17, 17), bool), 3: rng.random((30, 30)) < 0.1}
    got = regions.connected_parts(pixels_of(spark, masks), ["page"], side).collect()
    for p, m in masks.items():
        parts = rasters.labelled(m)
        want = set()
        for k in range(1, parts.max() + 1):
            y, x = np.nonzero(parts == k)
            want.add((int(y[0]) * regions.ROW + int(x[0]), len(x), int(y.min()), int(x.min()), int(y.max()), int(x.max())))
        assert {tuple(r)[1:] for r in got if r["page"] == p} == want


def test_kept_parts_are_those_of_whole_pictures(spark):
    m = np.zeros((60, 100), bool)
    m[10:30, 10:20] = m[12:14, 40:80] = m[40:50, 50:53] = True  # a stroke, a rule-like line, a stroke
    m[55, 90:93] = True  # a speck
    m[40:42, 5:63] = True  # a rule, too thick to be stripped
    parts = regions.connected_parts(pixels_of(spark, {0: m}), ["page"], 16)
    kept = {r["part"] for r in regions.kept_parts(parts, ["page"], 100).collect()}
    whole = rasters.labelled(m)
    sizes = {k: (np.ptp(np.nonzero(whole == k)[1]) + 1, np.ptp(np.nonzero(whole == k)[0]) + 1, (whole == k).sum()) for k in range(1, whole.max() + 1)}
    strokes = {k: s for k, s in sizes.items() if s[2] >= 8 and not (s[0] >= 55 and s[1] <= 0.06 * s[0])}
    top = max(np.hypot(s[0], s[1]) for s in strokes.values())
    first = lambda k: int(np.nonzero(whole == k)[0][0]) * regions.ROW + int(np.nonzero(whole == k)[1][0])
    assert kept == {first(k) for k, s in strokes.items() if np.hypot(s[0], s[1]) >= 0.3 * top} and len(kept) < len(sizes)


def page_boxes(rng, n, spread, size):
    x, y = rng.normal(0, spread, n), rng.normal(0, spread, n)
    w, h = rng.uniform(0.1, size, n), rng.uniform(0.1, size, n)
    return [(float(a), float(b), float(a + c), float(b + d)) for a, b, c, d in zip(x, y, w, h)]


def test_dense_pages_on_trees(spark):
    rng = np.random.default_rng(2)
    shape = "struct<x0:double,y0:double,x1:double,y1:double>"
    found, objects = [], []
    for page, (n, spread, size) in enumerate([(300, 5.0, 2.0), (40, 100.0, 300.0), (3, 1.0, 1.0), (200, 0.001, 0.3)]):
        found += [(page, i, b) for i, b in enumerate(page_boxes(rng, n, spread, size))]
        objects += [(page, i, ["ink", "placed_image", "full_page_scan", "other"][i % 4], b) for i, b in enumerate(page_boxes(rng, n, spread, size * 1.5))]
    found += [(9, 0, (0.0, 0.0, 1.0, 1.0))]  # a page without objects
    b = spark.createDataFrame(found, f"page long, id long, b {shape}")
    o = spark.createDataFrame(objects, f"page long, id long, role string, b {shape}")
    plain, tree = ({(r["page"], r["id"]): r["classification"] for r in f(b, o, ["page"]).collect()} for f in (boxes.reconcile, boxes.reconcile_on_tree))
    assert plain == tree and len(set(plain.values())) == 4
    assert boxes.quad_trees(o, ["page"]).where("page = 0").count() > 10


def test_a_pair_of_large_boxes_meets_once(spark):
    shape = "page long, id long, role string, b struct<x0:double,y0:double,x1:double,y1:double>"
    rng = np.random.default_rng(3)
    small = [(0, i, "other", b) for i, b in enumerate(page_boxes(rng, 400, 10.0, 0.2))]
    o = spark.createDataFrame([*small, (0, 1000, "ink", (-50.0, -50.0, 50.0, 50.0))], shape)
    trees = boxes.quad_trees(o, ["page"])
    assert boxes.in_leaves(o.where("id = 1000"), trees, ["page"]).count() == trees.count()
    b = spark.createDataFrame([(0, 0, (-40.0, -40.0, 40.0, 40.0))], "page long, id long, b struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r["classification"] for r in boxes.reconcile_on_tree(b, o, ["page"]).select(F.col("classification")).collect()] == ["vector_ink"]
