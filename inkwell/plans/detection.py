"""Boxes over ``events``, annotations over ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import geometry as g
from inkwell.operators import boxes as ob
from inkwell.plans.base import annotations, boxes, objects, query, read, truths, with_views
from inkwell.streaming.pages import page_lists

r6 = lambda c: F.round(c, 6)


@query("c16_rescaled_boxes", with_views("box") + " SELECT id, round(x0 * 1.5, 6) AS x0, round(y0 * 0.75, 6) AS y0, round(x1 * 1.5, 6) AS x1, round(y1 * 0.75, 6) AS y1 FROM box")
def c16(spark, d):
    b = F.col("b")
    r = g.rescaled(b, F.lit(1.5), F.lit(0.75))
    return boxes(spark, d).select("id", *(r6(r[c]).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("c17_a20_annotation_boxes", with_views("ann") + """, p AS (SELECT *, bbox::DOUBLE[] AS q FROM ann) SELECT id, image_id, round(q[1] * 800, 4) AS x0, round(q[2] * 1000, 4) AS y0, round((q[1] + q[3]) * 800, 4) AS x1, round((q[2] + q[4]) * 1000, 4) AS y1,
trunc((q[1] + q[3]) * 800)::INT AS whole_x1 FROM p WHERE q[3] > 0 AND q[4] > 0""")
def c17(spark, d):
    b = F.col("b")
    q = F.from_json("bbox", "array<double>")
    rows = annotations(spark, d).withColumn("q", q)
    at = lambda i: F.get("q", F.lit(i))
    rel = g.from_relative(at(0), at(1), at(2), at(3), F.lit(800.0), F.lit(1000.0))
    rows = rows.withColumn("b", rel).where(g.is_valid(F.col("b")))
    return rows.select("id", "image_id", *(F.round(b[c], 4).alias(c) for c in ("x0", "y0", "x1", "y1")), g.whole(b)["x1"].alias("whole_x1"))


@query("c18_padded_boxes", with_views("box") + """ SELECT id, round(greatest(0, x0 - greatest(6, 0.12 * w)), 6) AS x0, round(greatest(0, y0 - greatest(6, 0.12 * h)), 6) AS y0,
round(least(420, x1 + greatest(6, 0.12 * w)), 6) AS x1, round(least(520, y1 + greatest(6, 0.12 * h)), 6) AS y1 FROM box""")
def c18(spark, d):
    b = F.col("b")
    margin = lambda lo, hi: F.greatest(F.lit(6.0), 0.12 * (b[hi] - b[lo]))
    p = g.padded(b, margin("x0", "x1"), margin("y0", "y1"), F.lit(420.0), F.lit(520.0))
    return boxes(spark, d).select("id", *(r6(p[c]).alias(c) for c in ("x0", "y0", "x1", "y1")))


PAIRED = with_views("box", "gt") + """, p AS (SELECT a.id, t.id AS tid, greatest(0, least(a.x1, t.x1) - greatest(a.x0, t.x0)) * greatest(0, least(a.y1, t.y1) - greatest(a.y0, t.y0)) AS i,
(a.x1 - a.x0) * (a.y1 - a.y0) AS ar, (t.x1 - t.x0) * (t.y1 - t.y0) AS tr FROM box a JOIN gt t ON a.page = t.page)"""


@query("c19_c21_overlaps", PAIRED + " SELECT id, tid, round(i / ar, 6) AS covered, round(i / least(ar, tr), 6) AS of_smaller, round(i / (ar + tr - i), 6) AS iou FROM p WHERE i > 0")
def c19(spark, d):
    b = F.col("b")
    p = boxes(spark, d).join(truths(spark, d).select("page", F.col("id").alias("tid"), F.col("b").alias("t")), "page").where(g.overlap(b, F.col("t")) > 0)
    t = F.col("t")
    return p.select("id", "tid", r6(g.covered_fraction(b, t)).alias("covered"), r6(g.overlap_of_smaller(b, t)).alias("of_smaller"), r6(g.iou(b, t)).alias("iou"))


@query("c22_c23_placements", with_views("box") + """, m AS (SELECT id, w * h / 8000 AS ratio, w / 100 AS sw, h / 32 AS sh, w FROM box) SELECT id, round(ratio, 4) AS page_area_ratio, round(sw, 4) AS span_w, round(sh, 4) AS span_h,
CASE WHEN w - 60 > 1 THEN round((id % 700) / ((w - 60) / 72), 1) END AS effective_dpi, ratio >= 0.8 OR (greatest(sw, sh) >= 0.95 AND ratio >= 0.3) AS full_page FROM m""")
def c22(spark, d):
    b = F.col("b")
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    ratio, sw, sh = w * h / 8000, w / 100, h / 32
    return boxes(spark, d).select(
        "id", F.round(ratio, 4).alias("page_area_ratio"), F.round(sw, 4).alias("span_w"), F.round(sh, 4).alias("span_h"),
        g.effective_dpi((F.col("id") % 700).cast("double"), w - 60).alias("effective_dpi"), g.is_full_page(ratio, sw, sh).alias("full_page"),
    )


@query("d1_d3_detection_filters", with_views("box") + """ SELECT page, count_if(score > 10) AS above, count_if(score >= 10) AS at_least, count_if(score > 10 AND id % 3 = 1) AS marks, count_if(score > 10 AND id % 3 <> 1) AS other_classes FROM box GROUP BY page""")
def d1(spark, d):
    s, mark = F.col("score"), F.col("id") % 3 == 1
    return boxes(spark, d).groupBy("page").agg(F.count_if(s > 10).alias("above"), F.count_if(s >= 10).alias("at_least"), F.count_if((s > 10) & mark).alias("marks"), F.count_if((s > 10) & ~mark).alias("other_classes"))


@query("d5_d7_label_policy", with_views("ann") + """ SELECT category_id, count(*) AS n, count_if(category_id = 4) AS dropped, count_if(category_id < 1 OR category_id > 4) AS rejected, count_if(category_id BETWEEN 1 AND 3) AS kept FROM ann GROUP BY category_id""")
def d5(spark, d):
    c = F.col("category_id")
    return annotations(spark, d).groupBy("category_id").agg(F.count("*").alias("n"), F.count_if(c == 4).alias("dropped"), F.count_if((c < 1) | (c > 4)).alias("rejected"), F.count_if(c.between(1, 3)).alias("kept"))


@query("d12_e10_annotations_of_images", with_views("ann") + """ SELECT o.o_orderkey AS image_id, o.o_orderpriority AS file_name, count(a.id) AS n_boxes FROM orders o LEFT JOIN ann a ON o.o_orderkey = a.image_id GROUP BY 1, 2""")
def d12(spark, d):
    n = annotations(spark, d).groupBy("image_id").agg(F.count("*").alias("n"))
    images = read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("file_name"))
    return images.join(n, "image_id", "left").select("image_id", "file_name", F.coalesce("n", F.lit(0)).alias("n_boxes"))


@query("d12_unmapped_annotations", with_views("ann") + " SELECT count(*) AS n, count(DISTINCT image_id) AS n_images FROM ann WHERE image_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def d12_anti(spark, d):
    mapped = read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("image_id"))
    return annotations(spark, d).join(mapped, "image_id", "left_anti").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("n_images"))


SUPPRESSED = with_views("box") + """, g AS (SELECT page, list_sort(list(struct_pack(neg := -score, id := id, x0 := x0, y0 := y0, x1 := x1, y1 := y1))) AS xs FROM box GROUP BY page),
f AS (SELECT page, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, d: CASE WHEN len(list_filter(acc, lambda k:
greatest(0, least(k.x1, d[1].x1) - greatest(k.x0, d[1].x0)) * greatest(0, least(k.y1, d[1].y1) - greatest(k.y0, d[1].y0)) / least((k.x1 - k.x0) * (k.y1 - k.y0), (d[1].x1 - d[1].x0) * (d[1].y1 - d[1].y0)) >= 0.7)) > 0 THEN acc ELSE list_concat(acc, d) END) AS ks FROM g),
kept AS (SELECT page, k.id AS id, -k.neg AS score, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1 FROM (SELECT page, unnest(ks) AS k FROM f) q)"""


@query("g3_nested_suppression", SUPPRESSED + " SELECT page, id, score FROM kept")
def g3(spark, d):
    return ob.suppress_nested(boxes(spark, d), ["page"]).select("page", "id", "score")


CLASSIFIED = with_views("box", "obj") + """, c AS (SELECT x.page, x.id, min(CASE o.role WHEN 'ink' THEN 1 WHEN 'placed_image' THEN 2 WHEN 'full_page_scan' THEN 3 END) AS r FROM box x LEFT JOIN obj o ON x.page = o.page
AND greatest(0, least(x.x1, o.x1) - greatest(x.x0, o.x0)) * greatest(0, least(x.y1, o.y1) - greatest(x.y0, o.y0)) / ((x.x1 - x.x0) * (x.y1 - x.y0)) >= 0.5 GROUP BY x.page, x.id),
classified AS (SELECT page, id, CASE r WHEN 1 THEN 'vector_ink' WHEN 2 THEN 'pasted_image' WHEN 3 THEN 'scanned_wet_ink' ELSE 'unmatched' END AS classification FROM c)"""


@query("e5_box_reconciliation", CLASSIFIED + " SELECT page, id, classification FROM classified")
def e5(spark, d):
    return ob.reconcile(boxes(spark, d), objects(spark, d), ["page"])


@query("e5_box_reconciliation_grid", CLASSIFIED + " SELECT page, id, classification FROM classified")
def e5_grid(spark, d):
    return ob.reconcile_on_grid(boxes(spark, d), objects(spark, d), ["page"])


@query("e5_box_reconciliation_tree", CLASSIFIED + " SELECT page, id, classification FROM classified")
def e5_tree(spark, d):
    """The same over quad-trees, as pages with any number of boxes need it."""
    return ob.reconcile_on_tree(boxes(spark, d), objects(spark, d), ["page"])


@query("f9_f10_mark_counts", CLASSIFIED + """ SELECT page, count_if(classification = 'pasted_image') AS pasted_image, count_if(classification = 'vector_ink') AS vector_ink, count_if(classification = 'scanned_wet_ink') AS scanned_wet_ink,
count_if(classification = 'unmatched') AS unmatched, count_if(id % 10 = 0) AS crypto_signed, count_if(id % 10 = 1) AS crypto_empty,
count_if(classification IN ('pasted_image', 'vector_ink')) + count_if(id % 10 = 0) AS total_digital, count(*) AS total_detected FROM classified GROUP BY page""")
def f9(spark, d):
    c = F.col("classification")
    n = lambda e: F.count_if(e)
    return ob.reconcile(boxes(spark, d), objects(spark, d), ["page"]).groupBy("page").agg(
        n(c == "pasted_image").alias("pasted_image"), n(c == "vector_ink").alias("vector_ink"), n(c == "scanned_wet_ink").alias("scanned_wet_ink"), n(c == "unmatched").alias("unmatched"),
        n(F.col("id") % 10 == 0).alias("crypto_signed"), n(F.col("id") % 10 == 1).alias("crypto_empty"),
        (n(c.isin("pasted_image", "vector_ink")) + n(F.col("id") % 10 == 0)).alias("total_digital"), F.count("*").alias("total_detected"),
    )


@query("f11_corpus_summary", CLASSIFIED + """, s AS (SELECT count(*) AS boxes, count(DISTINCT page) AS pages, count_if(classification = 'unmatched') AS unmatched FROM classified)
SELECT 'boxes' AS metric, boxes AS value FROM s UNION ALL SELECT 'pages', pages FROM s UNION ALL SELECT 'unmatched', unmatched FROM s""")
def f11(spark, d):
    s = ob.reconcile(boxes(spark, d), objects(spark, d), ["page"]).agg(F.count("*").alias("boxes"), F.countDistinct("page").alias("pages"), F.count_if(F.col("classification") == "unmatched").alias("unmatched"))
    return s.select(F.expr("stack(3, 'boxes', boxes, 'pages', pages, 'unmatched', unmatched) as (metric, value)"))


@query("e7_e8_counts_of_every_page", with_views("box") + """ SELECT p.page_id AS page, coalesce(c.n, 0) AS n_boxes, coalesce(c.best, 0) AS best FROM pages p LEFT JOIN (SELECT page, count(*) AS n, max(score) AS best FROM box WHERE score > 10 GROUP BY page) c ON p.page_id = c.page""")
def e7(spark, d):
    c = boxes(spark, d).where("score > 10").groupBy("page").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    pages = read(spark, d, "pages").select(F.col("page_id").alias("page"))
    return pages.join(c, "page", "left").select("page", F.coalesce("n", F.lit(0)).alias("n_boxes"), F.coalesce("best", F.lit(0.0)).alias("best"))


@query("e6_pages_of_corpus", with_views("box") + " SELECT page, count(*) AS n FROM box WHERE page IN (SELECT page_id FROM pages WHERE page_id % 3 <> 0) GROUP BY page")
def e6(spark, d):
    chosen = read(spark, d, "pages").where("page_id % 3 <> 0").select(F.col("page_id").alias("page"))
    return boxes(spark, d).join(chosen, "page", "left_semi").groupBy("page").agg(F.count("*").alias("n"))


GREEDY = with_views("box", "gt") + """, tg AS (SELECT page, list(struct_pack(id := id, x0 := x0, y0 := y0, x1 := x1, y1 := y1)) AS ts FROM gt GROUP BY page),
pg0 AS (SELECT page, list_sort(list(struct_pack(neg := -score, id := id, x0 := x0, y0 := y0, x1 := x1, y1 := y1))) AS ps FROM box GROUP BY page),
f AS (SELECT pg0.page, list_reduce(list_concat([[struct_pack(id := -1::BIGINT, score := 0.0::DOUBLE, truth_id := NULL::BIGINT, p := NULL::STRUCT(neg DOUBLE, id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE))]],
list_transform(ps, lambda p: [struct_pack(id := p.id, score := -p.neg, truth_id := NULL::BIGINT, p := p)])),
lambda acc, e: list_append(acc, struct_pack(id := e[1].id, score := e[1].score, truth_id := (list_sort(list_filter(list_transform(list_filter(coalesce(ts, []), lambda t: NOT coalesce(list_contains(list_transform(acc, lambda m: m.truth_id), t.id), false)),
lambda t: struct_pack(neg := -(greatest(0, least(e[1].p.x1, t.x1) - greatest(e[1].p.x0, t.x0)) * greatest(0, least(e[1].p.y1, t.y1) - greatest(e[1].p.y0, t.y0))) /
((e[1].p.x1 - e[1].p.x0) * (e[1].p.y1 - e[1].p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - greatest(0, least(e[1].p.x1, t.x1) - greatest(e[1].p.x0, t.x0)) * greatest(0, least(e[1].p.y1, t.y1) - greatest(e[1].p.y0, t.y0))), id := t.id)),
lambda q: -q.neg >= 0.5))[1]).id, p := e[1].p))) AS ms FROM pg0 LEFT JOIN tg ON pg0.page = tg.page),
matches AS (SELECT page, m.id AS id, m.score AS score, m.truth_id AS truth_id FROM (SELECT page, unnest(ms) AS m FROM f) q WHERE m.id >= 0)"""


@query("e16_greedy_matches", GREEDY + " SELECT page, id, score, truth_id FROM matches")
def e16(spark, d):
    return ob.greedy_matches(boxes(spark, d), truths(spark, d), "page")


@query("f40_operating_points", GREEDY + """, c AS (SELECT conf, count_if(score / 40 >= conf) AS n, count_if(score / 40 >= conf AND truth_id IS NOT NULL) AS tp FROM matches CROSS JOIN (VALUES (0.3::DOUBLE), (0.5), (0.7), (0.9)) v(conf) GROUP BY conf), t AS (SELECT count(*) AS t FROM gt)
SELECT conf, tp, n - tp AS fp, t - tp AS fn, round(tp / t, 6) AS recall, round(tp / n, 6) AS precision, round(n / t, 6) AS pred_over_true FROM c CROSS JOIN t""")
def f40(spark, d):
    points = ob.operating_points(boxes(spark, d).withColumn("score", F.col("score") / 40), truths(spark, d), "page")
    return points.select("conf", "tp", "fp", "fn", r6(F.col("recall")).alias("recall"), r6(F.col("precision")).alias("precision"), r6(F.col("pred_over_true")).alias("pred_over_true"))


@query("b12_evaluation_report", GREEDY + """, c AS (SELECT conf, count_if(score / 40 >= conf) AS n, count_if(score / 40 >= conf AND truth_id IS NOT NULL) AS tp FROM matches CROSS JOIN (VALUES (0.3::DOUBLE), (0.5), (0.7), (0.9)) v(conf) GROUP BY conf), t AS (SELECT count(*) AS t FROM gt)
SELECT '{"n_gt":' || max(t) || ',"n_pred":' || max(n) || ',"operating_points":{' || string_agg(printf('"%.1f":{"tp":%d,"fp":%d,"fn":%d,"recall":"%.3f","precision":"%.3f","pred_over_true":"%.2f"}', conf, tp, n - tp, t - tp, tp / t, tp / n, n / t), ',' ORDER BY conf) || '}}' AS report FROM c CROSS JOIN t""")
def b12(spark, d):
    """The evaluation as one JSON document."""
    points = ob.operating_points(boxes(spark, d).withColumn("score", F.col("score") / 40), truths(spark, d), "page")
    return ob.evaluation_report(points)


@query("f41_average_precision", GREEDY + """, t AS (SELECT (id % 3) AS label, count(*) AS t FROM gt GROUP BY 1),
r AS (SELECT id % 3 AS label, sum(CASE WHEN truth_id IS NULL THEN 0 ELSE 1 END) OVER w AS tp, count(*) OVER w AS n FROM matches WINDOW w AS (PARTITION BY id % 3 ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT r.label, tp / t AS recall, tp / n AS precision FROM r JOIN t ON r.label = t.label), g AS (SELECT label, k, (SELECT max(precision) FROM c WHERE c.label = t.label AND c.recall + 1e-11 >= k / 100) AS p FROM t CROSS JOIN (SELECT unnest(range(101)) AS k) q)
SELECT label, round(sum(coalesce(p, 0)) / 101, 6) AS ap FROM g GROUP BY label""")
def f41(spark, d):
    m = ob.greedy_matches(boxes(spark, d), truths(spark, d), "page").withColumn("label", F.col("id") % 3)
    t = truths(spark, d).groupBy((F.col("id") % 3).alias("label")).agg(F.count("*").alias("t"))
    return ob.average_precision(m, t).select("label", r6(F.col("ap")).alias("ap"))


def labelled_boxes(spark, d):
    """Predictions and truths of three labels: those of a box and of the truth beside it agree but for every seventh."""
    p = boxes(spark, d).withColumn("label", F.col("id") % 3)
    t = truths(spark, d).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("id") + 1) % 3).otherwise((F.col("id") - 1000000) % 3))
    return p, t


COCO = with_views("box", "gt") + """, th AS (SELECT unnest(range(10)) AS k), g3 AS (SELECT *, CASE WHEN id % 7 = 0 THEN (id + 1) % 3 ELSE (id - 1000000) % 3 END AS label FROM gt),
b3 AS (SELECT * FROM (SELECT *, id % 3 AS label, row_number() OVER (PARTITION BY page, id % 3 ORDER BY score DESC, id) AS rn FROM box) q WHERE rn <= 100),
c AS (SELECT *, i / ((bx1 - bx0) * (by1 - by0) + (gx1 - gx0) * (gy1 - gy0) - i) AS v FROM (SELECT b.page, b.label, b.id, b.score, g.id AS tid, b.x0 AS bx0, b.x1 AS bx1, b.y0 AS by0, b.y1 AS by1, g.x0 AS gx0, g.x1 AS gx1, g.y0 AS gy0, g.y1 AS gy1,
  greatest(0, least(b.x1, g.x1) - greatest(b.x0, g.x0)) * greatest(0, least(b.y1, g.y1) - greatest(b.y0, g.y0)) AS i FROM b3 b JOIN g3 g ON b.page = g.page AND b.label = g.label) q),
o AS (SELECT page, label, k, list(struct_pack(id := id, tid := tid) ORDER BY score DESC, id, v DESC, tid) AS xs FROM c JOIN th ON c.v >= 0.5 + 0.05 * k - 1e-9 GROUP BY page, label, k),
f AS (SELECT page, label, k, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda m: m.id = e[1].id OR m.tid = e[1].tid)) > 0 THEN acc ELSE list_concat(acc, e) END) AS ms FROM o),
h AS (SELECT label, k, unnest(ms).id AS id FROM f), a AS (SELECT b3.label, th.k, b3.page, b3.id, b3.score, h.id IS NOT NULL AS hit FROM b3 CROSS JOIN th LEFT JOIN h ON b3.id = h.id AND th.k = h.k AND b3.label = h.label),
n AS (SELECT label, count(*) AS truths FROM g3 GROUP BY label),
r AS (SELECT a.label, a.k, n.truths, sum(hit::INT) OVER w / truths AS recall, sum(hit::INT) OVER w / count(*) OVER w AS precision FROM a JOIN n ON a.label = n.label WINDOW w AS (PARTITION BY a.label, a.k ORDER BY a.score DESC, a.page, a.id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT label, k, least(floor(recall * 100 + 1e-9), 100) AS up, max(precision) AS p, max(recall) AS rec FROM r GROUP BY 1, 2, 3),
e AS (SELECT n.label, th.k, q.at, coalesce((SELECT max(p.p) FROM p WHERE p.label = n.label AND p.k = th.k AND p.up >= q.at), 0) AS best FROM n CROSS JOIN th CROSS JOIN (SELECT unnest(range(101)) AS at) q)"""


@query("f41_benchmark_by_overlap", COCO + """ SELECT e.label, round((0.5 + 0.05 * e.k)::DOUBLE, 2) AS overlap, max(n.truths) AS truths, round(sum(best) / 101, 6) AS ap, round(coalesce(max(m.rec), 0), 6) AS ar
FROM e JOIN n ON e.label = n.label LEFT JOIN (SELECT label, k, max(rec) AS rec FROM p GROUP BY label, k) m ON e.label = m.label AND e.k = m.k GROUP BY e.label, e.k""")
def f41_overlaps(spark, d):
    t = ob.benchmark_table(*labelled_boxes(spark, d)).where("size = 'all'")
    return t.select("label", "overlap", "truths", r6(F.col("ap")).alias("ap"), r6(F.col("ar")).alias("ar"))


@query("f41_benchmark_summary")
def f41_summary(spark, d):
    """By size, and by label of all sizes: mean average precision and recall over all overlaps, and at 0.5 and 0.75."""
    t = ob.benchmark_table(*labelled_boxes(spark, d))
    at = lambda o: F.avg(F.when(F.col("overlap") == o, F.col("ap")))
    means = [r6(F.avg("ap")).alias("map"), r6(at(0.5)).alias("map_50"), r6(at(0.75)).alias("map_75"), r6(F.avg("ar")).alias("mar_100")]
    by_label = t.where("size = 'all'").groupBy("label").agg(*means).select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("part"), "map", "map_50", "map_75", "mar_100")
    return t.groupBy(F.col("size").alias("part")).agg(*means).unionByName(by_label)


@query("g1_page_mark_numbers", with_views("box") + " SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY score DESC, x0, id) AS number FROM box")
def g1(spark, d):
    order = W.partitionBy("page").orderBy(F.desc("score"), F.col("b.x0"), "id")
    return boxes(spark, d).select("page", "id", F.row_number().over(order).cast("bigint").alias("number"))


@query("f29_f30_file_rollup", with_views("box") + """ SELECT page // 50 AS file, count(DISTINCT page) AS total_pages, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN score > 30 THEN page END)), ','), '') AS pages, count_if(score > 30) AS n FROM box GROUP BY 1""")
def f29(spark, d):
    """Files of 50 pages: parts are added up by page, and a file's list is made of its pages."""
    pages = boxes(spark, d).groupBy(F.expr("page div 50").alias("file"), "page").agg(F.count_if(F.col("score") > 30).alias("n"))
    return page_lists(pages)


@query("c42_g7_otsu", """WITH h AS (SELECT event_type, least(greatest(floor(value), 0), 255) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS n0, sum(n * bin) OVER w AS s0, sum(n) OVER (PARTITION BY event_type) AS nt, sum(n * bin) OVER (PARTITION BY event_type) AS st FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
v AS (SELECT event_type, bin, n0::DOUBLE * (nt - n0)::DOUBLE * power(s0::DOUBLE / n0 - (st - s0)::DOUBLE / (nt - n0), 2) AS var FROM c WHERE nt > n0),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(var, 3) DESC, bin) AS rn FROM v) SELECT event_type, bin::BIGINT AS threshold FROM r WHERE rn = 1""")
def c42(spark, d):
    """Threshold of the largest between-class variance of a 256-bin histogram, the first of ties."""
    bins = F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(255))
    h = read(spark, d, "events").groupBy("event_type", bins.alias("bin")).agg(F.count("*").alias("n"))
    run, full = W.partitionBy("event_type").orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("event_type")
    mass = F.col("n") * F.col("bin")
    c = h.select("event_type", "bin", F.sum("n").over(run).alias("n0"), F.sum(mass).over(run).alias("s0"), F.sum("n").over(full).alias("nt"), F.sum(mass).over(full).alias("st"))
    n1 = F.col("nt") - F.col("n0")
    var = F.col("n0").cast("double") * n1 * F.pow(F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / n1, 2)
    v = c.where("nt > n0").select("event_type", "bin", F.round(var, 3).alias("var"))
    return v.groupBy("event_type").agg(F.min(F.struct((-F.col("var")).alias("neg"), "bin")).alias("x")).select("event_type", F.col("x.bin").cast("bigint").alias("threshold"))


@query("c35_ink_patches", "WITH p AS (SELECT event_type, event_id % 224 // 14 AS px, event_id // 224 % 224 // 14 AS py, avg(value / 100) AS m FROM events GROUP BY 1, 2, 3) SELECT event_type, count(*) AS patches, count_if(m > 0.08) AS inked FROM p GROUP BY event_type")
def c35(spark, d):
    e = F.col("event_id")
    p = read(spark, d, "events").groupBy("event_type", F.expr("event_id % 224 div 14").alias("px"), F.expr("event_id div 224 % 224 div 14").alias("py")).agg(F.avg(F.col("value") / 100).alias("m"))
    return p.groupBy("event_type").agg(F.count("*").alias("patches"), F.count_if(F.col("m") > 0.08).alias("inked"))


@query("c47_principal_angle", """WITH s AS (SELECT user_id, avg(event_id % 97) AS cx, avg(value) AS cy, var_samp(event_id % 97) AS vx, var_samp(value) AS vy, covar_samp(event_id % 97, value) AS cov FROM events GROUP BY user_id HAVING count(*) > 1)
SELECT user_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(degrees(0.5 * atan2(2 * cov, vx - vy)), 5) AS angle FROM s""")
def c47(spark, d):
    x = (F.col("event_id") % 97).cast("double")
    s = read(spark, d, "events").groupBy("user_id").agg(F.avg(x).alias("cx"), F.avg("value").alias("cy"), F.var_samp(x).alias("vx"), F.var_samp("value").alias("vy"), F.covar_samp(x, F.col("value")).alias("cov"), F.count("*").alias("n")).where("n > 1")
    return s.select("user_id", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), F.round(F.degrees(0.5 * F.atan2(2 * F.col("cov"), F.col("vx") - F.col("vy"))), 5).alias("angle"))


@query("c51_white_fraction", "SELECT user_id, round(avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0 END), 6) AS fraction, avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0 END) > 0.2 AS blank FROM events GROUP BY user_id")
def c51(spark, d):
    f = F.avg(F.when(F.col("value") >= 20, 1.0).otherwise(0.0))
    return read(spark, d, "events").groupBy("user_id").agg(r6(f).alias("fraction"), (f > 0.2).alias("blank"))


@query("c52_c57_g6_runs", """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS x FROM lineitem WHERE l_quantity > 10), i AS (SELECT *, x - row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS island FROM r)
SELECT l_orderkey, min(x) AS first, max(x) AS last, count(*) AS length FROM i GROUP BY l_orderkey, island""")
def g6(spark, d):
    r = read(spark, d, "lineitem").where("l_quantity > 10").select("l_orderkey", F.col("l_linenumber").alias("x")).distinct()
    i = r.withColumn("island", F.col("x") - F.row_number().over(W.partitionBy("l_orderkey").orderBy("x")))
    return i.groupBy("l_orderkey", "island").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count("*").alias("length")).drop("island")


@query("c36_g8_staff_gaps", """WITH g AS (SELECT l_orderkey, (lead(x) OVER (PARTITION BY l_orderkey ORDER BY x) - x) / 7.0 AS gap FROM (SELECT DISTINCT l_orderkey, l_linenumber AS x FROM lineitem) q)
SELECT l_orderkey, count(gap) AS n_gaps, coalesce(count_if(gap <= 0.35), 0) AS n_close, round(max(gap), 6) AS widest FROM g GROUP BY l_orderkey""")
def g8(spark, d):
    x = F.col("l_linenumber")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    g8_ = lines.select("l_orderkey", ((F.lead(x).over(W.partitionBy("l_orderkey").orderBy(x)) - x) / 7.0).alias("gap"))
    return g8_.groupBy("l_orderkey").agg(F.count("gap").alias("n_gaps"), F.count_if(F.col("gap") <= 0.35).alias("n_close"), r6(F.max("gap")).alias("widest"))


@query("c58_ink_aspect", "SELECT user_id, (max(value) - min(value) + 1) / (max(event_id % 97) - min(event_id % 97) + 1) AS aspect FROM events WHERE value <= 128 GROUP BY user_id")
def c58(spark, d):
    x = F.col("event_id") % 97
    return read(spark, d, "events").where("value <= 128").groupBy("user_id").agg(((F.max("value") - F.min("value") + 1) / (F.max(x) - F.min(x) + 1)).alias("aspect"))


@query("f42_counts_of_counts", with_views("ann") + ", c AS (SELECT image_id, count(*) AS n FROM ann GROUP BY image_id) SELECT n, count(*) AS images FROM c GROUP BY n")
def f42(spark, d):
    return annotations(spark, d).groupBy("image_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("images"))


@query("h5_offset_ids", with_views("ann") + ", n AS (SELECT id, image_id, row_number() OVER (PARTITION BY image_id ORDER BY id) AS rn FROM ann) SELECT id, CASE WHEN rn > 2 THEN image_id + 2000000 ELSE image_id END AS image_id FROM n")
def h5(spark, d):
    rn = F.row_number().over(W.partitionBy("image_id").orderBy("id"))
    return annotations(spark, d).select("id", F.when(rn > 2, F.col("image_id") + 2000000).otherwise(F.col("image_id")).alias("image_id"))


@query("i1_concat_deduplicated", with_views("ann") + " SELECT category_id, bbox, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT image_id, id, category_id, bbox FROM ann WHERE id % 3 <> 0 UNION ALL SELECT image_id, id, category_id, bbox FROM ann WHERE id % 2 = 0) u) q GROUP BY category_id, bbox")
def i1(spark, d):
    a = annotations(spark, d)
    both = a.where("id % 3 <> 0").unionByName(a.where("id % 2 = 0")).dropDuplicates()
    return both.groupBy("category_id", "bbox").agg(F.count("*").alias("n"))


#: A digest of an id in whole numbers, the same in any engine.
SPLIT = "(((x * 48271 + 42) % 2147483647 * ((x * 48271 + 42) % 2147483647) + x * 16807) % 2147483647)"


@query("h6_split_by_image", with_views("ann") + f", d AS (SELECT image_id, image_id % 2147483647 AS x FROM ann) SELECT CASE WHEN {SPLIT} % 100 < 80 THEN 'train' ELSE 'test' END AS part, count(DISTINCT image_id) AS images, count(*) AS boxes FROM d GROUP BY 1")
def h6(spark, d):
    """80/20 by a seeded digest of the image, so that all boxes of an image fall on one side."""
    parts = annotations(spark, d).select("image_id", F.expr("image_id % 2147483647").alias("x")).select("image_id", F.expr(f"CASE WHEN {SPLIT} % 100 < 80 THEN 'train' ELSE 'test' END").alias("part"))
    return parts.groupBy("part").agg(F.countDistinct("image_id").alias("images"), F.count("*").alias("boxes"))


@query("l5_shards", "WITH r AS (SELECT page_id, ntile(8) OVER (ORDER BY page_id) - 1 AS shard FROM pages) SELECT shard, count(*) AS n, min(page_id) AS first, max(page_id) AS last FROM r GROUP BY shard")
def l5(spark, d):
    """Contiguous shards of equal size: ids are ranked within ranges, not in one task."""
    ids = read(spark, d, "pages").select("page_id").repartitionByRange(8, "page_id").sortWithinPartitions("page_id").withColumn("part", F.spark_partition_id())
    sizes = ids.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    total = sizes.agg(F.sum("n").alias("total"))
    ranked = ids.withColumn("rn", F.row_number().over(W.partitionBy("part").orderBy("page_id"))).join(F.broadcast(before), "part").join(F.broadcast(total))
    at, small = F.col("before") + F.col("rn") - 1, F.floor(F.col("total") / 8)
    large = F.col("total") % 8
    shard = F.when(at < large * (small + 1), F.floor(at / (small + 1))).otherwise(large + F.floor((at - large * (small + 1)) / small))
    return ranked.groupBy(shard.cast("bigint").alias("shard")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.max("page_id").alias("last"))


@query("d8_d9_placed_candidates", with_views("box") + " SELECT id, w, h FROM box WHERE w >= 60 AND h >= 20 AND NOT (w * h / 8000 >= 0.8 OR (greatest(w / 100, h / 32) >= 0.95 AND w * h / 8000 >= 0.3)) AND w * h > 0")
def d8(spark, d):
    b = F.col("b")
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    full = g.is_full_page(w * h / 8000, w / 100, h / 32)
    return boxes(spark, d).where((w >= 60) & (h >= 20) & ~full & (g.area(b) > 0)).select("id", w.alias("w"), h.alias("h"))


@query("e9_b14_crop_index", with_views("box") + " SELECT x.page, x.id, p.url, ceil(x.w * 2)::BIGINT AS crop_px_w, ceil(x.h * 2)::BIGINT AS crop_px_h FROM box x JOIN pages p ON x.page = p.page_id WHERE x.score >= 20")
def e9(spark, d):
    b = F.col("b")
    pages = read(spark, d, "pages").select(F.col("page_id").alias("page"), "url")
    px = lambda lo, hi: F.ceil((b[hi] - b[lo]) * 2)
    return boxes(spark, d).where("score >= 20").join(pages, "page").select("page", "id", "url", px("x0", "x1").alias("crop_px_w"), px("y0", "y1").alias("crop_px_h"))
