"""Calibration, cross-reference and report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import verdicts as fv
from inkwell.functions.vectors import cosine
from inkwell.operators import calibration as cal
from inkwell.operators import crossref, links, pairs
from inkwell.operators.pairs import digest_sql
from inkwell.plans.base import query, read, sig, with_views
from inkwell.plans.vectors import MATCH_SQL, document_pairs, matched

r6 = lambda c: F.round(c, 6)
SCORERS = ["cosine", "vgg", "vit"]
KIND = """CASE WHEN ra = 'reference' AND rb = 'reference' THEN 'ref-ref (same writer)' WHEN (ra = 'reference' AND rb = 'control') OR (rb = 'reference' AND ra = 'control') THEN 'ref-control (diff writer)'
WHEN (ra = 'reference' AND rb = 'questioned') OR (rb = 'reference' AND ra = 'questioned') THEN 'ref-questioned (THE QUESTION)' WHEN ra = 'questioned' AND rb = 'questioned' THEN 'q-q' WHEN ra <> rb THEN 'q-control (diff writer)' ELSE 'control-control (diff writer)' END"""
CASE = with_views("docpairs") + f""", rl AS (SELECT sig_id, CASE WHEN sig_id % 5 < 2 THEN 'reference' WHEN sig_id % 5 < 4 THEN 'control' ELSE 'questioned' END AS role FROM sig),
cp AS (SELECT p.*, a.role AS ra, b.role AS rb FROM docpairs p JOIN rl a ON p.sig_a = a.sig_id JOIN rl b ON p.sig_b = b.sig_id), ck AS (SELECT *, {KIND} AS kind, (cosine + vgg + vit) / 3 AS mean_score FROM cp),
ls AS (SELECT pdf, kind, sig_a, sig_b, 'cosine' AS scorer, cosine AS s FROM ck UNION ALL SELECT pdf, kind, sig_a, sig_b, 'vgg', vgg FROM ck UNION ALL SELECT pdf, kind, sig_a, sig_b, 'vit', vit FROM ck),
bd AS (SELECT scorer, min(CASE WHEN kind LIKE 'ref-ref%' THEN s END) AS ceil_lo, avg(CASE WHEN kind LIKE 'ref-ref%' THEN s END) AS ceil_mean, max(CASE WHEN kind LIKE 'ref-ref%' THEN s END) AS ceil_hi,
min(CASE WHEN kind LIKE 'ref-control%' THEN s END) AS floor_lo, avg(CASE WHEN kind LIKE 'ref-control%' THEN s END) AS floor_mean, max(CASE WHEN kind LIKE 'ref-control%' THEN s END) AS floor_hi FROM ls GROUP BY scorer)"""


def case_pairs(spark, d):
    """Pairs of a document with scores, kind and mean; roles by position in the document."""
    part = F.col("sig_id") % 5
    role = F.when(part < 2, "reference").when(part < 4, "control").otherwise("questioned")
    roles = sig(spark, d).select("sig_id", role.alias("role"))
    p = document_pairs(spark, d)
    for s in ("a", "b"):
        p = p.join(roles.select(F.col("sig_id").alias(f"sig_{s}"), F.col("role").alias(f"r{s}")), f"sig_{s}")
    return p.withColumn("kind", fv.pair_type(F.col("ra"), F.col("rb"))).withColumn("mean_score", (F.col("cosine") + F.col("vgg") + F.col("vit")) / 3)


@query("f33_bands", CASE + """ SELECT scorer, round(ceil_lo, 6) AS ceil_lo, round(ceil_mean, 6) AS ceil_mean, round(ceil_hi, 6) AS ceil_hi, round(floor_lo, 6) AS floor_lo, round(floor_mean, 6) AS floor_mean, round(floor_hi, 6) AS floor_hi, ceil_lo > floor_hi AS separated, true AS have_floor, true AS have_ceiling FROM bd""")
def f33(spark, d):
    b = cal.bands(cal.long_scores(case_pairs(spark, d), SCORERS, ["kind"]))
    return b.select("scorer", *(r6(F.col(c)).alias(c) for c in b.columns[1:7]), "separated", "have_floor", "have_ceiling")


@query("k2_k3_g9_verdicts", CASE + """, b2 AS (SELECT scorer, ceil_mean AS ceil_lo, floor_mean AS floor_hi FROM bd) SELECT ls.scorer, ls.kind, CASE WHEN NOT b2.ceil_lo > b2.floor_hi THEN 'NOT DIAGNOSTIC (bands overlap)' WHEN s >= b2.ceil_lo THEN 'in same-writer band' WHEN s <= b2.floor_hi THEN 'in diff-writer band' ELSE 'between bands' END AS verdict, count(*) AS n
FROM ls JOIN b2 ON ls.scorer = b2.scorer GROUP BY 1, 2, 3""")
def k3(spark, d):
    s = cal.long_scores(case_pairs(spark, d), SCORERS, ["kind"])
    b = cal.bands(s).select("scorer", F.col("ceil_mean").alias("ceil_lo"), F.col("floor_mean").alias("floor_hi"), "have_ceiling", "have_floor", (F.col("ceil_mean") > F.col("floor_mean")).alias("separated"))
    return cal.verdicts(s, b).groupBy("scorer", "kind", "verdict").agg(F.count("*").alias("n"))


LIFTED = CASE + """, l2 AS (SELECT kind, scorer, s FROM ls UNION ALL SELECT kind, 'lifted', cosine + CASE WHEN kind LIKE 'ref-ref%' THEN 1.2 WHEN kind LIKE 'ref-control%' THEN -1.2 ELSE 0 END FROM ck
UNION ALL SELECT kind, 'one-sided', cosine FROM ck WHERE kind NOT LIKE 'ref-control%'),
b3 AS (SELECT scorer, min(CASE WHEN kind LIKE 'ref-ref%' THEN s END) AS ceil_lo, max(CASE WHEN kind LIKE 'ref-control%' THEN s END) AS floor_hi FROM l2 GROUP BY scorer)"""


@query("k3_verdicts_at_band_ends", LIFTED + """ SELECT l2.scorer, l2.kind, CASE WHEN ceil_lo IS NULL OR floor_hi IS NULL THEN 'NO VERDICT (uncalibrated)' WHEN ceil_lo <= floor_hi THEN 'NOT DIAGNOSTIC (bands overlap)' WHEN s >= ceil_lo THEN 'in same-writer band'
WHEN s <= floor_hi THEN 'in diff-writer band' ELSE 'between bands' END AS verdict, count(*) AS n FROM l2 JOIN b3 ON l2.scorer = b3.scorer GROUP BY 1, 2, 3""")
def k3_ends(spark, d):
    """Verdicts against the bands' own ends, with a scorer whose bands are apart and one without a floor."""
    p = case_pairs(spark, d)
    shift = F.when(F.col("kind").startswith("ref-ref"), 1.2).when(F.col("kind").startswith("ref-control"), -1.2).otherwise(0.0)
    lifted = p.select("kind", F.lit("lifted").alias("scorer"), (F.col("cosine") + shift).alias("s"))
    one_sided = p.where(~F.col("kind").startswith("ref-control")).select("kind", F.lit("one-sided").alias("scorer"), F.col("cosine").alias("s"))
    s = cal.long_scores(p, SCORERS, ["kind"]).unionByName(lifted).unionByName(one_sided)
    return cal.verdicts(s, cal.bands(s)).groupBy("scorer", "kind", "verdict").agg(F.count("*").alias("n"))


@query("f34_baseline_ratios", CASE + """, b AS (SELECT avg(cosine) AS c FROM ck WHERE kind LIKE 'ref-ref%') SELECT sig_a, sig_b, round(cosine / c, 4) AS cosine_vs_baseline FROM ck, b WHERE c > 1e-6 UNION ALL SELECT sig_a, sig_b, 'nan'::DOUBLE FROM ck, b WHERE c <= 1e-6""")
def f34(spark, d):
    p = cal.against_baseline(case_pairs(spark, d), ["cosine"], "kind", "ref-ref (same writer)")
    return p.select("sig_a", "sig_b", F.round("cosine_vs_baseline", 4).alias("cosine_vs_baseline"))


@query("f35_f37_f45_score_ranges", CASE + " SELECT scorer, kind, count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS low, round(max(s), 6) AS high FROM ls GROUP BY scorer, kind")
def f35(spark, d):
    s = cal.long_scores(case_pairs(spark, d), SCORERS, ["kind"])
    return s.groupBy("scorer", "kind").agg(F.count("*").alias("n"), r6(F.avg("s")).alias("mean"), r6(F.min("s")).alias("low"), r6(F.max("s")).alias("high"))


@query("f36_b11_histograms", CASE + " SELECT scorer, least(floor((s + 1) / (2.0 / 15)), 14)::BIGINT AS bin, count(*) AS n FROM ls WHERE s BETWEEN -1 AND 1 GROUP BY 1, 2")
def f36(spark, d):
    s = cal.long_scores(case_pairs(spark, d), SCORERS, ["kind"])
    return cal.histogram(s, "s", ["scorer"], -1.0, 1.0)


@query("b11_calibration_summary", CASE + """, o AS (SELECT scorer, avg(s) AS observed FROM ls WHERE kind LIKE 'ref-questioned%' GROUP BY scorer),
c AS (SELECT scorer, count_if(kind LIKE 'ref-ref%') AS cn, avg(CASE WHEN kind LIKE 'ref-ref%' THEN s END) AS cm, min(CASE WHEN kind LIKE 'ref-ref%' THEN s END) AS cl, max(CASE WHEN kind LIKE 'ref-ref%' THEN s END) AS ch,
 count_if(kind LIKE 'ref-control%') AS fn, avg(CASE WHEN kind LIKE 'ref-control%' THEN s END) AS fm, min(CASE WHEN kind LIKE 'ref-control%' THEN s END) AS fl, max(CASE WHEN kind LIKE 'ref-control%' THEN s END) AS fh FROM ls GROUP BY scorer),
t AS (SELECT c.scorer, [upper(c.scorer), printf('  same writer (n=%d): mean %.3f, range [%.3f, %.3f]', cn, cm, cl, ch), printf('  unrelated (n=%d): mean %.3f, range [%.3f, %.3f]', fn, fm, fl, fh), printf('  observed: %.3f', observed),
 '  placement: ' || CASE WHEN observed <= fh AND observed >= cl THEN 'inside both ranges: this scorer does not tell them apart' WHEN observed <= fh THEN 'within the range of unrelated pairs' WHEN observed >= cl THEN 'within the range of the same writer''s pairs'
 ELSE printf('between the ranges, %.0f%% of the way up', 100 * (observed - fh) / (cl - fh)) END] AS lines FROM c JOIN o ON c.scorer = o.scorer) SELECT scorer, unnest(range(5))::INT AS line, unnest(lines) AS text FROM t""")
def b11_summary(spark, d):
    """The calibration of each scorer as text, with the mean of the questioned pairs as the observed score."""
    s = cal.long_scores(case_pairs(spark, d), SCORERS, ["kind"])
    observed = s.where(F.col("kind").startswith("ref-questioned")).groupBy("scorer").agg(F.avg("s").alias("observed"))
    return cal.summary_lines(s.withColumn("use", fv.purpose(F.col("kind"))), observed)


@query("f38_f39_correlations", CASE + " SELECT kind, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(vgg, vit), 6) END AS r FROM ck GROUP BY kind")
def f38(spark, d):
    c = cal.correlation(case_pairs(spark, d), "vgg", "vit", ["kind"])
    return c.select("kind", "n", r6(F.col("r")).alias("r"))


@query("k4_placements", """WITH s AS (SELECT event_type, min(value) AS same_min FROM events WHERE user_id % 2 = 0 AND value > 20 GROUP BY event_type), u AS (SELECT event_type, max(value) AS unrelated_max FROM events WHERE user_id % 2 = 1 AND value < 15 GROUP BY event_type)
SELECT e.event_type, CASE WHEN value <= unrelated_max AND value >= same_min THEN 'both' WHEN value <= unrelated_max THEN 'unrelated' WHEN value >= same_min THEN 'same' ELSE 'between' END AS place, count(*) AS n,
round(avg(CASE WHEN value > unrelated_max AND value < same_min THEN (value - unrelated_max) / (same_min - unrelated_max) END), 6) AS fraction FROM events e JOIN s ON e.event_type = s.event_type JOIN u ON e.event_type = u.event_type GROUP BY 1, 2""")
def k4(spark, d):
    e = read(spark, d, "events")
    s = e.where("user_id % 2 = 0 and value > 20").groupBy("event_type").agg(F.min("value").alias("same_min"))
    u = e.where("user_id % 2 = 1 and value < 15").groupBy("event_type").agg(F.max("value").alias("unrelated_max"))
    p = e.join(s, "event_type").join(u, "event_type").select("event_type", fv.placement(F.col("value"), F.col("same_min"), F.col("unrelated_max")).alias("p"))
    return p.groupBy("event_type", F.col("p.place").alias("place")).agg(F.count("*").alias("n"), r6(F.avg("p.fraction")).alias("fraction"))


@query("k6_extreme_pairs", CASE + """, r AS (SELECT kind, sig_a, sig_b, mean_score, row_number() OVER (PARTITION BY kind ORDER BY mean_score DESC, sig_a, sig_b) AS rn FROM ck) SELECT kind, sig_a, sig_b, round(mean_score, 6) AS mean_score FROM r WHERE rn = 1""")
def k6(spark, d):
    best = case_pairs(spark, d).groupBy("kind").agg(F.min(F.struct((-F.col("mean_score")).alias("neg"), "sig_a", "sig_b")).alias("x"))
    return best.select("kind", "x.sig_a", "x.sig_b", r6(-F.col("x.neg")).alias("mean_score"))


@query("h2_b10_comparison_report", CASE + " SELECT kind, sig_a, sig_b, round(cosine, 4) AS cosine, round(mean_score, 4) AS mean_score FROM ck")
def h2(spark, d):
    p = case_pairs(spark, d).orderBy("kind", F.desc("mean_score"), "sig_a", "sig_b")
    return p.select("kind", "sig_a", "sig_b", F.round("cosine", 4).alias("cosine"), F.round("mean_score", 4).alias("mean_score"))


@query("d11_sensitivity", CASE + " SELECT kind, count(*) AS n FROM ck WHERE sig_a % 13 <> 0 AND sig_b % 13 <> 0 GROUP BY kind")
def d11(spark, d):
    return case_pairs(spark, d).where("sig_a % 13 <> 0 and sig_b % 13 <> 0").groupBy("kind").agg(F.count("*").alias("n"))


@query("c28_shape_distances", with_views("docpairs") + " SELECT sig_a, sig_b, round(abs(ln((sig_a % 17 + 3) / 7.0) - ln((sig_b % 17 + 3) / 7.0)), 6) AS distance FROM docpairs")
def c28(spark, d):
    aspect = lambda c: (F.col(c) % 17 + 3) / 7.0
    return document_pairs(spark, d).select("sig_a", "sig_b", r6(fv.shape_distance(aspect("sig_a"), aspect("sig_b"))).alias("distance"))


STATS = MATCH_SQL + """, sg AS (SELECT DISTINCT writer AS signer FROM sig WHERE role = 'reference'), fr AS (SELECT DISTINCT matched.pdf, sg.signer FROM matched CROSS JOIN sg),
st AS (SELECT fr.pdf, fr.signer, coalesce(count(m.sig_id), 0) AS n, coalesce(avg(m.similarity), 0) AS mean, coalesce(max(m.similarity), 0) AS top, coalesce(min(m.similarity), 0) AS low FROM fr LEFT JOIN matched m ON fr.pdf = m.pdf AND fr.signer = m.signer GROUP BY fr.pdf, fr.signer)"""


def target_stats(spark, d):
    signers = sig(spark, d).where("role = 'reference'").select(F.col("writer").alias("signer"))
    return crossref.by_target_and_signer(matched(spark, d), signers)


@query("f21_target_by_signer", STATS + " SELECT pdf, signer, n, round(mean, 6) AS mean, round(top, 6) AS top, round(low, 6) AS low FROM st")
def f21(spark, d):
    return target_stats(spark, d).select("pdf", "signer", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "top", "low")))


def pivot_sql() -> str:
    parts = []
    for s in range(10):
        n, m = f"max(CASE WHEN signer = {s} THEN n END)", f"max(CASE WHEN signer = {s} THEN mean END)"
        parts += [f"{n} AS signer_{s}_count", f"CASE WHEN {n} > 0 THEN 'Yes' ELSE 'No' END AS signer_{s}_present", f"round({m}, 4) AS signer_{s}_similarity"]
    return STATS + f" SELECT pdf, {', '.join(parts)}, count_if(n > 0)::INT AS signers_found FROM st GROUP BY pdf"


@query("f22_f23_f24_presence_pivot", pivot_sql())
def f22(spark, d):
    """Signers of the reference are read first (a few values), so that the pivot needs one pass."""
    signers = crossref.pivot_signers(sig(spark, d).where("role = 'reference'").select("writer"))
    return crossref.presence_pivot(target_stats(spark, d), signers)


@query("f25_presence_long", STATS + " SELECT pdf, signer, n, CASE WHEN n > 0 THEN 'Yes' ELSE 'No' END AS present FROM st")
def f25(spark, d):
    return target_stats(spark, d).select("pdf", "signer", "n", F.when(F.col("n") > 0, "Yes").otherwise("No").alias("present"))


@query("f26_d10_signer_summary", STATS + " SELECT pdf, signer, n, round(mean, 6) AS mean, CASE WHEN mean * 2.5 > 0.8 THEN 'High' WHEN mean * 2.5 > 0.6 THEN 'Medium' ELSE 'Low' END AS level FROM st WHERE n > 0")
def f26(spark, d):
    return target_stats(spark, d).where("n > 0").select("pdf", "signer", "n", r6(F.col("mean")).alias("mean"), fv.confidence_level(F.col("mean") * 2.5).alias("level"))


@query("f27_signer_distribution", STATS + " SELECT signer, count_if(n > 0) AS n_pdfs, sum(n)::BIGINT AS n_matches FROM st GROUP BY signer")
def f27(spark, d):
    return target_stats(spark, d).groupBy("signer").agg(F.count_if(F.col("n") > 0).alias("n_pdfs"), F.sum("n").alias("n_matches"))


@query("f28_reference_summary", with_views("sig") + " SELECT writer AS signer, count(*) AS n_references, count(DISTINCT pdf) AS n_documents, CASE WHEN count(*) = 1 THEN 1.0 ELSE 0.8 END AS confidence FROM sig WHERE role = 'reference' GROUP BY writer")
def f28(spark, d):
    r = sig(spark, d).where("role = 'reference'").groupBy(F.col("writer").alias("signer"))
    return r.agg(F.count("*").alias("n_references"), F.countDistinct("pdf").alias("n_documents"), F.when(F.count("*") == 1, 1.0).otherwise(0.8).alias("confidence"))


@query("f43_d14_dashboard", MATCH_SQL + """ SELECT count(*) AS n, count(signer) AS matched, round(avg(similarity), 6) AS mean, count_if(similarity >= 0.4) AS excellent, count_if(similarity >= 0.3 AND similarity < 0.4) AS good, count_if(similarity < 0.3) AS poor, round(100.0 * count(signer) / count(*), 4) AS success FROM matched""")
def f43(spark, d):
    s = F.col("similarity")
    return matched(spark, d).agg(
        F.count("*").alias("n"), F.count("signer").alias("matched"), r6(F.avg(s)).alias("mean"), F.count_if(s >= 0.4).alias("excellent"), F.count_if((s >= 0.3) & (s < 0.4)).alias("good"),
        F.count_if(s < 0.3).alias("poor"), F.round(100.0 * F.count("signer") / F.count("*"), 4).alias("success"),
    )


@query("e11_c27_i3_shared_signers", with_views("sig") + """, s AS (SELECT DISTINCT pdf, writer FROM sig) SELECT a.pdf AS pdf_a, b.pdf AS pdf_b, count(*) AS common, array_to_string(list_sort(list(a.writer)), ',') AS signers, CASE WHEN count(*) > 2 THEN 'High' WHEN count(*) > 1 THEN 'Medium' ELSE 'Low' END AS strength
FROM s a JOIN s b ON a.writer = b.writer AND a.pdf < b.pdf GROUP BY a.pdf, b.pdf""")
def e11(spark, d):
    s = crossref.shared_signers(sig(spark, d).withColumnRenamed("writer", "signer"))
    return s.withColumn("strength", fv.relationship_strength(F.col("common")))


@query("e12_assignments", with_views("sig") + """ SELECT s.sig_id, s.pdf, coalesce('PDF_' || w.k, 'Unknown') AS within_cluster, coalesce('Signer_' || printf('%03d', c.writer), 'Unknown') AS signer FROM sig s
LEFT JOIN (SELECT sig_id, page AS k FROM sig WHERE sig_id % 4 <> 0) w ON s.sig_id = w.sig_id LEFT JOIN (SELECT sig_id, writer FROM sig WHERE sig_id % 5 <> 0) c ON s.sig_id = c.sig_id""")
def e12(spark, d):
    s = sig(spark, d)
    within = s.where("sig_id % 4 <> 0").select("sig_id", F.concat(F.lit("PDF_"), F.col("page").cast("string")).alias("w"))
    across = s.where("sig_id % 5 <> 0").select("sig_id", F.format_string("Signer_%03d", "writer").alias("c"))
    joined = s.select("sig_id", "pdf").join(within, "sig_id", "left").join(across, "sig_id", "left")
    return joined.select("sig_id", "pdf", F.coalesce("w", F.lit("Unknown")).alias("within_cluster"), F.coalesce("c", F.lit("Unknown")).alias("signer"))


#: Marks' files, and records of events whose paths, names, ids or tokens point to one of them, or to none.
LINKED = with_views("sig") + """, f AS (SELECT sig_id, 'crops/doc' || pdf || '/doc' || pdf || '_p' || page || '_sig' || sig_id || '.png' AS path FROM sig),
m AS (SELECT event_id AS ord, CASE event_id % 5 WHEN 0 THEN 'crops/doc' || (k // 50) || '/doc' || (k // 50) || '_p' || (k % 7 + 1) || '_sig' || k || '.png' WHEN 1 THEN 'moved/doc' || (k // 50) || '_p' || (k % 7 + 1) || '_sig' || k || '.png'
 WHEN 2 THEN 'other/run' || event_id || 'x_a.png' WHEN 3 THEN 'raw/sig' || k || '._x' || event_id || '.png' ELSE 'raw/none' || event_id || '_y.png' END AS path,
 CASE event_id % 5 WHEN 2 THEN 'u1-doc' || (k // 50) || '_p' || (k % 7 + 1) || '_sig' || k || '-' || event_id WHEN 4 THEN NULL ELSE 'id' || event_id END AS unique_id, value, event_type
 FROM (SELECT *, event_id * 7 % 2500 AS k FROM events) e),
n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM m), g AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, replace(replace(replace(regexp_extract(path, '[^/]*$'), '.png', ''), '.jpg', ''), '.jpeg', '') AS part FROM f),
r AS (SELECT sig_id, 1 AS strategy, ord FROM g JOIN n ON g.path = n.path UNION ALL SELECT sig_id, 2, ord FROM g JOIN n ON g.name = n.name UNION ALL SELECT sig_id, 3, ord FROM g JOIN n ON contains(n.unique_id, g.part)
 UNION ALL SELECT sig_id, 4, ord FROM g JOIN n ON contains(g.name, split_part(n.name, '_', 1)) OR (contains(n.name, '_') AND contains(g.name, split_part(n.name, '_', 2)))),
b AS (SELECT sig_id, min(strategy * 100000000000 + ord) AS best FROM r GROUP BY sig_id)"""


def linked_files(spark, d):
    """(marks' files, metadata records) as the SQL above has them."""
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    s = lambda c: c.cast("string")
    i, k, doc = F.col("event_id"), F.col("event_id") * 7 % 2500, F.expr("(event_id * 7 % 2500) div 50")
    stem = lambda doc, page, n: text("doc", s(doc), "_p", s(page), "_sig", s(n))
    own = stem(F.col("pdf"), F.col("page"), F.col("sig_id"))
    files = sig(spark, d).select("sig_id", text("crops/doc", s(F.col("pdf")), "/", own, ".png").alias("path"))
    named = stem(doc, k % 7 + 1, k)
    path = F.when(i % 5 == 0, text("crops/doc", s(doc), "/", named, ".png")).when(i % 5 == 1, text("moved/", named, ".png")).when(i % 5 == 2, text("other/run", s(i), "x_a.png"))
    path = path.when(i % 5 == 3, text("raw/sig", s(k), "._x", s(i), ".png")).otherwise(text("raw/none", s(i), "_y.png"))
    unique = F.when(i % 5 == 2, text("u1-", named, "-", s(i))).when(i % 5 != 4, text("id", s(i)))
    return files, read(spark, d, "events").select(i.alias("ord"), path.alias("path"), unique.alias("unique_id"), "value", "event_type")


@query("e13_e14_metadata_links", LINKED + """ SELECT g.sig_id, coalesce(best // 100000000000, 0) AS strategy, best % 100000000000 AS ord, CASE WHEN best IS NULL THEN g.part ELSE n.unique_id END AS unique_id, coalesce(n.value, 0.8) AS confidence
FROM g LEFT JOIN b ON g.sig_id = b.sig_id LEFT JOIN n ON n.ord = best % 100000000000""")
def e13(spark, d):
    """Metadata of each mark's file by path, name, id part or token part, in that order, else the default record."""
    files, records = linked_files(spark, d)
    found = links.linked(files, records, "sig_id")
    return found.select("sig_id", "strategy", "ord", "unique_id", F.coalesce("value", F.lit(0.8)).alias("confidence"))


@query("e17_page_nests", with_views("sig") + " SELECT pdf, page, count(*) AS n, array_to_string(list_sort(list(sig_id)), ',') AS marks FROM sig GROUP BY pdf, page")
def e17(spark, d):
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sig_id", "writer"))), lambda x: x["sig_id"].cast("string")), ",")
    return sig(spark, d).groupBy("pdf", "page").agg(F.count("*").alias("n"), marks.alias("marks"))


@query("e19_signer_style_groups", with_views("sig") + " SELECT writer AS signer, min(pdf % 4) AS style FROM sig GROUP BY writer")
def e19(spark, d):
    return sig(spark, d).groupBy(F.col("writer").alias("signer")).agg(F.min(F.col("pdf") % 4).alias("style"))


@query("g5_first_appearance", with_views("sig") + ", f AS (SELECT writer, min(sig_id) AS first_id FROM sig GROUP BY writer) SELECT writer, first_id, row_number() OVER (ORDER BY first_id) AS number FROM f")
def g5(spark, d):
    from pyspark.sql import Window as W

    f = sig(spark, d).groupBy("writer").agg(F.min("sig_id").alias("first_id"))
    # a row for each signer
    return f.withColumn("number", F.row_number().over(W.orderBy("first_id")).cast("bigint"))


@query("f31_f32_mean_losses", "SELECT event_type, count(*) AS n, count_if(event_id % 11 = 0) AS skipped, round(avg(CASE WHEN event_id % 11 <> 0 THEN value END), 6) AS loss FROM events GROUP BY event_type")
def f32(spark, d):
    loss = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = read(spark, d, "events").select("event_type", loss.alias("loss"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.isnan("loss")).alias("skipped"), r6(F.avg(F.when(~F.isnan("loss"), F.col("loss")))).alias("loss"))


TRIALS = 30


@query("h7_k5_trials", with_views("pairs") + f""", t AS (SELECT sig_a, sig_b, wa, wb, cosine FROM pairs WHERE wa <> wb ORDER BY {digest_sql("sig_a", "sig_b", 42)}, sig_a, sig_b LIMIT {TRIALS})
SELECT sig_a, sig_b, wa AS writer_a, wb AS writer_b, round(cosine, 6) AS cosine, round(list_cosine_similarity(list_slice(a.v, 1, 32), list_slice(b.v, 1, 32)), 6) AS vgg,
round(list_cosine_similarity(list_slice(a.v, 33, 64), list_slice(b.v, 33, 64)), 6) AS vit FROM t JOIN sig a ON sig_a = a.sig_id JOIN sig b ON sig_b = b.sig_id""")
def h7(spark, d):
    """Floor trials: pairs of two writers, drawn from all such pairs of the corpus by a seeded digest, with every score."""
    s = sig(spark, d).select("sig_id", "writer", "v")
    p = F.broadcast(pairs.floor_trials(s, TRIALS))  # a fixed number of rows
    for side in ("a", "b"):
        p = F.broadcast(p.join(s.select(F.col("sig_id").alias(f"sig_{side}"), F.col("writer").alias(f"writer_{side}"), F.col("v").alias(f"v{side}")), f"sig_{side}"))
    score = lambda begin: r6(cosine(F.slice("va", begin, 32), F.slice("vb", begin, 32)))
    return p.select("sig_a", "sig_b", "writer_a", "writer_b", r6(F.col("cosine")).alias("cosine"), score(1).alias("vgg"), score(33).alias("vit"))
