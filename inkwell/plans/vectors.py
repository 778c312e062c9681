"""Pairs, scores, matching and clusters over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import verdicts
from inkwell.functions.vectors import cosine, dot, fused, mean_of, norm, normalised, weighted_mean
from inkwell.operators import clusters, duplicates, pairs, sketches
from inkwell.operators.staging import leading_values, materialised, ranked
from inkwell.plans.base import query, sig, with_views
from inkwell.sources import hooks

DIMS = 64
r6 = lambda c: F.round(c, 6)
vgg, vit = lambda c: F.slice(c, 1, 32), lambda c: F.slice(c, 33, 32)


@query("c30_cosine_neighbours", with_views("sig") + " SELECT a.sig_id AS sig_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM sig a JOIN sig b ON b.sig_id = a.sig_id + 1")
def c30(spark, d):
    s = sig(spark, d)
    nxt = s.select((F.col("sig_id") - 1).alias("sig_id"), F.col("v").alias("w"))
    return s.join(nxt, "sig_id").select("sig_id", r6(cosine(F.col("v"), F.col("w"))).alias("cosine"))


@query("c31_normalised", with_views("uni") + " SELECT sig_id, round(list_dot_product(u, u), 6) AS length, round(u[1], 6) AS first FROM uni")
def c31(spark, d):
    u = sig(spark, d).select("sig_id", normalised(F.col("v")).alias("u"))
    return u.select("sig_id", r6(norm(F.col("u"))).alias("length"), r6(F.get("u", F.lit(0))).alias("first"))


@query("c32_fused_features", with_views("sig") + """, h AS (SELECT sig_id, list_slice(v, 1, 32) AS a, list_slice(v, 33, 64) AS b FROM sig),
n AS (SELECT sig_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS a, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS b FROM h),
f AS (SELECT sig_id, CASE WHEN sig_id % 5 = 0 THEN a ELSE list_transform(list_zip(a, b), lambda p: 0.6 * p[1] + 0.4 * p[2]) END AS f FROM n)
SELECT sig_id, round(f[1] / sqrt(list_dot_product(f, f)), 6) AS first, round(f[32] / sqrt(list_dot_product(f, f)), 6) AS last FROM f""")
def c32(spark, d):
    second = F.when(F.col("sig_id") % 5 != 0, vit(F.col("v")))
    f = sig(spark, d).select("sig_id", fused(vgg(F.col("v")), second).alias("f"))
    return f.select("sig_id", r6(F.get("f", F.lit(0))).alias("first"), r6(F.get("f", F.lit(31))).alias("last"))


def document_pairs(spark, d):
    """Pairs within a document with their scores by method: of the whole vector and of its halves."""
    return pairs.pairs_in_groups(sig(spark, d), ["pdf"], {"cosine": (0, DIMS), "vgg": (0, 32), "vit": (32, 64)})


@query("e1_pairs_within_document", with_views("docpairs") + " SELECT pdf, sig_a, sig_b, round(cosine, 6) AS cosine FROM docpairs")
def e1(spark, d):
    return pairs.pairs_in_groups(sig(spark, d), ["pdf"], {"cosine": (0, DIMS)}).select("pdf", "sig_a", "sig_b", r6(F.col("cosine")).alias("cosine"))


@query("c33_weighted_scores", with_views("docpairs") + """ SELECT sig_a, sig_b, round((0.7 * vgg + CASE WHEN sig_a % 3 = 0 THEN 0 ELSE 0.15 * vit END + 0.15 * cosine)
 / (0.85 + CASE WHEN sig_a % 3 = 0 THEN 0 ELSE 0.15 END), 6) AS combined FROM docpairs""")
def c33(spark, d):
    score = weighted_mean([(F.col("vgg"), 0.7), (F.when(F.col("sig_a") % 3 != 0, F.col("vit")), 0.15), (F.col("cosine"), 0.15)])
    return document_pairs(spark, d).select("sig_a", "sig_b", r6(score).alias("combined"))


@query("c34_mean_of_three", with_views("docpairs") + " SELECT sig_a, sig_b, round((cosine + vgg + vit) / 3, 6) AS mean_score FROM docpairs")
def c34(spark, d):
    return document_pairs(spark, d).select("sig_a", "sig_b", r6(mean_of(F.col("cosine"), F.col("vgg"), F.col("vit"))).alias("mean_score"))


@query("e2_corpus_pairs", with_views("pairs") + " SELECT sig_a, sig_b, round(cosine, 6) AS cosine FROM pairs WHERE cosine >= 0.25")
def e2(spark, d):
    return pairs.blocked_pairs(sig(spark, d), 0.25).select("sig_a", "sig_b", r6(F.col("cosine")).alias("cosine"))


@query("e2_corpus_pair_statistics", with_views("pairs") + " SELECT ra, rb, count(*) AS n, round(avg(cosine), 6) AS mean, round(max(cosine), 6) AS top FROM pairs GROUP BY ra, rb")
def e2_stats(spark, d):
    p = pairs.blocked_statistics(sig(spark, d), "role")
    return p.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "n", r6(F.col("total") / F.col("n")).alias("mean"), r6(F.col("top")).alias("top"))


@query("e3_cross_writer_pairs", with_views("pairs") + " SELECT wa, wb, count(*) AS n, round(max(cosine), 6) AS top FROM pairs WHERE wa <> wb GROUP BY wa, wb")
def e3(spark, d):
    p = pairs.blocked_statistics(sig(spark, d), "writer").where("a <> b")
    return p.select(F.col("a").alias("wa"), F.col("b").alias("wb"), "n", r6(F.col("top")).alias("top"))


MATCH_SQL = with_views("uni") + """, s AS (SELECT t.sig_id, t.pdf, r.writer AS signer, max(greatest(0, list_dot_product(t.u, r.u))) AS s
FROM uni t CROSS JOIN uni r WHERE t.role = 'questioned' AND r.role = 'reference' GROUP BY t.sig_id, t.pdf, r.writer),
best AS (SELECT *, row_number() OVER (PARTITION BY sig_id ORDER BY s DESC, signer) AS rn FROM s),
matched AS (SELECT sig_id, pdf, CASE WHEN s >= 0.3 THEN signer END AS signer, s AS similarity FROM best WHERE rn = 1)"""


def matched(spark, d, threshold=0.3):
    s = sig(spark, d)
    return pairs.best_signers(s.where("role = 'questioned'").select("sig_id", "pdf", "v"), s.where("role = 'reference'").select("writer", "v"), threshold)


@query("e4_j12_best_signer", MATCH_SQL + " SELECT sig_id, pdf, signer, round(similarity, 6) AS similarity FROM matched")
def j12(spark, d):
    return matched(spark, d).select("sig_id", "pdf", "signer", r6(F.col("similarity")).alias("similarity"))


@query("e15_mutual_matches", with_views("uni") + """, m AS (SELECT a.pdf AS grp, a.sig_id AS a, b.sig_id AS b, list_dot_product(a.u, b.u) AS s FROM uni a JOIN uni b ON a.pdf = b.pdf AND a.sig_id % 2 = 0 AND b.sig_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, a ORDER BY s DESC, b) AS ra, row_number() OVER (PARTITION BY grp, b ORDER BY s DESC, a) AS rb FROM m)
SELECT grp AS "group", a, b, round(s, 6) AS s FROM r WHERE ra = 1 AND rb = 1 AND s >= 0.05""")
def e15(spark, d):
    """Each document's even marks against its odd ones, as two pictures' patches."""
    u = pairs.unit_vectors(sig(spark, d))
    a, b = u.where("sig_id % 2 = 0").alias("a"), u.where("sig_id % 2 = 1").alias("b")
    m = a.join(b, F.col("a.pdf") == F.col("b.pdf")).select(F.col("a.pdf").alias("group"), F.col("a.sig_id").alias("a"), F.col("b.sig_id").alias("b"), dot(F.col("a.v"), F.col("b.v"), DIMS).alias("s"))
    return pairs.mutual_matches(m, 0.05).select("group", "a", "b", r6(F.col("s")).alias("s"))


@query("e18_symmetric_matrix", with_views("docpairs") + """ SELECT pdf, a, b, round(s, 6) AS s FROM (SELECT pdf, sig_a AS a, sig_b AS b, cosine AS s FROM docpairs UNION ALL
SELECT pdf, sig_b, sig_a, cosine FROM docpairs UNION ALL SELECT pdf, sig_id, sig_id, 1.0 FROM sig) t""")
def e18(spark, d):
    p = document_pairs(spark, d).select("pdf", F.col("sig_a").alias("a"), F.col("sig_b").alias("b"), F.col("cosine").alias("s"))
    diagonal = sig(spark, d).select("pdf", F.col("sig_id").alias("a"), F.col("sig_id").alias("b"), F.lit(1.0).alias("s"))
    return p.unionByName(p.select("pdf", F.col("b").alias("a"), F.col("a").alias("b"), "s")).unionByName(diagonal).select("pdf", "a", "b", r6(F.col("s")).alias("s"))


@query("f13_document_similarity", with_views("docpairs") + """ SELECT pdf, count(*) AS n, round(avg(cosine), 6) AS avg_cosine, round(avg(vgg), 6) AS avg_vgg, round(avg(vit), 6) AS avg_vit,
count_if(cosine >= 0.2) AS high_cosine, count_if(vgg >= 0.2) AS high_vgg, count_if(vit >= 0.2) AS high_vit FROM docpairs GROUP BY pdf""")
def f13(spark, d):
    m = ("cosine", "vgg", "vit")
    return document_pairs(spark, d).groupBy("pdf").agg(F.count("*").alias("n"), *(r6(F.avg(c)).alias(f"avg_{c}") for c in m), *(F.count_if(F.col(c) >= 0.2).alias(f"high_{c}") for c in m))


@query("f14_overall_similarity", with_views("docpairs") + " SELECT count(DISTINCT pdf) AS n_pdfs, count(*) AS n, round(avg(cosine), 6) AS overall FROM docpairs")
def f14(spark, d):
    by = document_pairs(spark, d).groupBy("pdf").agg(F.count("*").alias("n"), F.avg("cosine").alias("m"))
    return by.agg(F.count("*").alias("n_pdfs"), F.sum("n").alias("n"), r6(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("overall"))


STACK = "stack(3, 'cosine', cosine, 'vgg', vgg, 'vit', vit) as (method, s)"
UNPIVOT = """SELECT pdf, 'cosine' AS method, cosine AS s FROM docpairs UNION ALL SELECT pdf, 'vgg', vgg FROM docpairs UNION ALL SELECT pdf, 'vit', vit FROM docpairs"""


@query("f15_best_method", with_views("docpairs") + f", l AS ({UNPIVOT}), m AS (SELECT pdf, method, avg(s) AS a FROM l GROUP BY pdf, method), k AS (SELECT *, row_number() OVER (PARTITION BY pdf ORDER BY a DESC, method) AS rn FROM m) SELECT pdf, method AS best_method, round(a, 6) AS best_score FROM k WHERE rn = 1")
def f15(spark, d):
    m = document_pairs(spark, d).select("pdf", F.expr(STACK)).groupBy("pdf", "method").agg(F.avg("s").alias("a"))
    best = m.groupBy("pdf").agg(F.min(F.struct((-F.col("a")).alias("neg"), "method")).alias("x"))
    return best.select("pdf", F.col("x.method").alias("best_method"), r6(-F.col("x.neg")).alias("best_score"))


@query("f16_g2_method_performance", with_views("docpairs") + f""", l AS ({UNPIVOT}), m AS (SELECT method, count(*) AS n, avg(s) AS a, count_if(s >= 0.2) AS high FROM l GROUP BY method)
SELECT method, n, round(a, 6) AS mean, high, round(100.0 * high / n, 4) AS high_rate, row_number() OVER (ORDER BY a DESC, method) AS rank FROM m""")
def f16(spark, d):
    m = document_pairs(spark, d).select("pdf", F.expr(STACK)).groupBy("method").agg(F.count("*").alias("n"), F.avg("s").alias("a"), F.count_if(F.col("s") >= 0.2).alias("high"))
    # a row for each method: the window without a key is bounded
    return m.select("method", "n", r6(F.col("a")).alias("mean"), "high", F.round(100.0 * F.col("high") / F.col("n"), 4).alias("high_rate"), F.row_number().over(W.orderBy(F.desc("a"), "method")).cast("bigint").alias("rank"))


@query("g4_h4_top_pairs", with_views("pairs") + " SELECT sig_a, sig_b, round(cosine, 6) AS cosine FROM pairs ORDER BY pairs.cosine DESC, sig_a, sig_b LIMIT 50")
def g4(spark, d):
    return pairs.blocked_top(sig(spark, d), 50).select("sig_a", "sig_b", r6(F.col("cosine")).alias("cosine"))


LEADERS = """, g AS (SELECT pdf, list_sort(list(struct_pack(id := sig_id, u := u))) AS xs FROM uni GROUP BY pdf),
f AS (SELECT pdf, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, d: CASE WHEN len(list_filter(acc, lambda k: list_dot_product(k.u, d[1].u) >= 0.2)) > 0 THEN acc ELSE list_concat(acc, d) END) AS ls FROM g),
l AS (SELECT pdf, unnest(ls) AS x, unnest(range(len(ls))) AS no FROM f),
near AS (SELECT s.pdf, s.sig_id, l.no, l.x.id AS lid FROM uni s JOIN l ON s.pdf = l.pdf AND (l.x.id = s.sig_id OR (l.x.id < s.sig_id AND list_dot_product(s.u, l.x.u) >= 0.2)))"""


def cluster_sql(pick: str) -> str:
    return with_views("uni") + LEADERS + f" SELECT pdf, sig_id, coalesce(max(CASE WHEN lid = sig_id THEN no END), {pick}(no)) AS label FROM near GROUP BY pdf, sig_id"


@query("j1_j7_leader_clusters_last", cluster_sql("max"))
def j1(spark, d):
    return clusters.leader_clusters(sig(spark, d), ["pdf"], 0.2, "last").withColumn("label", F.col("label").cast("bigint"))


@query("j2_leader_clusters_first", cluster_sql("min"))
def j2(spark, d):
    return clusters.leader_clusters(sig(spark, d), ["pdf"], 0.2, "first").withColumn("label", F.col("label").cast("bigint"))


@query("j3_hierarchical_clusters")
def j3(spark, d):
    return clusters.hierarchical_clusters(sig(spark, d), ["pdf"]).select("pdf", "sig_id", "label", r6(F.col("score")).alias("score"))


DBSCAN = with_views("pairs") + """, e AS (SELECT sig_a AS a, sig_b AS b FROM pairs WHERE cosine >= 0.3 UNION ALL SELECT sig_b, sig_a FROM pairs WHERE cosine >= 0.3),
core AS (SELECT a FROM e GROUP BY a HAVING count(*) + 1 >= 3), ce AS (SELECT e.a, e.b FROM e JOIN core x ON e.a = x.a JOIN core y ON e.b = y.a)"""


@query("j4_density_clusters", "WITH RECURSIVE " + DBSCAN[5:] + """, reach(a, r) AS (SELECT a, a FROM core UNION SELECT ce.b, reach.r FROM reach JOIN ce ON reach.a = ce.a),
root AS (SELECT a, min(r) AS root FROM reach GROUP BY a), border AS (SELECT e.a, min(root.root) AS near FROM e JOIN root ON e.b = root.a GROUP BY e.a)
SELECT s.sig_id, coalesce(root.root, border.near, -1) AS label FROM sig s LEFT JOIN root ON s.sig_id = root.a LEFT JOIN border ON s.sig_id = border.a""")
def j4(spark, d):
    return clusters.blocked_density(sig(spark, d), 0.3, 3)


@query("j5_silhouette", with_views("uni") + """, n AS (SELECT writer, count(*) AS n FROM uni GROUP BY writer),
m AS (SELECT x.sig_id, x.writer, y.writer AS other, sum(CASE WHEN x.sig_id <> y.sig_id THEN 1 - list_dot_product(x.u, y.u) ELSE 0 END) AS s FROM uni x CROSS JOIN uni y GROUP BY x.sig_id, x.writer, y.writer),
ab AS (SELECT m.sig_id, m.writer, max(CASE WHEN m.other = m.writer AND n.n > 1 THEN m.s / (n.n - 1) END) AS a, min(CASE WHEN m.other <> m.writer THEN m.s / n.n END) AS b FROM m JOIN n ON m.other = n.writer GROUP BY m.sig_id, m.writer)
SELECT sig_id, writer AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM ab""")
def j5(spark, d):
    return clusters.silhouette(sig(spark, d), "writer").select("sig_id", "label", r6(F.col("s")).alias("s"))


@query("j6_j8_auto_clusters")
def j6(spark, d):
    """The best of three methods by silhouette over the corpus."""
    return clusters.adaptive_clusters(sig(spark, d))


@query("j8_j9_signer_profiles")
def j8(spark, d):
    """Signers of the whole corpus, numbered by their first mark, with their profiles."""
    s = sig(spark, d)
    p = clusters.signer_profiles(s, materialised(clusters.adaptive_clusters(s)))
    p = ranked(p, ["representative"], "number")
    return p.select(clusters.numbered(F.col("number")).alias("signer"), "n_signatures", "n_documents", "documents", "representative", r6(F.col("confidence")).alias("confidence"))


@query("j11_two_level_clusters")
def j11(spark, d):
    """Clusters within clusters, numbered over all by their first mark."""
    k = materialised(clusters.two_level_clusters(sig(spark, d)))
    firsts = k.groupBy("level1", "label").agg(F.min("sig_id").alias("first"))
    numbers = ranked(firsts, ["first"], "number").select("level1", "label", "number")
    return k.join(numbers, ["level1", "label"]).select("sig_id", "level1", clusters.numbered(F.col("number")).alias("signer"), "confidence")


@query("f18_signer_profiles", with_views("sig") + """ SELECT writer, count(*) AS n_signatures, count(DISTINCT pdf) AS n_documents, substr(array_to_string(list_sort(list(DISTINCT pdf)), ','), 1, 500) AS documents, min(sig_id) AS representative FROM sig GROUP BY writer""")
def f18(spark, d):
    s = sig(spark, d)
    sizes = s.groupBy("writer").agg(F.count("*").alias("n_signatures"), F.min("sig_id").alias("representative"))
    documents = s.select("writer", "pdf").distinct().groupBy("writer").agg(F.count("*").alias("n_documents"))
    first = leading_values(s, ["writer"], "pdf").select("writer", F.substring(F.array_join("first", ","), 1, 500).alias("documents"))
    return sizes.join(documents, "writer").join(first, "writer").select("writer", "n_signatures", "n_documents", "documents", "representative")


@query("f18_f20_sketched_documents", with_views("sig") + """ SELECT writer, count(*) AS n_signatures, count(DISTINCT pdf) AS n_documents, true AS within FROM sig GROUP BY writer""")
def f18_sketched(spark, d):
    """Documents of each signer from sketches of each page number, merged, beside the exact count: ``within`` five standard errors, or one document."""
    s = sig(spark, d)
    parts = materialised(sketches.distinct_sketches(s, ["writer", "page"], "pdf"))
    exact = s.groupBy("writer").agg(F.count("*").alias("n_signatures"), F.countDistinct("pdf").alias("n_documents"))
    near = F.abs(F.col("n_distinct") - F.col("n_documents")) <= F.greatest(F.lit(1.0), F.col("n_documents") * 5 * sketches.relative_error())
    return exact.join(sketches.estimates(parts, ["writer"]).drop("n_rows"), "writer").select("writer", "n_signatures", "n_documents", near.alias("within"))


@query("m_scores_by_hook", with_views("docpairs") + """ SELECT sig_a, sig_b, CASE sig_a % 3 WHEN 0 THEN 'cosine' WHEN 1 THEN 'vgg' ELSE 'vit' END AS scorer, round(CASE sig_a % 3 WHEN 0 THEN cosine WHEN 1 THEN vgg ELSE vit END, 6) AS score FROM docpairs WHERE sig_b = sig_a + 1""")
def scores_by_hook(spark, d):
    """Neighbours of a document, each pair scored by the scorer that its own column names."""
    s = sig(spark, d).select("sig_id", "pdf", "v")
    nxt = s.select((F.col("sig_id") - 1).alias("sig_id"), "pdf", F.col("v").alias("w"))
    name = F.when(F.col("sig_id") % 3 == 0, "cosine").when(F.col("sig_id") % 3 == 1, "vgg").otherwise("vit")
    p = s.join(nxt, ["sig_id", "pdf"]).withColumn("scorer", name)
    return p.select(F.col("sig_id").alias("sig_a"), (F.col("sig_id") + 1).alias("sig_b"), "scorer", r6(hooks.scored(p, "scorer", "v", "w")).alias("score"))


@query("f19_cluster_confidence", with_views("pairs") + """, p AS (SELECT wa AS writer, avg(cosine) AS m FROM pairs WHERE wa = wb GROUP BY wa)
SELECT k.writer, round(coalesce(p.m, 0.5), 6) AS confidence FROM (SELECT DISTINCT writer FROM uni) k LEFT JOIN p ON k.writer = p.writer""")
def f19(spark, d):
    return clusters.confidence(sig(spark, d), ["writer"]).select("writer", r6(F.col("confidence")).alias("confidence"))


@query("f20_clustering_summary", with_views("sig") + """, w AS (SELECT writer, count(*) AS n, count(DISTINCT pdf) AS docs FROM sig GROUP BY writer)
SELECT count(*) AS n_signers, sum(n)::BIGINT AS n_signatures, round(avg(n), 4) AS per_signer, count_if(n = 1) AS singletons, count_if(docs > 1) AS multi_document FROM w""")
def f20(spark, d):
    w = sig(spark, d).groupBy("writer").agg(F.count("*").alias("n"), F.countDistinct("pdf").alias("docs"))
    return w.agg(F.count("*").alias("n_signers"), F.sum("n").alias("n_signatures"), F.round(F.avg("n"), 4).alias("per_signer"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("docs") > 1).alias("multi_document"))


@query("j14_duplicate_levels", with_views("sig") + """, crops AS (SELECT sig_id, v FROM sig UNION ALL SELECT sig_id + 1000000000, CASE sig_id % 4 WHEN 0 THEN v WHEN 1 THEN list_transform(v, lambda x: x * 2 + 1) ELSE list_concat([-v[1]], list_slice(v, 2, 64)) END FROM sig WHERE sig_id % 4 < 3),
q AS (SELECT sig_id, v, list_transform(v, lambda x: floor((x - list_min(v)) / (list_max(v) - list_min(v)) * 15 + 0.5)) AS px, list_transform(v, lambda x: x > 0) AS bits FROM crops),
f AS (SELECT *, min(sig_id) OVER (PARTITION BY v) AS raw_first, min(sig_id) OVER (PARTITION BY px) AS px_first FROM q), r AS (SELECT * FROM f WHERE sig_id = px_first),
c AS (SELECT sig_id, bits, list_transform(v, lambda x: x - list_avg(v)) AS z FROM r),
n AS (SELECT a.sig_id AS sig_a, b.sig_id AS sig_b FROM c a JOIN c b ON a.sig_id < b.sig_id AND len(list_filter(list_zip(a.bits, b.bits), lambda p: p[1] <> p[2])) <= 2
  AND list_dot_product(a.z, b.z) / sqrt(list_dot_product(a.z, a.z) * list_dot_product(b.z, b.z)) >= 0.99)
SELECT 'L0' AS level, raw_first AS sig_a, sig_id AS sig_b FROM f WHERE sig_id <> raw_first UNION ALL
SELECT 'L1', px_first, sig_id FROM f WHERE sig_id = raw_first AND sig_id <> px_first UNION ALL SELECT 'L2', sig_a, sig_b FROM n""")
def j14(spark, d):
    """Duplicates by level: equal streams, equal pixels (16 greys), and sign hashes within two bits with a correlation of 0.99.

    Three of four marks have a second crop: the same, a brighter one, and one that differs in its first value.
    A copy is paired with the first of its class; only firsts go on to the next level.
    Hashes within two bits of 64 agree in one of three bands at least.
    """
    s = sig(spark, d).select("sig_id", "v")
    kind, v = F.col("sig_id") % 4, F.col("v")
    second = F.when(kind == 0, v).when(kind == 1, F.transform(v, lambda x: x * 2 + 1)).otherwise(F.concat(F.array(-v[0]), F.slice(v, 2, 63)))
    crops = s.unionByName(s.where(kind < 3).select((F.col("sig_id") + 1000000000).alias("sig_id"), second.alias("v")))
    return duplicates.levels(crops).select("level", "sig_a", "sig_b")


FINDINGS = with_views("sig") + """, crops AS (SELECT sig_id, sig_id AS of, v FROM sig UNION ALL SELECT sig_id + 1000000000, sig_id, CASE sig_id % 4 WHEN 0 THEN v WHEN 1 THEN list_transform(v, lambda x: x * 2 + 1) WHEN 2 THEN list_concat([v[1] + 0.01], list_slice(v, 2, 64))
  ELSE list_transform(range(1, 65), lambda i: CASE WHEN i % 2 = 1 THEN 2 * v[i] + v[i + 1] / 2 + 1 ELSE 3 * v[i] - v[i - 1] - 2 END) END FROM sig),
m AS (SELECT c.sig_id, c.v, (['scanned_wet_ink', 'pasted_image', 'crypto_signature', 'vector_ink', 'scanned_wet_ink'])[(of + (c.sig_id <> of)::INT * (of % 3)) % 5 + 1] AS class, s.pdf || '/' || CASE WHEN c.sig_id <> of AND of % 8 >= 4 THEN 'other' ELSE s.page::VARCHAR END AS page_hash FROM crops c JOIN sig s ON c.of = s.sig_id),
basis AS (SELECT list_transform(range(64), lambda u: list_transform(range(64), lambda k: cos(pi() * (2 * (k // 8) + 1) * (u // 8) / 16) * cos(pi() * (2 * (k % 8) + 1) * (u % 8) / 16))) AS c),
q AS (SELECT sig_id, v, list_transform(v, lambda x: floor((x - list_min(v)) / (list_max(v) - list_min(v)) * 15 + 0.5)) AS px FROM m),
f AS (SELECT *, min(sig_id) OVER (PARTITION BY v) AS raw_first, min(sig_id) OVER (PARTITION BY px) AS px_first FROM q), r AS (SELECT * FROM f WHERE sig_id = px_first),
w AS (SELECT sig_id, v, list_transform(c, lambda b: list_dot_product(v, b)) AS t, list_transform(v, lambda x: x - list_avg(v)) AS z FROM r, basis),
h AS (SELECT sig_id, z, v, list_transform(t, lambda x: x > list_median(list_slice(t, 2, 64))) AS bits FROM w),
n AS (SELECT a.sig_id AS sig_a, b.sig_id AS sig_b FROM h a JOIN h b ON a.sig_id < b.sig_id AND len(list_filter(list_zip(a.bits, b.bits), lambda p: p[1] <> p[2])) <= 2
  AND list_dot_product(a.z, b.z) / sqrt(list_dot_product(a.z, a.z) * list_dot_product(b.z, b.z)) >= 0.99),
p0 AS (SELECT sig_id, list_transform(range(32), lambda i: v[2 * i + 1]) AS xs, list_transform(range(32), lambda i: v[2 * i + 2]) AS ys FROM h),
p1 AS (SELECT sig_id, list_transform(xs, lambda x: x - list_avg(xs)) AS xs, list_transform(ys, lambda y: y - list_avg(ys)) AS ys FROM p0),
p2 AS (SELECT *, list_dot_product(xs, xs) AS a, list_dot_product(xs, ys) AS b, list_dot_product(ys, ys) AS c FROM p1),
p3 AS (SELECT sig_id, list_transform(xs, lambda x: x / sqrt(a)) AS xs, list_transform(list_zip(xs, ys), lambda p: (p[2] - b / a * p[1]) / sqrt(c - b * b / a)) AS ys FROM p2),
p4 AS (SELECT *, xs[1] / sqrt(xs[1] * xs[1] + ys[1] * ys[1]) AS co, ys[1] / sqrt(xs[1] * xs[1] + ys[1] * ys[1]) AS si FROM p3),
p5 AS (SELECT sig_id, list_transform(list_zip(xs, ys), lambda p: p[1] * co + p[2] * si) AS xs, list_transform(list_zip(xs, ys), lambda p: p[2] * co - p[1] * si) AS ys FROM p4),
p6 AS (SELECT sig_id, list_concat(xs, list_transform(ys, lambda y: y * sign(ys[2]))) AS form FROM p5),
k AS (SELECT sig_id, s AS shift, list_transform(form, lambda x: floor(x / 1e-4 + s)) AS cells FROM p6, (SELECT unnest([0.0, 0.5]) AS s) g),
l3 AS (SELECT DISTINCT first AS sig_a, sig_id AS sig_b FROM (SELECT sig_id, min(sig_id) OVER (PARTITION BY shift, cells) AS first FROM k) x WHERE sig_id <> first),
al AS (SELECT 'L0' AS level, raw_first AS sig_a, sig_id AS sig_b FROM f WHERE sig_id <> raw_first UNION ALL SELECT 'L1', px_first, sig_id FROM f WHERE sig_id = raw_first AND sig_id <> px_first UNION ALL SELECT 'L2', sig_a, sig_b FROM n
  UNION ALL SELECT 'L3', sig_a, sig_b FROM l3 WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.sig_a = l3.sig_a AND n.sig_b = l3.sig_b))
SELECT level, sig_a, sig_b, a.class AS class_a, b.class AS class_b, CASE WHEN level IN ('L2', 'L3') THEN NULL WHEN 'crypto_signature' IN (a.class, b.class) THEN 'benign' WHEN a.class = 'scanned_wet_ink' AND b.class = 'scanned_wet_ink' THEN 'anomalous'
  WHEN a.class = 'pasted_image' AND b.class = 'pasted_image' THEN 'reused' WHEN a.class IN ('pasted_image', 'scanned_wet_ink') AND b.class IN ('pasted_image', 'scanned_wet_ink') THEN 'lifted' ELSE 'unclassified' END AS reading,
  CASE WHEN level IN ('L0', 'L1') THEN a.class = 'scanned_wet_ink' AND b.class IN ('scanned_wet_ink', 'pasted_image') OR a.class = 'pasted_image' AND b.class = 'scanned_wet_ink' END AS escalate, a.page_hash = b.page_hash AS same_page_context
FROM al JOIN m a ON sig_a = a.sig_id JOIN m b ON sig_b = b.sig_id"""


@query("j14_duplicate_findings", FINDINGS)
def j14_findings(spark, d):
    """All four levels with their readings and the pages' context.

    Each mark has a second crop: of every four, one is the same, one brighter, one differs a
    little in its first value, and one is its path under an affine map. A mark's values serve
    as a picture of 8 by 8 and as a path of 32 points.
    """
    s = sig(spark, d).select("sig_id", "pdf", "page", "v")
    kind, v, i = F.col("sig_id") % 4, F.col("v"), F.col("sig_id")
    odd = lambda k: F.when(k % 2 == 0, 2 * F.get(v, k) + F.get(v, k + 1) / 2 + 1).otherwise(3 * F.get(v, k) - F.get(v, k - 1) - 2)
    second = F.when(kind == 0, v).when(kind == 1, F.transform(v, lambda x: x * 2 + 1)).when(kind == 2, F.concat(F.array(v[0] + 0.01), F.slice(v, 2, 63))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(63)), odd))
    classes = F.array(*map(F.lit, ("scanned_wet_ink", "pasted_image", "crypto_signature", "vector_ink", "scanned_wet_ink")))
    named = lambda n: F.element_at(classes, (n % 5 + 1).cast("int"))
    page = lambda p: F.concat_ws("/", F.col("pdf").cast("string"), p)
    own = s.select("sig_id", "v", named(i).alias("class"), page(F.col("page").cast("string")).alias("page_hash"))
    copy = s.select((i + 1000000000).alias("sig_id"), second.alias("v"), named(i + i % 3).alias("class"), page(F.when(i % 8 >= 4, "other").otherwise(F.col("page").cast("string"))).alias("page_hash"))
    crops = materialised(own.unionByName(copy))
    path = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("v", 2 * k).alias("x"), F.get("v", 2 * k + 1).alias("y")))
    return duplicates.findings(crops.withColumn("path", path))


@query("j14_perceptual_duplicates", with_views("sig") + """, k AS (SELECT sig_id, array_to_string(list_transform(list_slice(v, 1, 8), lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM sig)
SELECT bits, count(*) AS n, min(sig_id) AS first_id FROM k GROUP BY bits HAVING count(*) > 1""")
def j14_bands(spark, d):
    """Marks whose leading sign bits agree: one band of the sign hash."""
    bits = F.substring(duplicates.sign_hash(F.col("v")), 1, 8)
    return sig(spark, d).groupBy(bits.alias("bits")).agg(F.count("*").alias("n"), F.min("sig_id").alias("first_id")).where("n > 1")


@query("k1_pair_types", with_views("pairs") + """ SELECT CASE WHEN ra = 'reference' AND rb = 'reference' THEN 'ref-ref (same writer)' WHEN (ra = 'reference' AND rb = 'control') OR (rb = 'reference' AND ra = 'control') THEN 'ref-control (diff writer)'
WHEN (ra = 'reference' AND rb = 'questioned') OR (rb = 'reference' AND ra = 'questioned') THEN 'ref-questioned (THE QUESTION)' WHEN ra = 'questioned' AND rb = 'questioned' THEN 'q-q'
WHEN ra <> rb THEN 'q-control (diff writer)' ELSE 'control-control (diff writer)' END AS kind, count(*) AS n, count_if(wa <> wb) AS cross_group FROM pairs GROUP BY 1""")
def k1(spark, d):
    # a control character stands in no role, so that the first one ends it whatever the writer's name holds
    both = F.concat_ws("\x1f", "role", F.col("writer").cast("string"))
    p = pairs.blocked_statistics(sig(spark, d).withColumn("both", both), "both")
    part = lambda side, i: F.split(side, "\x1f", 2)[i]
    kind = verdicts.pair_type(part("a", 0), part("b", 0))
    return p.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(part("a", 1) != part("b", 1), F.col("n"))), F.lit(0)).alias("cross_group"))
