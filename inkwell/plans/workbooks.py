"""Sheets of the result workbooks, and folders of files that Spark writes and reads back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.functions import strings
from inkwell.operators import boxes as ob
from inkwell.operators import clusters, crossref
from inkwell.operators import workbooks as wb
from inkwell.operators.staging import fresh_folder, materialised
from inkwell.plans.base import boxes, files, objects, query, read, sig, with_views
from inkwell.plans.detection import CLASSIFIED
from inkwell.plans.reports import STATS, target_stats
from inkwell.plans.vectors import MATCH_SQL, document_pairs, matched
from inkwell.sources import archives, folders, hooks, sinks
from inkwell.sources import files as fs

METHODS = ["cosine", "vgg", "vit"]
#: Pairs that count as high here: the tables' vectors are hardly alike.
HIGH = 0.2
DOCS = with_views("docpairs") + """, dc AS (SELECT pdf, count(DISTINCT page) AS pages, count(*) AS marks FROM sig GROUP BY pdf), pr AS (SELECT p.*, (cosine + vgg + vit) / 3 AS combined, a.page AS page_a, b.page AS page_b
FROM docpairs p JOIN sig a ON p.sig_a = a.sig_id JOIN sig b ON p.sig_b = b.sig_id WHERE p.pdf % 5 <> 4),
bd AS (SELECT dc.pdf, dc.pages, dc.marks, count(pr.sig_a) AS n, coalesce(count_if(combined >= 0.2), 0) AS combined_high, avg(cosine) AS m1, avg(vgg) AS m2, avg(vit) AS m3, coalesce(count_if(cosine >= 0.2), 0) AS h1, coalesce(count_if(vgg >= 0.2), 0) AS h2, coalesce(count_if(vit >= 0.2), 0) AS h3
FROM dc LEFT JOIN pr ON dc.pdf = pr.pdf WHERE dc.pdf % 5 <> 4 GROUP BY dc.pdf, dc.pages, dc.marks),
bb AS (SELECT *, CASE WHEN n = 0 THEN 'None' WHEN m1 >= m2 AND m1 >= m3 THEN 'cosine' WHEN m2 >= m3 THEN 'vgg' ELSE 'vit' END AS best FROM bd)"""


def all_documents(spark, d):
    return sig(spark, d).groupBy("pdf").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("marks"))


def documents(spark, d):
    """Documents that were read; every fifth failed."""
    marks = all_documents(spark, d)
    return marks.where("pdf % 5 <> 4"), marks.where("pdf % 5 = 4").select("pdf", F.lit("unreadable").alias("error"))


def all_compared(spark, d):
    """Pairs of all documents, with their pages."""
    p = document_pairs(spark, d).withColumn("combined", (F.col("cosine") + F.col("vgg") + F.col("vit")) / 3)
    for s in ("a", "b"):
        p = p.join(sig(spark, d).select(F.col("sig_id").alias(f"sig_{s}"), F.col("page").alias(f"page_{s}")), f"sig_{s}")
    return p


def compared(spark, d):
    """Pairs of the documents that were read; those that failed have none."""
    return all_compared(spark, d).where("pdf % 5 <> 4")


@query("b7_file_summary", DOCS + """ SELECT pdf::VARCHAR AS "PDF_Name", pages::VARCHAR AS "Total_Pages", marks::VARCHAR AS "Signatures_Detected", n::VARCHAR AS "Total_Comparisons",
printf('%.4f', coalesce(m1, 0)) AS "Avg_cosine_Similarity", printf('%.4f', coalesce(m2, 0)) AS "Avg_vgg_Similarity", printf('%.4f', coalesce(m3, 0)) AS "Avg_vit_Similarity", h1::VARCHAR AS "High_Sim_cosine_80%", h2::VARCHAR AS "High_Sim_vgg_80%", h3::VARCHAR AS "High_Sim_vit_80%",
combined_high::VARCHAR AS "High_Sim_Combined_80%", best AS "Best_Method_by_Avg", printf('%.4f', coalesce(greatest(m1, m2, m3), 0)) AS "Best_Avg_Similarity", 'Success' AS "Processing_Status", NULL::VARCHAR AS "Error_Message" FROM bb
UNION ALL SELECT pdf::VARCHAR, 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'Error', 'unreadable' FROM dc WHERE pdf % 5 = 4""")
def b7_files(spark, d):
    good, bad = documents(spark, d)
    return wb.file_summary(good, compared(spark, d), bad, METHODS, HIGH)


@query("b7_overall_summary", DOCS + """, t AS (SELECT count(*) AS pdfs, sum(marks)::BIGINT AS marks FROM dc WHERE pdf % 5 <> 4), p AS (SELECT count(*) AS n, avg(cosine) AS m1, avg(vgg) AS m2, avg(vit) AS m3, count_if(cosine >= 0.2) AS h1, count_if(vgg >= 0.2) AS h2, count_if(vit >= 0.2) AS h3 FROM pr)
SELECT m."Metric", m."Value" FROM t, p, (SELECT unnest([{'Metric': 'Total PDFs Processed', 'Value': t.pdfs::VARCHAR}, {'Metric': 'Total Signatures Detected', 'Value': t.marks::VARCHAR}, {'Metric': 'Total Similarity Comparisons', 'Value': p.n::VARCHAR},
{'Metric': 'Average cosine Similarity (All Files)', 'Value': printf('%.4f', p.m1)}, {'Metric': 'Average vgg Similarity (All Files)', 'Value': printf('%.4f', p.m2)}, {'Metric': 'Average vit Similarity (All Files)', 'Value': printf('%.4f', p.m3)},
{'Metric': 'High Similarity Pairs cosine (80%+)', 'Value': p.h1::VARCHAR}, {'Metric': 'High Similarity Pairs vgg (80%+)', 'Value': p.h2::VARCHAR}, {'Metric': 'High Similarity Pairs vit (80%+)', 'Value': p.h3::VARCHAR}]) AS m) q""")
def b7_overall(spark, d):
    return wb.overall_summary(documents(spark, d)[0], compared(spark, d), METHODS, HIGH)


@query("b7_detailed_comparisons", DOCS + """ SELECT pdf AS "PDF_Name", sig_a AS "Signature1_ID", sig_b AS "Signature2_ID", page_a AS "Signature1_Page", page_b AS "Signature2_Page", printf('%.4f', cosine) AS "cosine_Similarity", printf('%.4f', vgg) AS "vgg_Similarity",
printf('%.4f', vit) AS "vit_Similarity", printf('%.4f', combined) AS "Combined_Similarity", CASE WHEN combined >= 0.8 THEN 'Yes' ELSE 'No' END AS "High_Similarity_80%", CASE WHEN combined >= 0.9 THEN 'Yes' ELSE 'No' END AS "Very_High_Similarity_90%" FROM pr""")
def b7_details(spark, d):
    return wb.detailed_comparisons(compared(spark, d), METHODS)


ALL_DOCS = DOCS.replace(" WHERE p.pdf % 5 <> 4", "").replace(" WHERE dc.pdf % 5 <> 4", "")


@query("b7_pdf_summary", ALL_DOCS + """ SELECT pdf AS "PDF_Name", pages AS "Total_Pages", marks AS "Signatures_Detected", n AS "Similarity_Comparisons", combined_high AS "Combined_High_Similarity_Pairs_80%", best AS "Best_Method" FROM bb""")
def b7_pdfs(spark, d):
    """Every document of the table; none counts as failed here."""
    return wb.document_summary(all_documents(spark, d), all_compared(spark, d), METHODS, HIGH)


@query("b7_signature_metadata", with_views("box") + """, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS number FROM box), k AS (SELECT *, (page // 20) || '_page' || printf('%03d', page) || '_sig' || printf('%03d', number) AS stem FROM n),
u AS (SELECT *, stem || '_' || substr(sha256(stem), 1, 8) AS ident FROM k) SELECT ident AS unique_id, (page // 20) || '.pdf' AS pdf_name, page AS page_number, number AS signature_index, round(score, 4) AS confidence_score,
x0 AS x0, y0 AS y0, x1 AS x1, y1 AS y1, 'signatures/' || ident || '.png' AS signature_path FROM u""")
def b7_metadata(spark, d):
    """Every detection's record; the box is read back from its text."""
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("page").orderBy(F.desc("score"), "id"))
    m = wb.mark_metadata(boxes(spark, d).withColumn("number", number).withColumn("pdf", F.expr("page div 20")))
    box = F.from_json("bounding_box", "array<double>")
    return m.withColumns({c: box[i] for i, c in enumerate(("x0", "y0", "x1", "y1"))}).drop("bounding_box").withColumn("signature_index", F.col("signature_index").cast("bigint"))


@query("b7_similarity_analysis_legacy", DOCS + """ SELECT pdf AS pdf_name, sig_a AS signature1_id, sig_b AS signature2_id, page_a AS signature1_page, page_b AS signature2_page, round(cosine, 6) AS cosine_similarity, round(vgg, 6) AS vgg_similarity,
sig_a % 3 = 0 AS missing, CASE WHEN sig_a % 3 <> 0 THEN round(vit, 6) END AS vit_similarity, round(combined, 6) AS combined_similarity, combined >= 0.7 AS similarity_threshold_70, combined >= 0.8 AS similarity_threshold_80, combined >= 0.9 AS similarity_threshold_90 FROM pr""")
def b7_legacy(spark, d):
    """The older form of the comparison sheet; a third of the pairs lack the optional method."""
    p = compared(spark, d).withColumn("vit", F.when(F.col("sig_a") % 3 != 0, F.col("vit")))
    rows = wb.similarity_analysis_legacy(p, METHODS, ("vit",))
    return rows.withColumn("missing", F.col("vit_similarity") == "N/A").withColumn("vit_similarity", F.col("vit_similarity").try_cast("double"))


@query("b7_error_analysis", with_views("sig") + " SELECT DISTINCT pdf::VARCHAR AS pdf_path, 'unreadable' AS error FROM sig WHERE pdf % 5 = 4")
def b7_errors(spark, d):
    return wb.error_analysis(documents(spark, d)[1])


PROFILES = with_views("pairs") + """, cf AS (SELECT wa AS writer, avg(cosine) AS m FROM pairs WHERE wa = wb GROUP BY wa), pf AS (SELECT s.writer, count(*) AS n, count(DISTINCT pdf) AS docs, substr(array_to_string(list_sort(list(DISTINCT pdf)), ','), 1, 500) AS names, min(sig_id) AS first, coalesce(max(cf.m), 0.5) AS conf
FROM sig s LEFT JOIN cf ON s.writer = cf.writer GROUP BY s.writer)"""


def profiles(spark, d):
    s = sig(spark, d)
    p = clusters.signer_profiles(s, s.select("sig_id", F.col("writer").alias("label")))
    return p.withColumn("signer", F.format_string("Signer_%03d", "label"))


@query("b8_signer_identification", PROFILES + """ SELECT 'Signer_' || printf('%03d', writer) AS "Signer_ID", n AS "Signature_Count", docs AS "Documents_Signed", replace(names, ',', ', ') AS "Document_List", first AS "Representative_Signature", printf('%.3f', conf) AS "Confidence_Score",
CASE WHEN conf > 0.8 THEN 'High' WHEN conf > 0.6 THEN 'Medium' ELSE 'Low' END AS "Confidence_Level" FROM pf""")
def b8_signers(spark, d):
    return wb.signer_identification(profiles(spark, d))


@query("b8_clustering_summary", PROFILES + """ SELECT sum(n)::BIGINT AS "Total_Signatures_Processed", count(*) AS "Unique_Signers_Identified", sum(n) / count(*) AS "Average_Signatures_Per_Signer", count_if(conf > 0.8) AS "High_Confidence_Signers", count_if(n = 1) AS "Single_Signature_Signers", count_if(docs > 1) AS "Multi_Document_Signers" FROM pf""")
def b8_summary(spark, d):
    return wb.clustering_summary(profiles(spark, d))


@query("b8_e12_signature_signer_mapping", with_views("uni") + """, e AS (SELECT a.sig_id AS a, b.sig_id AS b FROM uni a JOIN uni b ON a.pdf = b.pdf AND a.sig_id < b.sig_id AND list_dot_product(a.u, b.u) >= 0.2),
g AS (SELECT pdf, list_sort(list(struct_pack(id := sig_id, u := u))) AS xs FROM uni GROUP BY pdf),
f AS (SELECT pdf, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, d: CASE WHEN len(list_filter(acc, lambda k: list_dot_product(k.u, d[1].u) >= 0.2)) > 0 THEN acc ELSE list_concat(acc, d) END) AS ls FROM g),
l AS (SELECT pdf, unnest(ls).id AS id, unnest(range(len(ls))) AS no FROM f), own AS (SELECT s.sig_id, max(l.no) AS no FROM uni s JOIN l ON s.sig_id = l.id GROUP BY s.sig_id),
near AS (SELECT e.b AS sig_id, max(l.no) AS no FROM e JOIN l ON e.a = l.id GROUP BY e.b)
SELECT s.sig_id AS "Signature_ID", s.pdf AS "PDF_Name", s.page AS "Page_Number", CASE WHEN role = 'questioned' THEN 'Unknown' ELSE 'Signer_' || printf('%03d', writer) END AS "Signer_ID", 'PDF_' || coalesce(own.no, near.no) AS "Within_PDF_Cluster"
FROM uni s LEFT JOIN own ON s.sig_id = own.sig_id LEFT JOIN near ON s.sig_id = near.sig_id""")
def b8_mapping(spark, d):
    """Marks with their cluster within the document, and their signer where it is known."""
    s = sig(spark, d)
    within = clusters.leader_clusters(s, ["pdf"], 0.2).select("sig_id", F.concat(F.lit("PDF_"), F.col("label").cast("string")).alias("within"))
    known = s.where("role <> 'questioned'").select("sig_id", F.format_string("Signer_%03d", "writer").alias("signer"))
    return wb.signer_mapping(s.join(within, "sig_id", "left").join(known, "sig_id", "left"))


@query("b8_cross_document_analysis", with_views("sig") + """, s AS (SELECT DISTINCT pdf, 'Signer_' || printf('%03d', writer) AS signer FROM sig) SELECT a.pdf || ' - ' || b.pdf AS "Document_Pair", count(*) AS "Common_Signers", array_to_string(list_sort(list(a.signer)), ', ') AS "Shared_Signer_IDs",
CASE WHEN count(*) > 2 THEN 'High' WHEN count(*) > 1 THEN 'Medium' ELSE 'Low' END AS "Relationship_Strength" FROM s a JOIN s b ON a.signer = b.signer AND a.pdf < b.pdf GROUP BY a.pdf, b.pdf""")
def b8_documents(spark, d):
    s = sig(spark, d).select("pdf", F.format_string("Signer_%03d", "writer").alias("signer"))
    return wb.cross_documents(crossref.shared_signers(s))


@query("b9_similarity_analysis", MATCH_SQL + """ SELECT m.pdf AS "PDF_Name", m.sig_id AS "Signature_ID", s.page AS "Page_Number", coalesce(signer::VARCHAR, 'No Match') AS "Matched_Signer", round(similarity, 6) AS "Similarity_Score", printf('%.1f%%', similarity * 100) AS "Similarity_Percentage",
CASE WHEN similarity > 0.8 THEN 'High' WHEN similarity > 0.6 THEN 'Medium' ELSE 'Low' END AS "Confidence_Level" FROM matched m JOIN sig s ON m.sig_id = s.sig_id""")
def b9_marks(spark, d):
    return wb.mark_similarities(matched(spark, d).join(sig(spark, d).select("sig_id", "page"), "sig_id"))


@query("b9_detailed_analysis", STATS + """ SELECT pdf AS "PDF_Name", signer AS "Reference_Signer", n AS "Signature_Count", CASE WHEN n > 0 THEN 'Yes' ELSE 'No' END AS "Present" FROM st""")
def b9_details(spark, d):
    return wb.detailed_analysis(target_stats(spark, d))


@query("b9_signer_similarity_summary", STATS + """ SELECT pdf AS "PDF_Name", signer AS "Signer_ID", n AS "Match_Count", round(mean, 6) AS "Avg_Similarity", printf('%.1f%%', mean * 100) AS "Avg_Similarity_Percentage", round(top, 6) AS "Max_Similarity", round(low, 6) AS "Min_Similarity",
CASE WHEN mean > 0.8 THEN 'High' WHEN mean > 0.6 THEN 'Medium' ELSE 'Low' END AS "Confidence_Level" FROM st WHERE n > 0""")
def b9_signers(spark, d):
    return wb.signer_similarities(target_stats(spark, d))


def cross_reference_sql() -> str:
    parts, found, number = [], [], []
    for s in range(10):
        n, m = f"max(CASE WHEN signer = {s} THEN n END)", f"max(CASE WHEN signer = {s} THEN mean END)"
        parts += [f"{n} AS \"{s}_Count\"", f"CASE WHEN {n} > 0 THEN 'Yes' ELSE 'No' END AS \"{s}_Present\"", f"CASE WHEN {n} > 0 THEN printf('%.1f%%', {m} * 100) ELSE '0.0%' END AS \"{s}_Similarity%\""]
        found.append(f"CASE WHEN {n} > 0 THEN '{s}' END")
        number.append(f"CASE WHEN {n} > 0 THEN 1 ELSE 0 END")
    return STATS + f""", tm AS (SELECT pdf, count(*) AS marks FROM matched GROUP BY pdf) SELECT st.pdf AS "PDF_Name", max(tm.marks) AS "Total_Signatures", {', '.join(parts)}, {' + '.join(number)} AS "Reference_Signers_Found",
CASE WHEN {' + '.join(number)} > 0 THEN concat_ws(';', {', '.join(found)}) ELSE 'None' END AS "Signer_Details", 'success' AS "Status" FROM st JOIN tm ON st.pdf = tm.pdf GROUP BY st.pdf"""


@query("b9_cross_reference_analysis", cross_reference_sql())
def b9_table(spark, d):
    signers = crossref.pivot_signers(sig(spark, d).where("role = 'reference'").select("writer"))
    totals = sig(spark, d).where("role = 'questioned'").groupBy("pdf").agg(F.count("*").alias("marks"))
    return wb.cross_reference(target_stats(spark, d), totals, signers)


COUNTS = CLASSIFIED + """, ct AS (SELECT page, count_if(classification = 'pasted_image') AS pasted, count_if(classification = 'vector_ink') AS ink, count_if(classification = 'scanned_wet_ink') AS scanned, count_if(classification = 'unmatched') AS un,
count_if(id % 10 = 0) AS signed, count_if(id % 10 = 1) AS empty, count_if(classification IN ('pasted_image', 'vector_ink')) + count_if(id % 10 = 0) AS digital, count(*) AS total FROM classified GROUP BY page)"""


def counts(spark, d):
    from inkwell.plans.detection import f9

    return f9(spark, d)


@query("b4_document_sheet", COUNTS + """ SELECT page AS "Document", digital + scanned AS "TOTAL signs", digital AS "TOTAL digital signs", scanned AS "TOTAL scanned signs", signed AS "  crypto sig fields", empty AS "Empty sig fields (unsigned)", pasted AS "  pasted images", ink AS "  vector ink", un AS "Unmatched", total AS "Total detected" FROM ct""")
def b4_documents(spark, d):
    return wb.per_document(counts(spark, d))


@query("b4_summary_sheet", COUNTS + """, t AS (SELECT count(*) AS n, sum(digital)::BIGINT AS digital, sum(scanned)::BIGINT AS scanned, sum(signed)::BIGINT AS signed, sum(empty)::BIGINT AS empty, sum(pasted)::BIGINT AS pasted, sum(ink)::BIGINT AS ink, sum(un)::BIGINT AS un, count_if(digital > 0 OR scanned > 0) AS any_ FROM ct)
SELECT m."Metric", m."Value" FROM t, (SELECT unnest([{'Metric': 'Documents', 'Value': t.n::VARCHAR}, {'Metric': 'TOTAL signatures', 'Value': (t.digital + t.scanned)::VARCHAR}, {'Metric': 'DIGITAL signatures', 'Value': t.digital::VARCHAR}, {'Metric': '  crypto signature fields (signed)', 'Value': t.signed::VARCHAR},
{'Metric': '  pasted images', 'Value': t.pasted::VARCHAR}, {'Metric': '  vector ink annotations', 'Value': t.ink::VARCHAR}, {'Metric': 'SCANNED signatures (wet ink)', 'Value': t.scanned::VARCHAR}, {'Metric': 'Unmatched detections', 'Value': t.un::VARCHAR},
{'Metric': 'Empty signature fields (unsigned, NOT counted)', 'Value': t.empty::VARCHAR}, {'Metric': 'Documents with any signature', 'Value': t.any_::VARCHAR}]) AS m) q""")
def b4_summary(spark, d):
    return wb.detection_summary(counts(spark, d))


HUMAN = "CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0) ELSE printf('%.1f GB', s / 1073741824.0) END"
LISTED = with_views("files") + """, ls AS (SELECT grp, size, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN '' WHEN 3 THEN 'zip' ELSE 'docx' END AS ext FROM files)"""


def sheets(spark, d):
    listed = files(spark, d).select(F.col("grp").alias("directory"), strings.extension(F.col("rel_path")).alias("extension"), "size")
    return wb.file_counts(listed, strings.human_size)


@query("b5_extension_sheet", LISTED + f""" SELECT "Extension", "Files", s AS "Size (bytes)", {HUMAN} AS "Size" FROM (SELECT CASE WHEN ext = '' THEN '(none)' ELSE '.' || ext END AS "Extension", count(*) AS "Files", sum(size)::BIGINT AS s FROM ls GROUP BY 1) q""")
def b5_extensions(spark, d):
    return sheets(spark, d)["By extension"]


@query("b5_directory_sheet", LISTED + f""" SELECT "Directory", "Files", "PDFs", "Images", s AS "Size (bytes)", {HUMAN} AS "Size" FROM (SELECT grp AS "Directory", count(*) AS "Files", count_if(ext = 'pdf') AS "PDFs", count_if(ext = 'png') AS "Images", sum(size)::BIGINT AS s FROM ls GROUP BY 1) q""")
def b5_directories(spark, d):
    return sheets(spark, d)["By directory"]


@query("b5_summary_sheet", LISTED + f""", t AS (SELECT count(*) AS n, count(DISTINCT grp) AS dirs, sum(size)::BIGINT AS s, count_if(ext = 'pdf') AS pdfs, count_if(ext = 'png') AS images, count(DISTINCT ext) AS exts FROM ls), h AS (SELECT *, {HUMAN} AS human FROM t)
SELECT m."Metric", m."Value" FROM h, (SELECT unnest([{{'Metric': 'Files', 'Value': h.n::VARCHAR}}, {{'Metric': 'Directories with files', 'Value': h.dirs::VARCHAR}}, {{'Metric': 'Total size (bytes)', 'Value': h.s::VARCHAR}}, {{'Metric': 'Total size', 'Value': h.human}},
{{'Metric': 'PDFs', 'Value': h.pdfs::VARCHAR}}, {{'Metric': 'Images', 'Value': h.images::VARCHAR}}, {{'Metric': 'Other', 'Value': (h.n - h.pdfs - h.images)::VARCHAR}}, {{'Metric': 'Distinct extensions', 'Value': h.exts::VARCHAR}}]) AS m) q""")
def b5_summary(spark, d):
    return sheets(spark, d)["Summary"]


FOLDERS = """WITH t AS (SELECT 'source=' || coalesce(source, '__HIVE_DEFAULT_PARTITION__') || '/lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') || '/as=' || CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'text' END AS grp,
  octet_length(encode(CASE WHEN doc_id % 3 = 0 THEN '%PDF-' ELSE '' END || coalesce(text, ''))) + 1 AS size FROM documents)"""


def folder_tree(spark, d):
    """The whole documents as text files in a tree by source and language; every third begins as a PDF does."""
    root = fresh_folder(spark, "corpus")
    pdf = F.col("doc_id") % 3 == 0
    value = F.concat(F.when(pdf, "%PDF-").otherwise(""), F.coalesce("text", F.lit("")))
    rows = read(spark, d, "documents").select(value.alias("value"), "source", "lang", F.when(pdf, "pdf").otherwise("text").alias("as"))
    rows.write.partitionBy("source", "lang", "as").text(root)
    return root


@query("a1_a5_a17_folder_inventory", FOLDERS + " SELECT grp, sum(size)::BIGINT AS size, 'txt' AS extension, grp LIKE '%/as=pdf' AS known FROM t GROUP BY grp")
def folder_inventory(spark, d):
    """A folder tree of whole texts, listed and inventoried: PDFs by content, the others skipped but counted."""
    files = folders.judged(folders.listing(spark, folder_tree(spark, d), content=True).where(F.col("name").endswith(".txt")))
    known = F.max(F.col("reason").isNull()).alias("known")
    return files.groupBy(F.col("directory").alias("grp")).agg(F.sum("size_bytes").alias("size"), F.max(strings.extension(F.col("name"))).alias("extension"), known)


@query("a1_skipped_files", FOLDERS + """ SELECT '_SUCCESS' AS name, '' AS directory, 'unknown kind' AS reason, 1 AS least UNION ALL SELECT DISTINCT 'part', grp, 'unknown kind', 1 FROM t WHERE grp LIKE '%/as=text'""")
def skipped_files(spark, d):
    """What a walk over the tree passes over, by directory: the writer's own ``_SUCCESS`` and texts of no known kind."""
    _, skipped = folders.records_and_skipped(folders.listing(spark, folder_tree(spark, d), content=True))
    parts = skipped.select(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("directory"), F.regexp_replace(F.substring_index("rel_path", "/", -1), "^part-.*$", "part").alias("name"), "reason")
    return parts.groupBy("name", "directory", "reason").agg(F.least(F.count("*"), F.lit(1)).cast("int").alias("least"))


UNPACKED = """WITH f AS (SELECT doc_id, 'doc' || doc_id || '.zip' AS archive, encode(coalesce(text, '')) AS c FROM documents)
SELECT archive, 0 AS depth, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 + (doc_id % 3 = 0)::INT END AS files, (doc_id % 5 = 0 AND doc_id % 7 <> 0)::INT::BIGINT AS unsafe_entries_skipped, CASE WHEN doc_id % 7 = 0 THEN 'bad' WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'ok' END AS status,
CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(c) END AS text_sha256 FROM f UNION ALL
SELECT archive || '!inner.zip', 1, 1, 0, 'ok', sha256(encode(doc_id::VARCHAR)) FROM f WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0"""


def packed_documents(spark, d):
    """Archives made of the documents: text, an archive in every third, an unsafe path in every fifth, every seventh broken."""

    columns = "rel_path string, content binary"
    schema = archives.arrow_schema(columns)

    def packed(i: int, text: str | None) -> bytes:
        if i % 7 == 0:
            return b"broken"
        out, inner = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            z.writestr("text.txt", (text or "").encode())
            if i % 3 == 0:
                with zipfile.ZipFile(inner, "w") as y:
                    y.writestr("text.txt", str(i))
                z.writestr("inner.zip", inner.getvalue())
            if i % 5 == 0:
                z.writestr("../up.txt", "no")
        return out.getvalue()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return archives.in_batches(((f"doc{i}.zip", packed(i, text)) for i, text in archives.rows_of(batches)), schema)

    return read(spark, d, "documents").select("doc_id", "text").mapInArrow(step, columns)


def with_manifest(members):
    texts = members.where("member = 'text.txt'").select("archive", "depth", F.sha2("content", 256).alias("text_sha256"))
    manifest = archives.extraction_manifest(members).select("archive", "depth", F.col("files").cast("int").alias("files"), "unsafe_entries_skipped", "status")
    return manifest.join(texts, ["archive", "depth"], "left").select("archive", "depth", "files", "unsafe_entries_skipped", "status", "text_sha256")


@query("a6_a8_a9_b6_unpacked_archives", UNPACKED)
def unpacked_archives(spark, d):
    return with_manifest(archives.unpack_all(packed_documents(spark, d)))


@query("a8_m_extracted_by_hook", UNPACKED)
def extracted_by_hook(spark, d):
    """The same through the table function, which a column tells the kind."""
    level, found = packed_documents(spark, d).withColumn("kind", strings.archive_kind(F.col("rel_path"))), None
    for depth in range(2):
        m = materialised(hooks.extracted(level).select(F.col("rel_path").alias("archive"), F.lit(depth).alias("depth"), "member", "status", "size_bytes", "content"))
        found = m if found is None else found.unionByName(m)
        inner = m.where("status = 'ok'").withColumn("kind", strings.container_kind(F.col("member"), F.col("content"))).where("kind is not null")
        level = inner.select(F.concat_ws("!", "archive", "member").alias("rel_path"), "content", "kind")
    return with_manifest(found)


@query("f12_extraction_totals", "WITH u AS (" + UNPACKED + """) SELECT count(*) AS archives, count_if(status = 'ok') AS ok, count_if(status = 'partial') AS partial, count_if(status = 'bad') AS bad,
sum(files)::BIGINT AS files, sum(unsafe_entries_skipped)::BIGINT AS unsafe_entries_skipped, max(depth)::INT AS depth FROM u""")
def extraction_totals(spark, d):
    """Totals over the manifest of all documents' archives and the archives in them."""
    m = archives.extraction_manifest(archives.unpack_all(packed_documents(spark, d)))
    status = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "bad")]
    return m.agg(F.count("*").alias("archives"), *status, F.sum("files").alias("files"), F.sum("unsafe_entries_skipped").alias("unsafe_entries_skipped"), F.max("depth").alias("depth"))


@query("a19_a21_b2_detection_table", CLASSIFIED + """, k AS (SELECT x.page, x.id, x.score, x.x0, c.classification, CASE x.id % 3 WHEN 0 THEN 'signature' WHEN 1 THEN 'stamp' ELSE 'text' END AS cls FROM box x JOIN classified c ON x.page = c.page AND x.id = c.id)
SELECT 'p' || page || '.pdf' AS rel_path, count(*) AS n, round(max(score), 6) AS best, count_if(classification = 'vector_ink') AS ink, round(sum(x0), 4) AS left_sum FROM k WHERE cls IN ('signature', 'stamp') AND score >= 10 GROUP BY page""")
def detection_table(spark, d):
    """Detections written as CSV and read back typed, with the reader's filters on class and score."""
    path = fresh_folder(spark, "detections")
    kind = F.element_at(F.array(F.lit("signature"), F.lit("stamp"), F.lit("text")), (F.col("id") % 3 + 1).cast("int"))
    marks = boxes(spark, d).join(ob.reconcile(boxes(spark, d), objects(spark, d), ["page"]), ["page", "id"])
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(".pdf"))
    table = marks.select(name.alias("rel_path"), name.alias("file_name"), "page", kind.alias("detector_class"), "score", "b.x0", "b.y0", "b.x1", "b.y1", "classification", F.lit("scanned").alias("page_composition"), F.lit(1).alias("_private"))
    sinks.write_csv(table, path, lead=["rel_path", "score"])
    found = fs.detections(spark, path, ["signature", "stamp"], 10.0)
    return found.groupBy("rel_path").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.count_if(F.col("classification") == "vector_ink").alias("ink"), F.round(F.sum("x0"), 4).alias("left_sum"))
