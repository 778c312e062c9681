"""Sheets of the result workbooks as DataFrames with their published column names (fixed values).

A sheet is a plain table: ``inkwell.sources.sinks.write_workbook`` writes a dictionary of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.strings import mark_id
from inkwell.functions.verdicts import confidence_level, relationship_strength

MISSING = "N/A"


def fixed(c: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", c)


def metrics(totals: DataFrame, rows: list[tuple[str, Column]]) -> DataFrame:
    """(Metric, Value) rows from one row of totals, in the order given."""
    parts = [F.struct(F.lit(name).alias("Metric"), value.cast("string").alias("Value")) for name, value in rows]
    return totals.select(F.explode(F.array(*parts)).alias("m")).select("m.*")


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def by_document(pairs: DataFrame, methods: list[str], high: float) -> DataFrame:
    """(pdf, n, combined_high, mean and high of each method) of pairs (pdf, methods, combined)."""
    return pairs.groupBy("pdf").agg(
        F.count("*").alias("n"), F.count_if(F.col("combined") >= high).alias("combined_high"),
        *(F.avg(m).alias(f"{m}_mean") for m in methods), *(F.count_if(F.col(m) >= high).alias(f"{m}_high") for m in methods),
    )


def best_method(methods: list[str]) -> Column:
    """struct(neg, method): the method of the highest mean, the first in name order where they tie."""
    return F.array_min(F.array(*(F.struct((-F.col(f"{m}_mean")).alias("neg"), F.lit(m).alias("method")) for m in methods)))


def file_summary(documents: DataFrame, pairs: DataFrame, errors: DataFrame, methods: list[str], high: float = 0.8) -> DataFrame:
    """File_Summary: a row for each document (pdf, pages, marks) and for each failed file (pdf, error)."""
    s = documents.join(by_document(pairs, methods, high), "pdf", "left").withColumn("best", best_method(methods))
    text = lambda c: F.col(c).cast("string")
    counted = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    good = s.select(
        text("pdf").alias("PDF_Name"), text("pages").alias("Total_Pages"), text("marks").alias("Signatures_Detected"), counted("n").alias("Total_Comparisons"),
        *(fixed(F.coalesce(F.col(f"{m}_mean"), F.lit(0.0))).alias(f"Avg_{m}_Similarity") for m in methods), *(counted(f"{m}_high").alias(f"High_Sim_{m}_80%") for m in methods),
        counted("combined_high").alias("High_Sim_Combined_80%"), F.when(F.col("n") > 0, F.col("best.method")).otherwise("None").alias("Best_Method_by_Avg"),
        fixed(F.coalesce(-F.col("best.neg"), F.lit(0.0))).alias("Best_Avg_Similarity"), F.lit("Success").alias("Processing_Status"), F.lit(None).cast("string").alias("Error_Message"),
    )
    named = {"PDF_Name": text("pdf"), "Processing_Status": F.lit("Error"), "Error_Message": F.col("error")}
    return good.unionByName(errors.select(*(named.get(c, F.lit(MISSING)).alias(c) for c in good.columns)))


def overall_summary(documents: DataFrame, pairs: DataFrame, methods: list[str], high: float = 0.8) -> DataFrame:
    """Overall_Summary: totals, and means over all pairs of all documents."""
    n = documents.agg(F.count("*").alias("pdfs"), F.sum("marks").alias("marks"))
    p = pairs.agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in methods), *(F.count_if(F.col(m) >= high).alias(f"{m}_high") for m in methods))
    return metrics(n.join(F.broadcast(p)), [
        ("Total PDFs Processed", F.col("pdfs")), ("Total Signatures Detected", F.col("marks")), ("Total Similarity Comparisons", F.col("n")),
        *((f"Average {m} Similarity (All Files)", fixed(F.coalesce(F.col(m), F.lit(0.0)))) for m in methods), *((f"High Similarity Pairs {m} (80%+)", F.col(f"{m}_high")) for m in methods),
    ])


def detailed_comparisons(pairs: DataFrame, methods: list[str]) -> DataFrame:
    """Detailed_Comparisons: a row for each pair (pdf, sig_a, sig_b, page_a, page_b, methods, combined)."""
    c = F.col("combined")
    return pairs.select(
        F.col("pdf").alias("PDF_Name"), F.col("sig_a").alias("Signature1_ID"), F.col("sig_b").alias("Signature2_ID"), F.col("page_a").alias("Signature1_Page"), F.col("page_b").alias("Signature2_Page"),
        *(F.coalesce(fixed(F.col(m)), F.lit(MISSING)).alias(f"{m}_Similarity") for m in methods), fixed(c).alias("Combined_Similarity"),
        yes_no(c >= 0.8).alias("High_Similarity_80%"), yes_no(c >= 0.9).alias("Very_High_Similarity_90%"),
    )


def document_summary(documents: DataFrame, pairs: DataFrame, methods: list[str], high: float = 0.8) -> DataFrame:
    """PDF_Summary_Legacy."""
    s = documents.join(by_document(pairs, methods, high), "pdf", "left").withColumn("best", best_method(methods))
    return s.select(
        F.col("pdf").alias("PDF_Name"), F.col("pages").alias("Total_Pages"), F.col("marks").alias("Signatures_Detected"), F.coalesce("n", F.lit(0)).alias("Similarity_Comparisons"),
        F.coalesce("combined_high", F.lit(0)).alias("Combined_High_Similarity_Pairs_80%"), F.when(F.col("n") > 0, F.col("best.method")).otherwise("None").alias("Best_Method"),
    )


def signer_identification(profiles: DataFrame) -> DataFrame:
    """Signer_Identification of profiles (signer, n_signatures, n_documents, documents, representative, confidence)."""
    return profiles.select(
        F.col("signer").alias("Signer_ID"), F.col("n_signatures").alias("Signature_Count"), F.col("n_documents").alias("Documents_Signed"), F.replace(F.col("documents"), F.lit(","), F.lit(", ")).alias("Document_List"),
        F.col("representative").alias("Representative_Signature"), fixed(F.col("confidence"), 3).alias("Confidence_Score"), confidence_level(F.col("confidence")).alias("Confidence_Level"),
    )


def signer_mapping(assignments: DataFrame) -> DataFrame:
    """Signature_Signer_Mapping of (sig_id, pdf, page, signer, within)."""
    unknown = lambda c: F.coalesce(F.col(c), F.lit("Unknown"))
    return assignments.select(
        F.col("sig_id").alias("Signature_ID"), F.col("pdf").alias("PDF_Name"), F.col("page").alias("Page_Number"), unknown("signer").alias("Signer_ID"), unknown("within").alias("Within_PDF_Cluster"),
    )


def cross_documents(shared: DataFrame) -> DataFrame:
    """Cross_Document_Analysis of (pdf_a, pdf_b, common, signers)."""
    return shared.select(
        F.concat_ws(" - ", F.col("pdf_a").cast("string"), F.col("pdf_b").cast("string")).alias("Document_Pair"), F.col("common").alias("Common_Signers"),
        F.replace(F.col("signers"), F.lit(","), F.lit(", ")).alias("Shared_Signer_IDs"), relationship_strength(F.col("common")).alias("Relationship_Strength"),
    )


def clustering_summary(profiles: DataFrame) -> DataFrame:
    """Clustering_Summary: one row."""
    n = F.col("n_signatures")
    return profiles.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("Total_Signatures_Processed"), F.count("*").alias("Unique_Signers_Identified"), (F.coalesce(F.sum(n), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("Average_Signatures_Per_Signer"),
        F.count_if(F.col("confidence") > 0.8).alias("High_Confidence_Signers"), F.count_if(n == 1).alias("Single_Signature_Signers"), F.count_if(F.col("n_documents") > 1).alias("Multi_Document_Signers"),
    )


def mark_similarities(matches: DataFrame) -> DataFrame:
    """Signature_Similarity_Analysis of (sig_id, pdf, page, signer, similarity)."""
    s = F.col("similarity")
    return matches.select(
        F.col("pdf").alias("PDF_Name"), F.col("sig_id").alias("Signature_ID"), F.col("page").alias("Page_Number"), F.coalesce(F.col("signer").cast("string"), F.lit("No Match")).alias("Matched_Signer"),
        F.round(s, 6).alias("Similarity_Score"), F.format_string("%.1f%%", s * 100).alias("Similarity_Percentage"), confidence_level(s).alias("Confidence_Level"),
    )


def signer_similarities(stats: DataFrame) -> DataFrame:
    """Signer_Similarity_Summary of (pdf, signer, n, mean, top, low) where something matched."""
    m = F.col("mean")
    return stats.where("n > 0").select(
        F.col("pdf").alias("PDF_Name"), F.col("signer").alias("Signer_ID"), F.col("n").alias("Match_Count"), F.round(m, 6).alias("Avg_Similarity"), F.format_string("%.1f%%", m * 100).alias("Avg_Similarity_Percentage"),
        F.round("top", 6).alias("Max_Similarity"), F.round("low", 6).alias("Min_Similarity"), confidence_level(m).alias("Confidence_Level"),
    )


def cross_reference(stats: DataFrame, totals: DataFrame, signers: list) -> DataFrame:
    """Cross_Reference_Analysis: count, presence and similarity of each signer; totals are (pdf, marks)."""
    wide = stats.groupBy("pdf").pivot("signer", signers).agg(F.first("n").alias("n"), F.first("mean").alias("m"))
    found = [F.when(F.col(f"{s}_n") > 0, F.lit(str(s))) for s in signers]
    columns = [c for s in signers for c in (
        F.col(f"{s}_n").alias(f"{s}_Count"), yes_no(F.col(f"{s}_n") > 0).alias(f"{s}_Present"), F.when(F.col(f"{s}_n") > 0, F.format_string("%.1f%%", F.col(f"{s}_m") * 100)).otherwise("0.0%").alias(f"{s}_Similarity%"),
    )]
    number = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in found), F.lit(0))
    return wide.join(totals, "pdf").select(
        F.col("pdf").alias("PDF_Name"), F.col("marks").alias("Total_Signatures"), *columns, number.alias("Reference_Signers_Found"),
        F.when(number > 0, F.concat_ws(";", *found)).otherwise("None").alias("Signer_Details"), F.lit("success").alias("Status"),
    )


def per_document(counts: DataFrame) -> DataFrame:
    """Per document: counts (page, crypto_signed, crypto_empty, pasted_image, vector_ink, scanned_wet_ink, unmatched, total_digital, total_detected)."""
    return counts.select(
        F.col("page").alias("Document"), (F.col("total_digital") + F.col("scanned_wet_ink")).alias("TOTAL signs"), F.col("total_digital").alias("TOTAL digital signs"), F.col("scanned_wet_ink").alias("TOTAL scanned signs"),
        F.col("crypto_signed").alias("  crypto sig fields"), F.col("crypto_empty").alias("Empty sig fields (unsigned)"), F.col("pasted_image").alias("  pasted images"), F.col("vector_ink").alias("  vector ink"),
        F.col("unmatched").alias("Unmatched"), F.col("total_detected").alias("Total detected"),
    )


def detection_summary(counts: DataFrame) -> DataFrame:
    """Summary of the detection workbook."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    t = counts.agg(F.count("*").alias("n"), *map(total, ("total_digital", "scanned_wet_ink", "crypto_signed", "crypto_empty", "pasted_image", "vector_ink", "unmatched")), F.count_if((F.col("total_digital") > 0) | (F.col("scanned_wet_ink") > 0)).alias("any"))
    return metrics(t, [
        ("Documents", F.col("n")), ("TOTAL signatures", F.col("total_digital") + F.col("scanned_wet_ink")), ("DIGITAL signatures", F.col("total_digital")), ("  crypto signature fields (signed)", F.col("crypto_signed")),
        ("  pasted images", F.col("pasted_image")), ("  vector ink annotations", F.col("vector_ink")), ("SCANNED signatures (wet ink)", F.col("scanned_wet_ink")), ("Unmatched detections", F.col("unmatched")),
        ("Empty signature fields (unsigned, NOT counted)", F.col("crypto_empty")), ("Documents with any signature", F.col("any")),
    ])


def file_counts(files: DataFrame, human) -> dict[str, DataFrame]:
    """Summary, By extension and By directory of files (directory, extension, size)."""
    from inkwell.functions.strings import IMAGES

    pdf, image = F.col("extension") == "pdf", F.col("extension").isin(*IMAGES)
    named = F.when(F.col("extension") == "", "(none)").otherwise(F.concat(F.lit("."), "extension"))
    size = F.sum("size")
    totals = files.agg(F.count("*").alias("n"), F.countDistinct("directory").alias("dirs"), size.alias("size"), F.count_if(pdf).alias("pdfs"), F.count_if(image).alias("images"), F.countDistinct("extension").alias("exts"))
    summary = metrics(totals, [
        ("Files", F.col("n")), ("Directories with files", F.col("dirs")), ("Total size (bytes)", F.col("size")), ("Total size", human(F.col("size"))), ("PDFs", F.col("pdfs")), ("Images", F.col("images")),
        ("Other", F.col("n") - F.col("pdfs") - F.col("images")), ("Distinct extensions", F.col("exts")),
    ])
    by_ext = files.groupBy(named.alias("Extension")).agg(F.count("*").alias("Files"), size.alias("Size (bytes)"))
    by_dir = files.groupBy(F.col("directory").alias("Directory")).agg(F.count("*").alias("Files"), F.count_if(pdf).alias("PDFs"), F.count_if(image).alias("Images"), size.alias("Size (bytes)"))
    sized = lambda df: df.withColumn("Size", human(F.col("Size (bytes)")))
    return {"Summary": summary, "By extension": sized(by_ext), "By directory": sized(by_dir)}


def mark_metadata(marks: DataFrame) -> DataFrame:
    """Signature_Metadata of (sig_id, pdf, page, number, score, b): a mark's id, place, box and file."""
    name = F.concat(F.col("pdf").cast("string"), F.lit(".pdf"))
    ident = mark_id(F.col("pdf").cast("string"), F.col("page"), F.col("number"))
    return marks.select(
        ident.alias("unique_id"), name.alias("pdf_name"), F.col("page").alias("page_number"), F.col("number").alias("signature_index"), F.round("score", 4).alias("confidence_score"),
        F.to_json(F.array(*(F.col("b")[c] for c in ("x0", "y0", "x1", "y1")))).alias("bounding_box"), F.concat(F.lit("signatures/"), ident, F.lit(".png")).alias("signature_path"),
    )


def similarity_analysis_legacy(pairs: DataFrame, methods: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Similarity_Analysis_Legacy of compared pairs: scores as they are, "N/A" for an optional method without one, and three thresholds."""
    scores = [F.coalesce(F.round(m, 6).cast("string"), F.lit("N/A")).alias(f"{m}_similarity") if m in optional else F.round(m, 6).alias(f"{m}_similarity") for m in methods]
    over = [(F.col("combined") >= t / 100).alias(f"similarity_threshold_{t}") for t in (70, 80, 90)]
    return pairs.select(
        F.col("pdf").alias("pdf_name"), F.col("sig_a").alias("signature1_id"), F.col("sig_b").alias("signature2_id"), F.col("page_a").alias("signature1_page"), F.col("page_b").alias("signature2_page"),
        *scores, F.round("combined", 6).alias("combined_similarity"), *over,
    )


def error_analysis(failed: DataFrame) -> DataFrame:
    """Error_Analysis of (pdf, error)."""
    return failed.select(F.col("pdf").cast("string").alias("pdf_path"), "error")


def detailed_analysis(stats: DataFrame) -> DataFrame:
    """Detailed_Analysis of (pdf, signer, n): a row for every target and reference signer."""
    return stats.select(F.col("pdf").alias("PDF_Name"), F.col("signer").alias("Reference_Signer"), F.col("n").alias("Signature_Count"), yes_no(F.col("n") > 0).alias("Present"))
