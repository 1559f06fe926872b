"""Provenance: page records rolled up to documents, and pages merged from two engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import strip

SEVERITY = {"clean": 0, "partially_recovered": 1, "corrupt_unrecoverable": 2}


def rollup(pages: DataFrame, key: str, demote: bool = True) -> DataFrame:
    """Key, overall_status, used_ocr, failed_ocr_pages from key, index, status, engine, ocr_error."""
    status, ocr = F.col("status"), F.col("engine") == "ocr"
    a = pages.groupBy(key).agg(
        F.bool_or(status == "corrupt_unrecoverable").alias("bad"), F.bool_or(status != "corrupt_unrecoverable").alias("good"), F.bool_or(status == "recovered").alias("mended"), F.bool_or(ocr).alias("used_ocr"),
        F.bool_and((status == "clean") | ((status == "recovered") & ocr)).alias("by_ocr"), F.sort_array(F.collect_list(F.when(F.coalesce("ocr_error", F.lit("")) != "", F.col("index")))).alias("failed_ocr_pages"),
    )
    overall = F.when(F.col("bad"), F.when(F.col("good"), "partially_recovered").otherwise("corrupt_unrecoverable")).when(F.col("mended") & ~(F.lit(demote) & F.col("by_ocr")), "partially_recovered").otherwise("clean")
    return a.select(key, overall.alias("overall_status"), "used_ocr", "failed_ocr_pages")


def severity(status: Column) -> Column:
    return F.when(status == "corrupt_unrecoverable", 2).when(status == "partially_recovered", 1).otherwise(0)


def worst(reports: DataFrame, key: str) -> DataFrame:
    """R5."""
    n = F.max(severity(F.col("overall_status")))
    return reports.groupBy(key).agg(n.alias("n")).select(key, F.when(F.col("n") == 2, "corrupt_unrecoverable").when(F.col("n") == 1, "partially_recovered").otherwise("clean").alias("overall_status"))


def mark_failures(pages: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """Pages whose OCR failed are corrupt, without engine, with the reason; other failures change nothing."""
    f = failures.select(*keys, F.col("reason").alias("_reason"))
    bad = F.col("_reason").isNotNull()
    return pages.join(f, keys, "left").withColumns({"status": F.when(bad, "corrupt_unrecoverable").otherwise(F.col("status")), "engine": F.when(bad, "").otherwise(F.col("engine")), "ocr_error": F.coalesce("_reason", "ocr_error")}).drop("_reason")


def merge_pages(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The first engine's page unless it is blank; ``blank`` where both are."""
    a, b = first.select(*keys, F.col("text").alias("_a")), second.select(*keys, F.col("text").alias("_b"))
    full = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) != ""
    return a.join(b, keys, "full_outer").select(*keys, F.when(full("_a"), F.col("_a")).otherwise(F.coalesce("_b", "_a", F.lit(""))).alias("text"), (~full("_a") & ~full("_b")).alias("blank"))


def needs_ocr(pages: DataFrame, key: str) -> DataFrame:
    """P11."""
    return pages.groupBy(key).agg((~F.bool_or(strip(F.coalesce("text", F.lit(""))) != "")).alias("needs_ocr"))
