"""All trusted documents count, also above 10 000."""

from pyspark.sql import functions as F

from parchment.llm import quality_rules


def test_every_trusted_document_counts(spark):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("text"))
    ratios = quality_rules.log_ratios(docs, docs.select(F.col("doc_id").alias("id")))
    raw, pad, n = 6000.5 / (12_000 + 0.5 * quality_rules.CELLS), 240, 12_000
    import math

    want = math.log((6000 + pad * raw) / (n + pad) / raw)
    assert sum(abs(r - want) < 1e-12 for r in ratios) == 2
