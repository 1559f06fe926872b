"""Quality rules: base statistics, and the log-likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, lookup, without

#: Hash cells of the two multinomials; the table of ratios has as many doubles, whatever the input.
CELLS = 1 << 14
#: Mean log ratio per n-gram from which a document stays.
THRESHOLD = 0.0
WINDOW = 5
#: Trusted ids that are broadcast at most (some 16 bytes each); more meet the texts in a shuffle.
FEW_TRUSTED = 1 << 20
#: Lower-case ASCII first and without backtracking: the same tokens, found faster.
_TOKEN = r"[a-z0-9_\p{L}\p{N}]++|[^\p{L}\p{N}_\x20\x09-\x0D]++"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in windows of ``width`` words that occur twice or more; the first occurrence counts too."""
    starts = F.when(F.size(words) < width, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(words) - (width - 1)))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))

        def alike(s: Column) -> Column:
            pairs = F.zip_with(s, F.concat(nothing, s), lambda x, before: F.struct(x.alias("x"), (x["h"] == before["h"]).alias("b")))
            marked = F.zip_with(pairs, F.concat(F.slice(s, 2, F.size(s)), nothing), lambda p, after: F.when(F.coalesce(p["b"], F.lit(False)) | F.coalesce(p["x"]["h"] == after["h"], F.lit(False)), p["x"]["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        def spread(at: Column) -> Column:
            gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.when(b.isNull(), width).otherwise(F.least(F.lit(width), b - a)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(_let(placed, alike), spread))

    # Each word is hashed once, and windows as runs of these hashes.
    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, width))))
    return _let(hashes, covered).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    out = docs.withColumn("_q_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": F.when(text.rlike(r"[#*$%&|<>]"), F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).otherwise(0).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_q_words")),
    }).drop("_q_words")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def cells(text: Column, n: int = CELLS) -> Column:
    """Hash cells of the words, marks and neighbouring pairs of a text, lower-cased."""
    hashes = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), 0), lambda t: F.xxhash64(t))

    def all_of(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(n)).cast("int")))
        return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(n)).cast("int")), F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0))))

    return _let(hashes, all_of)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = CELLS) -> list[float]:
    """Log of trusted over raw probability by cell. Every id of ``trusted`` counts.

    The trusted multinomial is smoothed towards the raw one, so a cell that trusted text never shows is judged by how
    often chance would have shown it. Without trusted text all ratios are zero.
    """
    chosen = trusted.where("id is not null").groupBy("id").agg(F.lit(1).alias("_q_trusted"), F.count(F.lit(1)).alias("_q_rows"))
    marked = lookup(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chosen, ["id"], "_q_rows", "text", FEW_TRUSTED)
    rows = marked.select("_q_trusted", F.explode(cells(F.col("text"), n)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.count("_q_trusted").alias("good")).collect()
    raw, good = [0] * n, [0] * n
    for cell, r, g in rows:
        raw[cell], good[cell] = r, g
    n_raw, n_good = sum(raw), sum(good)
    if not n_good:
        return [0.0] * n
    weight = 0.02 * n_good
    return [math.log(((g + weight * (r + 0.5) / (n_raw + 0.5 * n)) / (n_good + weight)) / ((r + 0.5) / (n_raw + 0.5 * n))) for r, g in zip(raw, good, strict=True)]


def with_ratio(docs: DataFrame, ratios: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with log_ratio, the mean over the n-grams of a text; null where it has none."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    mean = _let(cells(F.col(text_col), len(ratios)), lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.size(c)))
    return docs.withColumn("log_ratio", mean)


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = CELLS) -> DataFrame:
    """``docs`` with the base statistics, log_ratio and kept: no base rule failed and log_ratio is ``threshold`` or more.

    A text without any n-gram is not kept. Every document is judged, by its own text and corpus-wide counts alone;
    null and empty texts have no words and are not kept, long texts are read whole. Copies count as often as they
    stand, in the counts too. Columns with names of results are replaced, all others stay. An empty table gives no rows.
    """
    docs = docs.select(*without(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"))
    ratios = log_ratios(docs, trusted, id_col, text_col, n)
    out = with_ratio(with_statistics(docs, text_col), ratios, text_col)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ratio") >= threshold, F.lit(False)))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").alias("id"))
    return judge(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")
