"""Exact dedup by progressive refinement: length, then prefix hash, then the full hash of what survives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lookup, one_of_each, squeezed, text_key

#: Code points of the prefix that is hashed before any full text is.
PREFIX = 256
#: So many keys of surviving groups are broadcast at most (12 bytes each); more meet their texts in a shuffle.
FEW = 1 << 20


def _signed(docs: DataFrame, id_col: str, text_col: str, prefix: int, few: int, digest_all: bool) -> DataFrame:
    """id, key, hit, digest of each row: two passes. The first groups by length and hash of the prefix; the second
    reads whole texts again and hashes those whose length and prefix are not alone."""
    text = squeezed(F.col(text_col))
    shape = [F.length(text).alias("len"), F.xxhash64(F.substring(text, 1, prefix)).alias("pre")]
    survive = checkpoint(docs.select(*shape).groupBy("len", "pre").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), *shape, text.alias("t"))
    if survive.count() <= few:
        rows = rows.join(F.broadcast(survive), ["len", "pre"], "left")
    else:
        rows = lookup(rows, survive, ["len", "pre"], "n", "key")
    hit = F.col("n").isNotNull()
    digest = F.unhex(F.sha2(F.encode(F.col("t"), "UTF-8"), 256))
    return checkpoint(rows.select("id", "key", hit.alias("hit"), (digest if digest_all else F.when(hit, digest)).alias("digest")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, few: int = FEW, digest_all: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, digest (SHA-256, lowercase hex).

    Null and empty texts are one group. A null id is the greatest of all and is kept only in a group of null ids.
    Rows alike in id and text cannot be told apart by these columns: all of them are marked kept or none;
    ``drop_copies`` leaves one. Rows of one id with different texts are judged each by its text. ``digest`` is null
    where no other row had the length and prefix of a text, unless ``digest_all``. Long texts are hashed whole. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    rows = _signed(docs, id_col, text_col, prefix, few, digest_all)
    groups = checkpoint(rows.where("hit").groupBy("digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    found = lookup(rows.where("hit"), groups, ["digest"], "n", "id").unionByName(rows.where("not hit").withColumn("keep", F.lit(None).cast(docs.schema[id_col].dataType)).withColumn("n", F.lit(None).cast("long")))
    size = F.coalesce("n", F.lit(1)).cast("long")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("digest")).alias("digest"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay as they are.

    Of a group the least id stays, null being the greatest; of rows alike in id and text one stays. Null and empty
    texts are one group. Another text under an id that goes is not touched. An empty table gives no rows.
    """
    rows = _signed(docs, id_col, text_col, PREFIX, FEW, False)
    return one_of_each(docs, rows.where("hit").select("id", "key", F.col("digest").alias("g")), id_col, text_col)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract asks for every text's digest, so here all texts are hashed and the passes only find the groups."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, digest_all=True).withColumnRenamed("digest", "text_sha256")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY x)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""
