"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, lookup, without

#: Without given weights a source weighs its rows to this power.
TEMPERATURE = 0.5
SEED = "mix-1"
#: A mean over this is split into equal parts whose draws are added, which is again Poisson.
PART = 32.0
#: Rows that a task of the global shuffle has to sort, about.
ROWS_PER_TASK = 20_000


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cumulative distribution of each mean up to where doubles no longer tell it from one."""
    for pdf in frames:
        tables = []
        for mean in pdf.part_mean:
            total, k, table = 0.0, 0, []
            while mean > 0 and (k <= mean or total < 1 - 1e-15) and k < mean + 40 * math.sqrt(mean) + 60:
                total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
                table.append(min(total, 1.0))
                k += 1
            tables.append(table)
        yield pdf.assign(cdf=tables)


def uniform(*parts) -> F.Column:
    """A double in (0, 1) from a keyed hash: 52 bits of MD5, at the middle of their cell."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, temperature: float, size: float | None) -> DataFrame:
    """src, n, mean: how often each row of a source should be there. Sources without a weight get none."""
    counts = docs.groupBy(F.col(source_col).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map()
        weighed = counts.withColumn("w", F.coalesce(F.try_element_at(given.cast("map<string,double>"), F.col("src").cast("string")), F.lit(0.0)))
    sums = weighed.agg(F.sum("w"), F.sum("n")).first()
    w, n = sums[0] or 1.0, size if size is not None else float(sums[1] or 0)
    return weighed.select("src", "n", (F.lit(n) * F.col("w") / F.lit(w) / F.col("n")).alias("mean"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, size: float | None = None, seed: str = SEED, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, so that sources meet their weights on average.

    Adds copy_no (from 0), n_copies and mix_key, by which a row's place in the global shuffle is decided: rows are
    dealt to partitions by its leading bits and sorted by it inside; columns of these names are replaced. There are as
    many partitions as ``rows_per_task`` asks for, and no fewer than the session's shuffle partitions. The mean of a
    source is size x weight / rows of the source; size is the number of rows without another wish. The draw depends on
    the seed and the id alone: a rerun, and a repeated row, draws the same. A null source is a source of its own
    (weight zero among given weights); null ids draw as one id. Texts are not looked at. A table without rows gives none.
    """
    docs = docs.select(*without(docs, "copy_no", "n_copies", "mix_key"))
    mean = rates(docs, source_col, weights, temperature, size)
    src_, null_, n_, parts_, cdf_ = fresh(docs, "_mix_src", "_mix_null", "_mix_n", "_mix_parts", "_mix_cdf")
    parts = F.greatest(F.ceil(F.col("mean") / PART), F.lit(1)).cast("int")
    mean = mean.withColumn("parts", parts).withColumn("part_mean", F.col("mean") / F.col("parts"))
    tables = checkpoint(mean.mapInPandas(_tables, "src string, n bigint, mean double, parts int, part_mean double, cdf array<double>"))
    total = tables.agg(F.sum(F.col("n") * F.col("mean"))).first()[0] or 0
    tables = tables.select(F.coalesce("src", F.lit("")).alias(src_), F.col("src").isNull().alias(null_), F.col("n").alias(n_), F.col("parts").alias(parts_), F.col("cdf").alias(cdf_))
    src = F.col(source_col).cast("string")
    rows = docs.withColumn(src_, F.coalesce(src, F.lit(""))).withColumn(null_, src.isNull())
    rows = lookup(rows, tables, [src_, null_], n_, id_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(0), F.col(parts_) - 1), lambda j: F.size(F.filter(cdf_, lambda c: c < uniform(F.lit(seed), key, j.cast("string")))))
    rows = rows.withColumn("n_copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x))
    rows = rows.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    rows = rows.withColumn("mix_key", F.xxhash64(F.lit(seed), key, "copy_no")).drop(src_, null_, n_, parts_, cdf_)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / rows_per_task))
    return rows.repartition(n, F.shiftright("mix_key", 44)).sortWithinPartitions("mix_key")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).drop("mix_key")


OP4_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
m AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE * pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM c) / n AS mean FROM c),
p AS (SELECT source, mean / greatest(ceil(mean / 32.0), 1) AS pm, greatest(ceil(mean / 32.0), 1)::INT AS parts FROM m),
k AS (SELECT source, parts, k, sum(exp(-pm + k * ln(pm) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM p, (SELECT unnest(range(0, 200))::DOUBLE AS k)),
t AS (SELECT source, parts, list(cdf ORDER BY k) AS cdf FROM k GROUP BY source, parts),
u AS (SELECT d.doc_id, d.source, d.text, t.cdf, unnest(range(0, t.parts)) AS j FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT doc_id, source, text, sum(len(list_filter(cdf, lambda c: c < ((('0x' || substr(md5('mix-1|' || doc_id || '|' || j), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)))::INT AS n_copies
      FROM u GROUP BY doc_id, source, text)
SELECT doc_id, source, text, n_copies, unnest(range(0, n_copies))::INT AS copy_no FROM n WHERE n_copies > 0
"""
