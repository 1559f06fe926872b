"""Helpers shared by the training-data operators: checkpoints and joins that survive hot keys."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot when it holds over one in so many rows, so there are fewer hot keys than this.
HOT_SHARE = 1000
#: Groups of a lookup that are broadcast as a whole at most: a few bytes each, a few thousand where they are wide.
FEW = 4096


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Without one, a local master gets a temporary folder and a cluster an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="parchment-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark removes the shuffle files of a query when it ends; read when the query's DataFrame is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made inside are removed when these end, not when the driver collects its garbage.

    For long rows of checkpoints and counts. A DataFrame made inside may be part of others at any time, but itself
    should run once: a second run would have to write its shuffle files again. Spark before 4.1 ignores it.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those named, in whatever case: results take the place of columns of their names."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, tie: str, few: int = FEW) -> DataFrame:
    """``rows`` left joined to ``groups``, which has one row for each key and in ``count`` its number of rows.

    Up to ``few`` groups are broadcast. Of more, keys over 1/1000 of all counted rows are fewer than 1000, whatever the input: they are broadcast. Their rows
    are then spread over salts by the hash of ``tie`` and of the partition they come from, so the shuffled join of all
    the others has no hot key. Null keys match nothing. ``groups`` is read three times. Columns of ``groups`` that
    ``rows`` has already stay behind.
    """
    hot_, cold_, salt_ = fresh(rows, "_hot", "_cold", "_salt")
    carried = [c for c in groups.columns if c not in keys and c not in rows.columns]
    total, n = groups.agg(F.sum(count), F.count(F.lit(1))).first()
    if n <= few:
        return rows.join(F.broadcast(groups.select(*keys, F.struct(*[groups[c] for c in carried]).alias(hot_))), keys, "left").select(*rows.columns, *[F.col(hot_)[c].alias(c) for c in carried])
    cut = max((total or 0) // HOT_SHARE, 1)
    hot = groups.where(F.col(count) > cut).select(*keys, F.struct(*[groups[c] for c in carried]).alias(hot_))
    # The salt of the others is zero, but not a constant: a constant would leave the keys of the join.
    cold = groups.where(F.col(count) <= cut).select(*keys, F.least(F.lit(0).cast("long"), F.col(count)).alias(salt_), F.struct(*[groups[c] for c in carried]).alias(cold_))
    out = rows.join(F.broadcast(hot), keys, "left")
    blank = F.col(hot_).isNotNull()
    for k in keys:
        blank = blank | F.col(k).isNull()
    out = out.withColumn(salt_, F.when(blank, F.lit(1) + F.pmod(F.xxhash64(tie, F.spark_partition_id()), F.lit(4096))).otherwise(F.lit(0).cast("long")))
    out = out.join(cold, [*keys, salt_], "left")
    picked = F.coalesce(hot_, cold_)
    return out.select(*rows.columns, *[picked[c].alias(c) for c in carried])


def text_key(text: Column) -> Column:
    """What tells texts of one id apart; null and empty are the same."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Marks of rows that are broadcast at most, some 60 bytes each; more meet the rows in a shuffle.
MARKS = 1 << 18


def one_of_each(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group: that of the least id (null is the greatest), of these the least text_key.

    ``members`` has id, key (see text_key) and g for each row of ``docs`` that is in a group; other rows stay. Rows
    are found again by id and key, so another text of the same id is not touched. Rows alike in both are one choice:
    the first of them met stays. The columns of ``docs`` stay as they are.
    """
    per = checkpoint(members.groupBy("g", "id", "key").agg(F.count(F.lit(1)).alias("n")))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    best = checkpoint(per.groupBy("g").agg(F.min(place).alias("best"), F.sum("n").alias("m")))
    judged = lookup(per, best, ["g"], "m", "key").select("id", "key", "n", (place == F.col("best")).alias("stays"))
    name, null, key, stays = fresh(docs, "_one_id", "_one_null", "_one_key", "_one_stays")
    marks = judged.where("n > 1 or not stays").groupBy(F.coalesce(F.col("id").cast("string"), F.lit("")).alias(name), F.col("id").isNull().alias(null), F.col("key").alias(key))
    marks = checkpoint(marks.agg(F.max("stays").alias(stays), F.max("n").alias("n")))
    rows = docs.withColumns({name: F.coalesce(F.col(id_col).cast("string"), F.lit("")), null: F.col(id_col).isNull(), key: text_key(F.col(text_col))})
    found = lookup(rows, marks.withColumnRenamed("n", fresh(rows, "_one_n")[0]), [name, null, key], fresh(rows, "_one_n")[0], key, MARKS)
    left = found.where(F.col(stays).isNull())
    if not marks.where(stays).isEmpty():
        left = left.unionByName(found.where(stays).dropDuplicates([name, null, key]))
    return left.select(*docs.columns)


def _components_here(edges: pa.Table) -> pa.Table:
    """``components`` of edges in memory: larger roots are hung below smaller ones until no edge has two."""
    nodes, at = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    a, b = at[: len(edges)], at[len(edges) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return pa.table({"node": nodes, "root": nodes[root]})


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint) as (node, root), root the least node; isolated nodes are absent.

    Alternates large-star and small-star rounds until the edges stand still; each round is cut by a checkpoint.
    Hubs are joined through ``lookup``. Up to ``few`` edges (16 bytes each) are brought to the driver and joined there,
    which spares some dozens of stages; ``edges`` is read twice then and should be a checkpoint.
    """
    if few and edges.count() <= few:
        proper = edges.where(F.col("a") != F.col("b")).select("a", "b")
        return edges.sparkSession.createDataFrame(_components_here(proper.toArrow()), "node bigint, root bigint")

    def star(directed: DataFrame, larger_only: bool) -> DataFrame:
        least = directed.groupBy("a").agg(F.min("b").alias("lo"), F.count(F.lit(1)).alias("n")).withColumn("lo", F.least("lo", "a"))
        found = lookup(directed, least, ["a"], "n", "b")
        if larger_only:
            return found.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("lo").alias("b"))
        return found.select(F.col("b").alias("a"), F.col("lo").alias("b")).unionByName(least.select("a", F.col("lo").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return checkpoint(e.where(F.col("a") != F.col("b")).distinct())

    e = tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = tidy(star(tidy(star(both, True)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False))
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).distinct()
