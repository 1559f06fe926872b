"""Entry points over folders, uploads and structured files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import tables as M
from parchment.functions import text as T
from parchment.operators.archive import Limits, route

from . import decode as D

MAX_FILE = 100 << 20


def read_files(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """Path, rel, content of all files not over the size limit, which the scan itself applies."""
    root = folder.rstrip("/") + "/"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= max_bytes)
    return df.select("path", F.element_at(F.split("path", "(?<=^|/)" + "\\Q" + root.lstrip("/") + "\\E", 2), -1).alias("rel"), "content")


def folder_texts(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """rel, tagged text of every file that has any, in walk order."""
    files = read_files(spark, folder, max_bytes)
    got = D.decode(files, "rel").where(T.has_meaning(F.col("text")))
    return got.select("path", T.tagged(F.col("path"), F.col("text")).alias("tagged")).orderBy(T.walk_key(F.col("path")))


def upload_texts(uploads: DataFrame, limits: Limits | None = None, max_bytes: int = MAX_FILE) -> DataFrame:
    """One row for each upload: filename, text, skipped. Rows are (filename, content).

    One pass opens an upload, decodes its members and keeps both in its row, so uploads of one name stay apart and nothing is shuffled.
    """
    limits, decoders = limits or Limits(), dict(D.DECODERS)
    member = pa.struct([("path", pa.string()), ("member_no", pa.int32()), ("text", pa.string())])
    schema = pa.schema([("filename", pa.string()), ("members", pa.list_(member)), ("gone", pa.list_(pa.string())), ("too_large", pa.bool_())])

    def opened(name: str, data: bytes | None) -> tuple:
        if data is not None and len(data) > max_bytes:
            return name, [], [], True
        texts, gone = [], []
        for i, (path, body, why) in enumerate(route(name, data, limits) if data else ()):
            if why is None:
                texts.append({"path": path, "member_no": i, "text": D._decode(path, body, decoders)[0]})
            else:
                gone.append(f"{path}: {why}")
        return name, texts, gone, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return D.in_batches((opened(n, c) for batch in batches for n, c in D.by_one(batch)), schema, lambda r: sum(len(m["text"]) for m in r[1]))

    kinds = "filename string, members array<struct<path:string,member_no:int,text:string>>, gone array<string>, too_large boolean"
    read = uploads.select(T.safe_filename(F.col("filename")).alias("filename"), "content").mapInArrow(run, kinds)
    full = F.filter("members", lambda m: T.has_meaning(m["text"]))
    ordered = F.sort_array(F.transform(full, lambda m: F.struct(T.walk_key(m["path"]).alias("w"), m["member_no"].alias("n"), T.tagged(m["path"], m["text"]).alias("t"))))
    skipped = F.when(F.col("too_large"), F.array(F.lit("file too large"))).otherwise(F.sort_array("gone"))
    return read.select("filename", F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"), skipped.alias("skipped"))


def table_blocks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Path, source, index, sheet, rows, quality, prose; only tables that are meaningful keep their rows."""
    raw = D.matrices(files, path, content)
    out = raw
    for step in (M.drop_empty, M.collapse_header, M.merge_continuations, M.prepare, M.drop_empty):
        out = out.withColumn("rows", step(F.col("rows")))
    out = out.withColumn("quality", M.score(F.col("rows")))
    good = F.coalesce(F.col("quality.meaningful"), F.lit(False))
    return out.withColumn("rows", F.when(good, F.col("rows")))


def structured(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Path, n_tables, ok_for_items, has_usable_tables, full_md for each file."""
    blocks = table_blocks(files, path, content)
    piece = F.when(F.col("rows").isNotNull(), F.concat(M.comment(F.col("source"), F.lit(None), F.col("index"), F.col("sheet")), F.lit("\n"), M.html(F.col("rows"))))
    has = F.col("rows").isNotNull()
    a = blocks.groupBy("path").agg(
        F.count_if(has).alias("n_tables"), F.coalesce(F.bool_or(has & F.col("quality.ok_for_items")), F.lit(False)).alias("ok_for_items"), F.coalesce(F.bool_or(has & (F.col("quality.has_usable_tables") | F.col("quality.ok_for_items"))), F.lit(False)).alias("has_usable_tables"),
        F.max("prose").alias("prose"), F.transform(F.array_sort(F.collect_list(F.when(has, F.struct("index", piece.alias("html"))))), lambda x: x["html"]).alias("blocks"),
    )
    body = F.array_join(F.concat(F.filter(F.array(T.strip(F.coalesce("prose", F.lit("")))), lambda x: x != ""), F.col("blocks")), "\n\n")
    return a.select("path", "n_tables", "ok_for_items", "has_usable_tables", F.when(body != "", F.concat(body, F.lit("\n"))).otherwise("").alias("full_md"))


def capabilities() -> dict[str, bool]:
    """Which suffixes can be decoded."""
    return {k: v is not D.refused for k, v in D.DECODERS.items()}
