"""Hooks for an OCR engine: retries, recognition over page rows, and tables from an engine's blocks."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.tables import drop_empty
from parchment.functions.text import strip


class Transient(Exception):
    """The engine is busy; another try may work."""


class Rejected(Exception):
    """The engine refuses this page; its code is the reason."""


def until_deadline(call: Callable, wait_s: float, base: float = 0.5, cap: float = 8.0, on: type[Exception] = Transient, sleep=time.sleep, clock=time.monotonic, rng=random.random):
    """Try again on ``on`` with full jitter, and never sleep past the deadline."""
    end, n = clock() + wait_s, 0
    while True:
        try:
            return call()
        except on:
            pause = rng() * min(cap, base * 2**n)
            n += 1
            if clock() + pause >= end:
                raise
            sleep(pause)


def with_backoff(call: Callable, tries: int = 3, first: float = 1.0, factor: float = 2.0, cap: float = 60.0, on: type[Exception] = Exception, sleep=time.sleep):
    """A fixed number of further tries."""
    for n in range(tries + 1):
        try:
            return call()
        except on:
            if n == tries:
                raise
            sleep(min(cap, first * factor**n))


def recognise(pages: DataFrame, engine: Callable[[bytes], str], wait_s: float = 30.0, max_pages: int | None = None) -> DataFrame:
    """Doc, index, text, reason from doc, index, image. One page at a time is in memory beside its batch.

    reason: throttled when the deadline passed, rejected:<code>, error, or null. Parallelism is that of partitions.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for image in pdf["image"]:
                try:
                    out.append((until_deadline(lambda: engine(bytes(image or b"")), wait_s), None))  # noqa: B023
                except Transient:
                    out.append(("", "throttled"))
                except Rejected as e:
                    out.append(("", f"rejected:{e}"))
                except Exception:  # noqa: BLE001  one page must not end the job
                    out.append(("", "error"))
            yield pd.DataFrame({"doc": pdf["doc"], "index": pdf["index"], "text": [t for t, _ in out], "reason": [r for _, r in out]})

    rows = pages if max_pages is None else pages.where(F.col("index") < max_pages)
    return rows.select(F.col("doc").cast("string").alias("doc"), F.col("index").cast("int").alias("index"), "image").mapInPandas(run, "doc string, index int, text string, reason string")


def is_low_text(pages: DataFrame, key: str, least: float = 40.0) -> DataFrame:
    """Key, low_text: fewer than ``least`` visible characters a page."""
    return pages.groupBy(key).agg((F.sum(F.length(strip(F.coalesce("text", F.lit(""))))) / F.count(F.lit(1)) < least).alias("low_text"))


BLOCKS = "array<struct<Id:string,BlockType:string,Text:string,RowIndex:int,ColumnIndex:int,Relationships:array<struct<Type:string,Ids:array<string>>>>>"


def block_tables(answers: DataFrame, key: str, blocks: str) -> DataFrame:
    """Key, table_id, rows from an engine's JSON list of blocks: tables hold cells, cells hold words.

    Tables under two rows or two columns are left out. One answer is one page, so its joins are inside the key.
    """
    b = answers.select(key, F.explode(F.from_json(F.col(blocks), BLOCKS)).alias("b")).select(key, "b.*")

    def children(kind: str) -> DataFrame:
        links: Column = F.flatten(F.transform(F.filter("Relationships", lambda r: r["Type"] == "CHILD"), lambda r: r["Ids"]))
        return b.where(F.col("BlockType") == kind).select(key, F.col("Id").alias("parent"), "RowIndex", "ColumnIndex", F.posexplode_outer(links).alias("pos", "child"))

    cells = children("TABLE").select(key, F.col("parent").alias("table_id"), F.col("child").alias("cell"))
    words = b.where(F.col("BlockType") == "WORD").select(key, F.col("Id").alias("child"), "Text")
    spelled = children("CELL").join(words, [key, "child"], "left").groupBy(key, F.col("parent").alias("cell"), "RowIndex", "ColumnIndex").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("Text").isNotNull(), F.struct("pos", "Text")))), lambda w: w["Text"]), " ").alias("t"))
    placed = cells.join(spelled, [key, "cell"]).groupBy(key, "table_id").agg(F.max("RowIndex").alias("h"), F.max("ColumnIndex").alias("w"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", F.col("RowIndex").cast("string"), F.col("ColumnIndex").cast("string")), "t"))).alias("at"))
    grid = F.transform(F.sequence(F.lit(1), F.col("h")), lambda r: F.transform(F.sequence(F.lit(1), F.col("w")), lambda c: F.coalesce(F.try_element_at("at", F.concat_ws(",", r.cast("string"), c.cast("string"))), F.lit(""))))
    return placed.where("h >= 2 AND w >= 2").select(key, "table_id", drop_empty(grid).alias("rows"))


def write_full_md(documents: DataFrame, dest: str) -> bool:
    """K6: path and full_md of documents that have any, as JSON lines; False and nothing written if none has."""
    full = documents.where("full_md <> ''").select("path", "full_md")
    if full.isEmpty():
        return False
    full.write.json(dest)
    return True
