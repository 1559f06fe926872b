"""Tables that go on over pages, and tables from word positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import tables as M

_BLOCK = "struct<page:int,index:int,rows:array<array<string>>>"


def _key(rows: Column) -> Column:
    return F.lower(F.array_join(F.transform(F.slice(F.get(rows, F.lit(0)), 1, 8), M.cell), "|"))


def same_schema(a: Column, b: Column) -> Column:
    """X7."""
    heads = (_key(a) == _key(b)) & F.regexp_replace(_key(a), r"\|", "").rlike(r"\S")
    follows = (F.size(a) >= 3) & (F.size(b) >= 2) & ~_key(b).startswith("item")
    return (M.width(a) == M.width(b)) & (M.width(a) >= 2) & (heads | follows)


def merge_pages(blocks: DataFrame, doc: str) -> DataFrame:
    """Doc, index, page, rows. A block joins the one before it if that began on the same page or the one before."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        near = last["page"].isNotNull() & x["page"].isNotNull() & ((x["page"] == last["page"]) | (x["page"] == last["page"] + 1))
        repeat = (_key(last["rows"]) == _key(x["rows"])) & F.regexp_replace(_key(x["rows"]), r"\|", "").rlike(r"\S")
        more = F.when(repeat, F.slice(x["rows"], 2, F.size(x["rows"]))).otherwise(x["rows"])
        grown = F.struct(last["page"].alias("page"), last["index"].alias("index"), F.concat(last["rows"], more).alias("rows"))
        joins = (F.size(acc) > 0) & near & same_schema(last["rows"], x["rows"])
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    listed = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), F.col("index").cast("int").alias("index"), F.col("rows").cast(M.MATRIX).alias("rows")).cast(_BLOCK))).alias("b"))
    merged = listed.select(doc, F.aggregate("b", F.array().cast(f"array<{_BLOCK}>"), step).alias("m"))
    return merged.select(doc, F.posexplode("m").alias("index", "x")).select(doc, "index", "x.page", "x.rows")


def clustered(words: Column, height: Column) -> Column:
    """Words (text, left, top) as rows of words; the height that a row stands at moves with each word."""
    tol = F.greatest(F.lit(8.0), height * 0.015)
    kind = "struct<ref:double,ws:array<struct<left:double,top:double,text:string>>>"
    sorted_words = F.transform(F.array_sort(F.transform(words, lambda w: F.struct(w["top"].cast("double").alias("top"), w["left"].cast("double").alias("left"), w["text"].alias("text")))), lambda w: F.struct(w["left"].alias("left"), w["top"].alias("top"), w["text"].alias("text")))

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.abs(w["top"] - last["ref"]) <= tol)
        grown = F.struct(((last["ref"] + w["top"]) / 2).alias("ref"), F.concat(last["ws"], F.array(w)).alias("ws"))
        new = F.struct(w["top"].alias("ref"), F.array(w).alias("ws"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    return F.transform(F.aggregate(sorted_words, F.array().cast(f"array<{kind}>"), step), lambda g: F.array_sort(g["ws"]))


def column_edges(lefts: Column, gap: float = 25.0, most: int = 8) -> Column:
    """X11: zero and the middles of the widest gaps between left edges."""

    def find(s: Column) -> Column:
        gaps = F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.struct((b - a).alias("g"), ((a + b) / 2).alias("mid"))), lambda x: x["g"].isNotNull() & (x["g"] >= gap))
        top = F.slice(F.sort_array(gaps, asc=False), 1, most)
        return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.transform(top, lambda x: x["mid"]))))

    return M.let(F.array_sort(lefts), find)


def matrix(rows: Column, edges: Column) -> Column:
    """Rows of words to cells by the last edge not right of a word; null for fewer than two rows."""
    n = F.greatest(F.lit(2), F.size(edges))

    def line(ws: Column) -> Column:
        at = F.transform(ws, lambda w: F.struct(F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: w["left"] >= e)) - 1).alias("c"), w["text"].alias("t")))
        return M.let(at, lambda a: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.array_join(F.transform(F.filter(a, lambda x: x["c"] == j), lambda x: x["t"]), " ")))

    return F.when(F.size(rows) >= 2, M.drop_empty(F.transform(rows, line)))
