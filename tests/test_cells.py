"""Cells are cleaned to the fixpoint, whole texts as well."""

import re

from pyspark.sql import functions as F

from parchment.functions import tables as M
from parchment.plans import catalogue

LETTERS = "A-Za-zÁÉÍÓÚÂÊÔÃÕÇáéíóúâêôãõç"


def fixpoint(text):
    text = text.strip()
    for pattern in (r"([0-9][.0-9]*,[0-9]+)\s+([0-9])\b", rf"\b([{LETTERS}]{{2,}})\s+([{LETTERS}])\b"):
        before = None
        while before != text:
            before, text = text, re.sub(pattern, r"\1\2", text)
    return " ".join(text.split())


def test_split_letters_join_to_the_end(spark):
    cells = ["ES T I M A T I V A", "R$ 1,2 3 4 5 6 7 8 9 0", "1,2 3,4 5", "a bc d, ef g h 1,5 2 x", "", " ", "ção é à x y z w v u t s"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(cells)), "i int, c string").orderBy("i").select(M.clean_cell(F.col("c")).alias("c")).collect()]
    assert got == [fixpoint(c) for c in cells] and got[0] == "ESTIMATIVA"


def test_cell_cleanup_reads_whole_texts(spark, tmp_path):
    long = "a b some words " * 20 + "ES T I M A T I V A 7,1 2 3 4 5 6 7 8 end"
    spark.createDataFrame([(1, long), (2, "x"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.cell for r in catalogue.queries()["cell_cleanup"](spark, str(tmp_path)).collect()}
    lead = "R$ 99.068,7 1 ESTIMATIV A "
    assert got[1] == fixpoint(lead + long) and got[2] == fixpoint(lead + "x")


def test_cells_that_hold_nothing_cut_skip_the_loop(spark):
    p = spark.createDataFrame([], "c string").select(M.clean_cell(F.col("c")))._jdf.queryExecution().analyzed().toString()
    assert r"[0-9]\s+[0-9](?![0-9])" in p
    cells = ["word " * 3000, "1,2 3 4,5 6,7 8", "ab c d,e fg h,ij k", "1,2\t3\n4 5", "a b cd e", "x1 y zz y1", "ab ć", "é a", "éé a"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(cells)), "i int, c string").orderBy("i").select(M.clean_cell(F.col("c")).alias("c")).collect()]
    assert got[:4] == [fixpoint(c) for c in cells[:4]] and got[-1] == "ééa" and got[-2] == "é a"
