"""The way without a shuffle gives what the joined way gives; names after collisions; references in HTML."""

import html

from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import archive as A
from parchment.operators import quality as Q
from parchment.plans import catalogue as C
from parchment.sources import files as S


def test_small_and_large_lexicons_agree(spark, data, monkeypatch):
    docs = C._deformed(spark, data).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "([^ ])([^ ])", "$1$2 ")).otherwise(F.col("text")))
    docs = docs.select("doc_id", T.tokens(F.col("text")).alias("t"))
    lex = docs.where("doc_id < 150").select(F.explode("t").alias("w")).select(Q.folded(F.col("w")).alias("word")).distinct()
    got = []
    for limit in (1_000_000, 5):
        monkeypatch.setattr(Q, "BROADCAST_WORDS", limit)
        got.append([sorted(map(tuple, f(docs, "doc_id", "t", lex).collect())) for f in (Q.dict_rate, Q.fragments, Q.ciphers)])
    for a, b in zip(*got, strict=True):
        assert len(a) == len(b) > 20
        assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-12 and x[2:] == y[2:] for x, y in zip(a, b, strict=True))
    assert any(x[2] for x in got[0][1]) and any(x[1] for x in got[0][2])


def test_fold_table_is_fold(spark):
    text = "".join(map(chr, range(32, 0x2200)))
    assert spark.range(1).select(T.fold(F.lit(text)).alias("x")).first().x == text.translate(T.fold_table())


def test_names_after_collisions(spark):
    names = ["f.html", "f.html", "f_1.html", "g.x", "g.x", "h", "h", "h_1", "d/a.b/n", "d/a.b/n"]
    df = spark.createDataFrame([(i, "r", n) for i, n in enumerate(names)] + [(99, "other", "f.html")], "i int, root string, name string")
    got = [r.dest for r in A.renamed(df, "root", "name", ["i"]).orderBy("i").collect()]
    assert got == ["f.html", "f_1.html", "f_1_1.html", "g.x", "g_1.x", "h", "h_1", "h_1_1", "d/a.b/n", "d/a.b/n_1", "f.html"]


def test_references(spark):
    cases = ["caf&eacute; &#233; &#x27;", "&amp;lt;", "&#128;&#0;&#xD800;&#x1F600;", "a & b &; &nope; &#; &#x;", "&NotEqualTilde;&hellip;", "none", ""]
    got = [r.x for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", T.unescaped(F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == list(map(html.unescape, cases))


def test_uploads_of_one_name_stay_apart(spark):
    rows = [("a/x.txt", bytearray(b"one")), ("b/x.txt", bytearray(b"two")), ("b/x.txt", bytearray(b"two"))]
    got = sorted(r.text for r in S.upload_texts(spark.createDataFrame(rows, "filename string, content binary")).collect())
    assert got == ['file_path_pwd:"x.txt"\none', 'file_path_pwd:"x.txt"\ntwo', 'file_path_pwd:"x.txt"\ntwo']
