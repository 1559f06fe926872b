"""A worker holds the tokens of few documents as Python objects at a time, whatever a batch holds."""

import sys

from pyspark.sql import functions as F

from parchment.operators import quality as Q
from parchment.plans import catalogue as C


def test_text_layer_is_read_in_one_pass(spark, data):
    plan = C.queries()["text_layer_broken"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan


def test_tokens_of_a_batch_are_not_held_at_once(spark):
    docs = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("t"))
    got = Q._by_document(docs, ["k"], [F.col("t")], frozenset(["t1"]), "blocks double", lambda hit, x: (float(sys.getallocatedblocks()),)).agg(F.count("k").alias("n"), F.max("blocks").alias("m")).first()
    assert got.n == 10_000 and got.m < 1_500_000  # two million tokens


def test_few_answers_are_remembered():
    hit = Q._Known(frozenset(["w1"]))
    assert sum(hit(f"w{i}") for i in range(250_000)) == 1 and len(hit.seen) <= 100_000


def test_rates_over_several_slices(spark):
    docs = spark.range(0, 3 * Q.SLICE + 1, 1, 1).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.array(F.lit("ab"), F.lit("zz"))).otherwise(F.array().cast("array<string>")).alias("t"))
    lex = spark.createDataFrame([("ab",)], "word string")
    assert [r.rate for r in Q.dict_rate(docs, "k", "t", lex).orderBy("k").collect()] == [0.5 if i % 2 == 0 else 0.0 for i in range(3 * Q.SLICE + 1)]
