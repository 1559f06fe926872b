"""The pipeline's stages, one after the other, against plain Python on a small table."""

import math

from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import bpe, classifier, mixing


def test_pipeline_brute(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = classifier.trained(spark, data, docs)
    rows = sorted(map(tuple, docs.select("doc_id", "text", "source").collect()))
    make = classifier.Featurer()
    import re

    import numpy as np

    left = [r for r in rows if model.grades(np.array([model.weights[make(r[1])].sum()]))[1][0] >= classifier.KEEP]
    seen: dict = {}
    for r in left:
        seen.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r[1]), r)
    left = [*seen.values()]
    sets = {}
    for i, text, _ in left:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))}
    alike = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = {i: i for i in sets}
    for _ in range(len(alike) + 1):
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    assert alike
    left = [r for r in left if root[r[0]] == r[0]]
    n: dict = {}
    for r in left:
        n[r[2]] = n.get(r[2], 0) + 1
    whole = sum(math.sqrt(x) for x in n.values())
    import hashlib

    want = []
    reuse = bpe.Reuse(bpe.default_tokenizer())
    for i, text, source in left:
        mean = len(left) * math.sqrt(n[source]) / whole / n[source]
        u = (int(hashlib.md5(f"{mixing.SEED}|{i}|0".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        k, total = 0, math.exp(-mean)
        while total < u:
            k += 1
            total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        want += [(i, tuple(reuse.encode(text)))] * k
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, data).collect())
    assert got == sorted(want) and got


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == list(corpus_pipeline.COLUMNS)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_odd_rows(spark, data):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "s", 0), (None, "some words of a text that is there", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, data).collect()
        assert stage(spark, odd.limit(0), data).count() == 0
