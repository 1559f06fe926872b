"""Language-model scores of a whole table against dictionaries; no score is infinite or above zero."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import lm_score


def brute(texts):
    words = [(t or "").lower().split() for t in texts]
    own = [[Counter(zip(*(w[i:] for i in range(k)), strict=False)) for k in (1, 2, 3)] for w in words]
    total = [Counter() for _ in range(3)]
    for o in own:
        for t, c in zip(total, o, strict=True):
            t.update(c)
    n, out = sum(map(len, words)), []
    for w, o in zip(words, own, strict=True):
        s = 0.0
        for j in range(len(w)):
            top = min(3, j + 1)
            for k in range(top, 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                c = total[k - 1][g] - o[k - 1][g]
                if k == 1 or c > 0:
                    s += (top - k) * math.log(0.4) + (math.log(c / (total[k - 2][g[:-1]] - o[k - 2][g[:-1]])) if k > 1 else math.log(max(c, 0.5) / max(n - len(w), 1)))
                    break
        out.append(s)
    return out


@pytest.mark.parametrize("block", [8_000_000, 100_000])
def test_whole_table(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, block=block).collect()}
    for (i, _), want in zip(rows, brute([t for _, t in rows]), strict=True):
        assert got[i].log_score == pytest.approx(want) and got[i].log_score <= 0


def test_repeats_and_a_text_larger_than_a_block(spark):
    texts = ["a b c " * 300] * 40 + ["w%d x y z" % i for i in range(50)] + [None, "", "lonely"]
    df = spark.createDataFrame([(7 if i < 40 else None if i < 60 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(round(r.log_score, 6) for r in lm_score.lm_scores(df.withColumn("block", F.lit("x")), block=500).collect())
    assert got == sorted(round(x, 6) for x in brute(texts))


def test_shared_hashes_back_off():
    b = lm_score.Block(["p q r", "s t u"], 3)
    totals = [c.copy() for c in b.counts]
    totals[2] = totals[2] + 5  # as if other trigrams had these hashes; their contexts stand nowhere else
    s, n = b.scores(totals, 0.4)
    assert np.isfinite(s).all() and n.tolist() == [3, 3]
