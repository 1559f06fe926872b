"""Common spellings of secrets and phone numbers."""

import re

from parchment.llm import pii


def test_common_shapes(spark):
    found = ['token="9f86d081884c7d65"', "api_key = 'Zx81kk0Q2'", "password: hunter2x", '"secret": "a1b2c3d4"', "call 555-123-4567 now", "+44 20 7946 0958", "+33 6 12 34 56 78", "555.123.4567"]
    left = ["password: required", "token of thanks", "version 1.2.3", "a tokenize = abc1234", "+1 23 4"]
    df = spark.createDataFrame(list(enumerate(found + left)), "doc_id long, text string")
    out = pii.pseudonymise(df, key="k")
    got = [(r.text, r.n_values) for r in out.orderBy("doc_id").collect()]
    assert [n for _, n in got] == [1] * len(found) + [0] * len(left)
    for (new, n), old in zip(got, found + left, strict=True):
        assert (new != old) == bool(n) and re.sub("[0-9]", "0", re.sub("[a-z]", "a", new))[:4] == re.sub("[0-9]", "0", re.sub("[a-z]", "a", old))[:4]
    assert [r.text for r in pii.pseudonymise(out.drop("n_values"), undo=True, key="k").orderBy("doc_id").collect()] == found + left
