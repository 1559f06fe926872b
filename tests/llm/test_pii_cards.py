"""Cards beside other numbers."""

import re

from parchment.llm import pii


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def test_cards_beside_numbers(spark):
    card, other = "4111 1111 1111 1111", "5500-0000-0000-0004"
    texts = [f"{card} 12/27", f"{card.replace(' ', '')} 123", f"12 {card}", f"{card} {other} 7", f"{card} 2020-01-15", f"{card} 123-45-6789", "1234 5678 9012 3456 78"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymise(df, key="k")
    got = [(r.text, r.n_values) for r in out.orderBy("doc_id").collect()]
    assert [n for _, n in got] == [1, 1, 1, 2, 2, 2, 0]
    assert got[0][0].endswith(" 12/27") and got[1][0].endswith(" 123") and got[2][0].startswith("12 ") and got[6][0] == texts[6]
    for (new, _), old in zip(got, texts, strict=True):
        assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old)
    assert luhn(got[0][0][:19].replace(" ", "")) and card not in got[0][0] and other not in got[3][0]
