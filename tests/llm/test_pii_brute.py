"""Pseudonyms against a second Feistel network in plain Python; spellings of one value stay linked."""

import datetime
import hashlib
import random
import re

import pytest

from parchment.llm import pii


def feistel(values, bases, kind, key):
    values = list(values)
    for r in range(pii.ROUNDS):
        still = ",".join("_" if i % 2 == r % 2 else str(v) for i, v in enumerate(values))
        for i, base in enumerate(bases):
            if base and i % 2 == r % 2:
                values[i] = (values[i] + int(hashlib.sha256(f"{key}|{kind}|{r}|{i}|{still}".encode()).hexdigest()[:12], 16) % base) % base
    return values


def spelled(text, kind, key, letters=26):
    def code(c):
        return int(c) if c.isdigit() else ord(c.lower()) - 97

    bases = [10 if c in "0123456789" else letters if c.isascii() and c.isalpha() and ord(c.lower()) - 97 < letters else 0 for c in text]
    new = feistel([code(c) if b else -1 for c, b in zip(text, bases, strict=True)], bases, kind, key)
    return "".join(c if not b else str(v) if b == 10 else chr((97 if c.islower() else 65) + v) for c, b, v in zip(text, bases, new, strict=True))


def numbered(text, fixed, kind, key):
    digits = [int(c) for c in text if c.isdigit()]
    new = iter(digits[:fixed] + feistel(digits[fixed:], [10] * (len(digits) - fixed), kind, key))
    return re.sub(r"\d", lambda _: str(next(new)), text)


def luhn(digits, doubled):
    return sum(sum(divmod(int(c) * (2 if i % 2 == 1 - doubled else 1), 10)) for i, c in enumerate(reversed(digits))) % 10


def card(text, key):
    body = numbered(text[:-1], 0, "card", key)
    return body + str(-luhn(re.sub(r"\D", "", body), 1) % 10)


def date(y, m, d, key):
    if (m, d) == (2, 29):
        return feistel([(y - 1904) // 4, 0], [49, 0], "date", key)[0] * 4 + 1904, 2, 29
    day = (datetime.date(2001, m, d) - datetime.date(2001, 1, 1)).days
    y, day = feistel([y - 1900, day], [200, 365], "date", key)
    at = datetime.date(2001, 1, 1) + datetime.timedelta(day)
    return y + 1900, at.month, at.day


def test_against_plain_python(spark):
    rng, key, cases = random.Random(6), "a key", []
    for _ in range(60):
        n = "".join(rng.choices("0123456789", k=15))
        n = "4" + n[:14] + str(-luhn("4" + n[:14], 1) % 10)
        for x in (n, " ".join(n[i : i + 4] for i in range(0, 16, 4)), "-".join(n[i : i + 4] for i in range(0, 16, 4))):
            cases.append((x, card(x, key)))
        y, m, d = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
        a, b, c = date(y, m, d, key)
        cases += [(f"{y:04}-{m:02}-{d:02}", f"{a:04}-{b:02}-{c:02}"), (f"{d:02}/{m:02}/{y:04}", f"{c:02}/{b:02}/{a:04}")]
        ip = [rng.randrange(256) for _ in range(4)]
        new = feistel(ip, [256] * 4, "ip", key)
        cases.append((".".join(map(str, ip)), ".".join(map(str, new))))
        ip[0] %= 100
        cases.append((".".join(f"{x:03}" for x in ip), ".".join(f"{x:03}" for x in feistel(ip, [256] * 4, "ip", key))))
        p = f"{rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(0, 9999):04}"
        for cc, x in ((1, f"+1 {p}"), (1, "+1" + p.replace(" ", "")), (0, p.replace(" ", "-")), (2, f"+44 {p}"), (2, "+44" + p.replace(" ", "")), (3, f"+353 {p}")):
            cases.append((x, numbered(x, cc, "phone", key)))
        name = "".join(rng.choices("abcXYZ019._", k=8))
        cases.append((f"q{name}@mail-{rng.randrange(99)}.org", None))
        cases[-1] = (cases[-1][0], spelled(cases[-1][0].rpartition(".")[0], "email", key) + ".org")
        s = f"{rng.randint(100, 665)}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"
        cases.append((s, numbered(s, 1, "ssn", key)))
        k = "AKIA" + "".join(rng.choices("ABCXYZ0189", k=16))
        cases.append((k, "AKIA" + spelled(k[4:], "key", key)))
        h = "a1" + "".join(rng.choices("0123456789abcdef", k=30))
        cases.append((f'token = "{h}"', f'token = "{spelled(h, "hex", key, 6)}"'))
    df = spark.createDataFrame([(i, f"x {c[0]} y") for i, c in enumerate(cases)], "doc_id long, text string")
    for r in pii.pseudonymise(df, key).collect():
        assert r.text == f"x {cases[r.doc_id][1]} y", cases[r.doc_id]


def test_spellings_stay_linked(spark):
    same = [
        ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"], ["+1 (499) 555-6503", "+1 499 555 6503", "+14995556503", "(499) 555-6503", "499-555-6503"],
        ["+44 20 7946 0958", "+44-20-7946-0958"], ["2001-12-31", "31/12/2001"], ["1.2.30.4", "001.002.030.004"], ["Ann.B@Mail.org", "ann.b@mail.org"],
    ]
    df = spark.createDataFrame([(g, f"<{x}>") for g, xs in enumerate(same) for x in xs], "doc_id long, text string")
    got = {}
    for r in pii.pseudonymise(df, "k").collect():
        assert r.n_values == 1
        got.setdefault(r.doc_id, []).append(r.text.strip("<>"))
    plain = lambda x: re.sub(r"\D", "", x)[-10:]
    assert len({plain(x) for x in got[0]}) == 1 and len({plain(x) for x in got[1]}) == 1 and len({plain(x) for x in got[2]}) == 1
    assert got[3][0].split("-") == got[3][1].split("/")[::-1]
    assert [int(x) for x in got[4][0].split(".")] == [int(x) for x in got[4][1].split(".")]
    assert got[5][0].lower() == got[5][1]


def test_odd_octets_stay_and_a_key_is_needed(spark):
    df = spark.createDataFrame([(1, "01.2.3.4 and 300.1.1.1")], "doc_id long, text string")
    assert pii.pseudonymise(df, "k").first().n_values == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")
