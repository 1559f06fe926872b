"""PII: format-preserving Feistel pseudonyms, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, without

#: The session setting from which the query takes its key, and the key of trials without it. Whoever knows a key can
#: undo its pseudonyms, so the operator itself has no default.
KEY_SETTING, TRIAL_KEY = "spark.parchment.pii.key", "parchment-trial"
#: Country codes of telephone numbers, so that the national number is known however it is spaced.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ROUNDS = 8
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_NAMED = r"(?<=[=:\s\"'])(?=[A-Za-z]*+[0-9])(?i:(?<=\b(?:access[_-]?token|auth[_-]?token|token|api[_-]?key|secret[_-]?key|secret|password|passwd|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)[0-9a-z]{6,}+)"
_SECRET = r"(?i:(?<=token = \")[0-9a-f]{16,}+(?=\"))|(?i:(?<=password=)[0-9a-z]{6,}+)|(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|" + _NAMED
_PHONE = (
    r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){2,5}(?![ .-]?\d)|(?<![\d.-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\d-]|\.\d)"
)
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: A run of digit groups that may hold cards among other numbers; it stops before a date, address or security number.
_CARD = rf"(?<![\p{{L}}\d])\d(?:(?![ -](?:{_DATE}|{_SSN}|{_IP}))[ -]?\d){{12,255}}(?!\d)"
PATTERN = "|".join((_EMAIL, _SECRET, _PHONE, _IP, _DATE, _SSN, _CARD))
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FIRST_YEAR, _YEARS = 1900, 200


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, bases: Column, kind: str, key: str, undo: bool = False) -> Column:
    """Permute an array of numbers, each below its base (base 0: fixed), by turns of its even and its odd places.

    In each round every number of one half is moved, within its base, by a keyed SHA-256 of the other half, its place
    and the round, so the whole is a permutation of all arrays with these bases, and the rounds run back undo it.
    """
    sign = -1 if undo else 1

    def turn(state: Column, r: Column) -> Column:
        still = F.array_join(F.transform(state, lambda x, i: F.when(F.pmod(i, F.lit(2)) != F.pmod(r, F.lit(2)), x.cast("string")).otherwise("_")), ",")

        def move(other: Column) -> Column:
            def by(x: Column, i: Column) -> Column:
                base = F.get(bases, i)
                shift = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), i.cast("string"), other).cast("binary"), 256), 1, 12), 16, 10).cast("long")
                moved = F.pmod(x.cast("long") + sign * F.pmod(shift, base.cast("long")), base.cast("long")).cast("int")
                return F.when((base > 0) & (F.pmod(i, F.lit(2)) == F.pmod(r, F.lit(2))), moved).otherwise(x)

            return F.transform(state, by)

        return _let(still, move)

    order = list(range(ROUNDS))[::-1] if undo else list(range(ROUNDS))
    return F.aggregate(F.array(*map(F.lit, order)), values, turn)


def _spelled(body: Column, kind: str, key: str, undo: bool, letters: int = 26) -> Column:
    """A string with its digits and ASCII letters permuted in their places; case and all else stay."""

    def permuted(chars: Column) -> Column:
        code = F.transform(chars, lambda c: F.greatest(F.instr(F.lit("0123456789"), c), F.instr(F.lit(_LOWER[:letters]), c), F.instr(F.lit(_UPPER[:letters]), c)) - 1)
        base = F.transform(chars, lambda c: F.when(F.instr(F.lit("0123456789"), c) > 0, 10).when(F.instr(F.lit(_LOWER[:letters] + _UPPER[:letters]), c) > 0, letters).otherwise(0))
        moved = _let(base, lambda b: feistel(code, b, kind, key, undo))
        spell = F.zip_with(chars, moved, lambda c, v: F.when(F.instr(F.lit("0123456789"), c) > 0, v.cast("string")).when(F.instr(F.lit(_LOWER[:letters]), c) > 0, F.substring(F.lit(_LOWER), v + 1, F.lit(1))).when(F.instr(F.lit(_UPPER[:letters]), c) > 0, F.substring(F.lit(_UPPER), v + 1, F.lit(1))).otherwise(c))
        return F.array_join(spell, "")

    return _let(F.filter(F.split(body, ""), lambda c: c != ""), permuted)


def _numbered(body: Column, fixed: Column, kind: str, key: str, undo: bool) -> Column:
    """A string with its digits after the first ``fixed`` permuted in their places; what stands between does not count."""

    def permuted(digits: Column) -> Column:
        free = F.transform(F.filter(F.split(F.substring(digits, fixed + 1, F.length(digits)), ""), lambda c: c != ""), lambda c: c.cast("int"))
        moved = _let(free, lambda v: feistel(v, F.transform(v, lambda _: F.lit(10)), kind, key, undo))

        def placed(new: Column) -> Column:
            at = lambda i: F.length(F.regexp_replace(F.substring(body, F.lit(1), i + 1), r"\D", "")) - 1 - fixed
            return F.array_join(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike(r"^\d$") & (at(i) >= 0), F.get(new, at(i)).cast("string")).otherwise(c)), "")

        return _let(moved, placed)

    return _let(F.regexp_replace(body, r"\D", ""), permuted)


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum of a string of digits; ``doubled``: whether the last digit counts twice (1) or not (0)."""

    def add(a: Column, x: Column) -> Column:
        return a + x

    return _let(F.filter(F.split(digits, ""), lambda c: c != ""), lambda d: F.aggregate(F.transform(F.reverse(d), lambda c, i: _let(c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 1 - doubled, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))), F.lit(0), add))


def _card(m: Column, key: str, undo: bool) -> Column:
    """All digits but the last permuted, the last set so that the Luhn sum is right again."""
    body = _numbered(F.substring(m, F.lit(1), F.length(m) - 1), F.lit(0), "card", key, undo)
    return _let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn(F.regexp_replace(b, r"\D", ""), 1), F.lit(10)), F.lit(10)).cast("string")))


def _cards(m: Column, key: str, undo: bool) -> Column:
    """A run of digit groups with each card in it replaced (out), and their number (n).

    From each group on, the longest 13 to 19 digits that end with a group and pass Luhn are a card.
    """
    groups = F.regexp_extract_all(m, F.lit(r"\d+[ -]?"), 0)

    def scan(g: Column) -> Column:
        def at(a: Column, i: Column) -> Column:
            def best(k: Column) -> Column:
                digits = F.regexp_replace(F.array_join(F.slice(g, i + 1, k), ""), r"\D", "")
                return F.when(F.length(digits).between(13, 19), F.pmod(_luhn(digits, 0), F.lit(10)) == 0).otherwise(False)

            fits = F.filter(F.sequence(F.least(F.lit(19), F.size(g) - i), F.lit(1)), best)

            def put(k: Column) -> Column:
                part = F.array_join(F.slice(g, i + 1, k), "")
                body = F.regexp_replace(part, r"[ -]$", "")
                new = F.concat(_card(body, key, undo), F.substring(part, F.length(body) + 1, F.lit(1)))
                return F.when(k.isNull(), F.struct(F.concat(a["out"], F.get(g, i)).alias("out"), a["n"].alias("n"), a["next"].alias("next"))).otherwise(F.struct(F.concat(a["out"], new).alias("out"), (a["n"] + 1).alias("n"), (i + k).alias("next")))

            return F.when(i < a["next"], a).otherwise(_let(F.get(fits, F.lit(0)), put))

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("next"))
        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, at)

    return _let(groups, scan)


def _ip(m: Column, key: str, undo: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    padded = m.rlike(r"(^|\.)0\d")
    return F.array_join(F.transform(feistel(octets, F.array(*[F.lit(256)] * 4), "ip", key, undo), lambda x: F.when(padded, F.lpad(x.cast("string"), 3, "0")).otherwise(x.cast("string"))), ".")


def _day(m: Column) -> Column:
    parts = [F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)), m]
    return F.try_to_timestamp(F.when(m.contains("/"), parts[0]).otherwise(parts[1]), F.lit("yyyy-MM-dd")).cast("date")


def _date(m: Column, key: str, undo: bool) -> Column:
    """Year of 1900 to 2099 and day of a common year permuted; 29 February goes to that day of another leap year."""

    def moved(d: Column) -> Column:
        leap = (F.month(d) == 2) & (F.day(d) == 29)
        common = F.datediff(F.make_date(F.lit(2001), F.month(d), F.when(leap, 28).otherwise(F.day(d))), F.lit("2001-01-01").cast("date"))
        values = F.when(leap, F.array(((F.year(d) - 1904) / 4).cast("int"), F.lit(0))).otherwise(F.array((F.year(d) - _FIRST_YEAR).cast("int"), common.cast("int")))
        bases = F.when(leap, F.array(F.lit(49), F.lit(0))).otherwise(F.array(F.lit(_YEARS), F.lit(365)))

        def back(v: Column) -> Column:
            day = F.date_add(F.lit("2001-01-01").cast("date"), F.get(v, F.lit(1)))
            year = F.when(leap, F.get(v, F.lit(0)) * 4 + 1904).otherwise(F.get(v, F.lit(0)) + _FIRST_YEAR)
            month, dom = F.when(leap, 2).otherwise(F.month(day)), F.when(leap, 29).otherwise(F.day(day))
            return F.when(m.contains("/"), F.format_string("%02d/%02d/%04d", dom, month, year)).otherwise(F.format_string("%04d-%02d-%02d", year, month, dom))

        return _let(feistel(values, bases, "date", key, undo), back)

    return _let(_day(m), moved)


def _kind(m: Column) -> Column:
    """What a match is, after validation; null if it is not valid."""
    digits = F.regexp_replace(m, r"\D", "")
    octets = F.forall(F.split(m, r"\."), lambda x: x.try_cast("int") < 256) & (~m.rlike(r"(^|\.)0\d") | m.rlike(r"^\d{3}(\.\d{3}){3}$"))
    day = _day(m)
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(r"^AKIA[0-9A-Z]{16}$"), F.lit("key"))
        .when(m.rlike(r"^(\+|\()"), F.when(F.length(digits).between(8, 15), F.lit("phone")))
        .when(m.rlike(r"^\d{3}([.-])\d{3}\1\d{4}$"), F.lit("phone"))
        .when(m.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), F.when(octets, F.lit("ip")))
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), F.when(day.isNotNull() & F.year(day).between(_FIRST_YEAR, _FIRST_YEAR + _YEARS - 1), F.lit("date")))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~m.rlike(r"^(000|666|9)|-00-|-0000$"), F.lit("ssn")))
        .when(m.rlike(r"^\d[\d -]*\d$") & (F.length(digits) >= 13), F.lit("card"))
        .when(m.rlike(r"(?i)^[0-9a-f]{16,}$") & m.rlike("(?i)[a-f]"), F.lit("secret"))
        .when(m.rlike(r"(?i)^[0-9a-z]{6,}$") & ~m.rlike(r"^\d{13,19}$"), F.lit("secret"))
    )


def _pseudonym(m: Column, kind: Column, key: str, undo: bool) -> Column:
    dot = F.length(m) - F.instr(F.reverse(m), ".")
    cc = F.when(m.startswith("+"), F.length(F.regexp_extract(F.regexp_replace(m, r"\D", ""), _COUNTRY, 1))).otherwise(0)
    return (
        F.when(kind == "email", F.concat(_spelled(F.substring(m, F.lit(1), dot), "email", key, undo), F.substring(m, dot + 1, F.length(m))))
        .when(kind == "key", F.concat(F.lit("AKIA"), _spelled(F.substring(m, 5, 64), "key", key, undo)))
        .when(kind == "phone", _numbered(m, cc, "phone", key, undo))
        .when(kind == "ip", _ip(m, key, undo))
        .when(kind == "date", _date(m, key, undo))
        .when(kind == "ssn", _numbered(m, F.lit(1), "ssn", key, undo))
        .when((kind == "secret") & m.rlike("(?i)^[0-9a-f]+$"), _spelled(m, "hex", key, undo, 6))
        .when(kind == "secret", _spelled(m, "secret", key, undo))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with validated e-mail addresses, phone numbers, IPv4 addresses, dates, card numbers, keys and secrets
    replaced by keyed permutations of the same format, and n_values, the number of such values.

    Equal values get equal pseudonyms in every document, also where they are spelled otherwise: the separators of
    cards and phone numbers, the country code before a national number, the order of a date, padded octets and the
    case of addresses do not count. What fails its check (Luhn, octets, calendar) stays. ``undo`` with the same key
    gives the values back; of ssn only where the pseudonym is itself one that is issued, of cards where no other part
    of their run of digits passes Luhn by chance, of padded octets without their zeros if the pseudonym has none.

    A null text stays null with n_values 0, as does an empty one. Whole texts are read; matching takes linear time.
    Repeated rows give repeated rows, an empty table none. A column named n_values is replaced; all others stay.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col)
    docs = docs.select(*without(docs, "n_values"))
    found_, new_ = fresh(docs, "_p_found", "_p_new")
    found = F.when(text.rlike(PATTERN), F.regexp_extract_all(text, F.lit(PATTERN), 0))
    out = docs.withColumn(found_, F.transform(found, lambda m: _let(_kind(m), lambda k: _let(F.when(k == "card", _cards(m, key, undo)), lambda c: F.struct(m.alias("m"), F.when((k != "card") | (c["n"] > 0), k).alias("k"), c["out"].alias("c"), F.coalesce(c["n"], k.isNotNull().cast("int")).alias("n"))))))
    out = out.withColumn(new_, F.when(F.exists(found_, lambda x: x["k"].isNotNull()), F.transform(found_, lambda x: F.when(x["k"] == "card", x["c"]).otherwise(_pseudonym(x["m"], x["k"], key, undo)))))
    parts = F.split(text, PATTERN, -1)
    joined = _let(parts, lambda p: F.array_join(F.zip_with(p, F.concat(new_, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""))
    count = F.coalesce(F.aggregate(found_, F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long")
    return out.select(*[F.when(F.col(new_).isNull(), text).otherwise(joined).alias(c) if c == text_col else F.col(c) for c in docs.columns], count.alias("n_values"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """With the key of the session setting ``spark.parchment.pii.key``; without one, as a trial, with a known key."""
    key = spark.conf.get(KEY_SETTING, None) or TRIAL_KEY
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)
