"""Column functions over text: cleaning, sniffing, detectors. All run inside the JVM."""

from __future__ import annotations

import json
from functools import reduce
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace sees it; Java's \s is narrower.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same signs in a row, the space first, and the class without the space.
WS_SIGNS = " " + "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_WS_BUT_SPACE = WS.replace("\\x20", "\\x1f")
#: White space that is not one space alone.
UNEVEN = rf" {WS}+|{_WS_BUT_SPACE}{WS}*"
_ONE = {
    "A": "ÀÁÂÃÄÅĀĂĄ", "C": "ÇĆĈĊČ", "D": "ÐĎĐ", "E": "ÈÉÊËĒĔĖĘĚ", "G": "ĜĞĠĢ", "H": "ĤĦ", "I": "ÌÍÎÏĨĪĬĮİ", "J": "Ĵ", "K": "Ķ", "L": "ĹĻĽĿŁ",
    "N": "ÑŃŅŇ", "O": "ÒÓÔÕÖØŌŎŐ", "R": "ŔŖŘ", "S": "ŚŜŞŠ", "T": "ŢŤŦ", "U": "ÙÚÛÜŨŪŬŮŰŲ", "W": "Ŵ", "Y": "ÝŶŸ", "Z": "ŹŻŽ",
    "a": "àáâãäåāăąª", "c": "çćĉċč", "d": "ðďđ", "e": "èéêëēĕėęě", "f": "ſ", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀł",
    "n": "ñńņň", "o": "òóôõöøōŏőº", "r": "ŕŗř", "s": "śŝşš", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "x": "×", "y": "ýÿŷ", "z": "źżž",
    "'": "‘’‚‛`´", '"': "“”„‟", "-": "‐‑‒–", " ": "\u00a0\u2002\u2003\u2009\u202f\u3000", "0": "⁰₀", "1": "¹₁", "2": "²₂", "3": "³₃", "*": "•", "!": "¡", "?": "¿",
}
_ONE["s"] = "śŝşšſ"
_ONE.pop("f")
_MANY = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "…": "...", "—": "--", "€": "EUR", "°": "deg", "©": "(c)", "®": "(r)", "™": "(tm)", "½": "1/2", "¼": "1/4", "¾": "3/4", "«": "<<", "»": ">>", "ﬁ": "fi", "ﬂ": "fl"}


#: White space as \s has it in DuckDB's patterns.
SQL_SPACE = r"[\t\n\f\r ]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_SIGNS))


def one_space(text: Column) -> Column:
    """Each run of white space as one space; runs that are one space already are not matched."""
    return F.regexp_replace(text, UNEVEN, " ")


def fold(text: Column) -> Column:
    """Letters with marks as plain ones, and common signs spelled out; what the table lacks stays."""
    frm, to = "".join(_ONE.values()), "".join(k * len(v) for k, v in _ONE.items())
    plain = F.translate(text, frm, to)
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), _MANY.items(), plain)


def fold_table() -> dict[int, str]:
    """What ``fold`` does, for str.translate."""
    return {ord(c): k for k, v in _ONE.items() for c in v} | {ord(k): v for k, v in _MANY.items()}


def split_words(text: Column, space: str = WS) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{space}+"), lambda w: w != "")


def remove_noise(text: Column) -> Column:
    """Runs of dots go, white space becomes one space, ends are trimmed; null gives the empty string."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\.{2,}", ""), f"{WS}+", " "))


def remove_stopwords(text: Column, stop: list[str]) -> Column:
    """Case-sensitive; an empty list only evens out white space."""
    words = split_words(text)
    kept = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    return F.array_join(kept, " ")


def clean_text(text: Column, lowercase: bool = False, stop: list[str] | None = None) -> Column:
    """Lower case, noise, folding, then stop-words, in this order."""
    text = F.lower(text) if lowercase else text
    out = strip(fold(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\.{2,}", ""), f"{WS}+", " ")))
    return remove_stopwords(out, stop) if stop else out


def has_meaning(text: Column) -> Column:
    """any letter, number, punctuation, symbol or mark."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}\p{P}\p{S}\p{M}]"), F.lit(False))


def letter_ratio(text: Column, space: str = WS, none: float = 0.0) -> Column:
    """Q1: letters over visible characters, those that are not ``space``; ``none`` if there is none, null of a null."""
    visible = F.length(F.regexp_replace(text, space, ""))
    return F.when(visible > 0, F.length(F.regexp_replace(text, r"\P{L}", "")) / visible).when(visible == 0, F.lit(none))


def encoded_glyphs(text: Column, space: str = WS) -> Column:
    """Q2: undecoded glyph names, cid marks, or hardly any letter."""
    words = split_words(text, space)
    names = F.size(F.filter(words, lambda w: w.rlike(r"^/[a-zA-Z]{0,4}[0-9]{1,5}\z")))
    n, size = F.size(words), F.length(text)
    cid = size - F.length(F.regexp_replace(text, r"\(cid:\d+\)", ""))
    return F.coalesce(((n >= 8) & (names / n >= 0.4)) | ((size >= 40) & (((cid > 0) & (cid / size >= 0.3)) | (letter_ratio(text, space) < 0.3))), F.lit(False))


def tokens(text: Column) -> Column:
    """Q3: runs of two letters and more."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{Nl}\p{No}]{2,}"), 0)


def two_char_ratio(toks: Column) -> Column:
    return F.when(F.size(toks) > 0, F.size(F.filter(toks, lambda t: F.length(t) == 2)) / F.size(toks)).otherwise(0.0)


def drop_urls(text: Column) -> Column:
    """Q4 without the compatibility folding, for which Spark has no function; see operators.quality.nfkc."""
    return F.regexp_replace(text, r"(?i)\bwww\.\S+|https?://\S+", " ")


def _sign(n: Column) -> Column:
    """The letter of a numeric reference, by the rules of HTML: no zero, no surrogate, Windows letters at 128 to 159."""
    windows = F.array(*[F.lit(unescape(f"&#{c};")) for c in range(128, 160)])
    letter = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(n.isNull(), None).when(bad, F.lit("\ufffd")).when(n.between(128, 159), F.element_at(windows, (n - 127).cast("int"))).otherwise(letter)


def unescaped(text: Column) -> Column:
    """Character references decoded: numeric ones and all names that HTML knows, each up to its semicolon."""
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 9)).try_cast("long")
        sign = F.when(name.startswith("#"), _sign(number)).when(name != "", F.try_element_at(names, name))
        return F.when(sign.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(sign, F.substring(p, F.length(name) + 2, F.length(p))))

    parts = F.split(text, "&", -1)
    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))).otherwise(text)


def html_text(html: Column) -> Column:
    """text nodes, trimmed, joined by a space; comments, scripts, styles and templates give none."""
    cut = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<template\b.*?</template>|<!doctype[^>]*>|</?[a-z][^>]*>", "\x01")
    return F.array_join(F.filter(F.transform(F.split(unescaped(cut), "\x01"), strip), lambda x: x != ""), " ")


def tagged(path: Column, text: Column) -> Column:
    """K7: the text under its path."""
    return F.concat(F.lit('file_path_pwd:"'), path, F.lit('"\n'), text)


def safe_filename(name: Column) -> Column:
    """The last part of a path in either style; ``document`` if nothing is left."""
    last = strip(F.element_at(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1))
    return F.when(last.isin("", ".", ".."), F.lit("document")).otherwise(last)


def is_safe_member(name: Column) -> Column:
    """Relative, without drive letter and without a step upwards."""
    n = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.coalesce(~n.rlike(r"^/|(^|/)\.\.(/|$)|^.:") & (n != ""), F.lit(False))


def walk_key(path: Column) -> Column:
    """Sorts as a sorted walk does: the files of a folder before its sub-folders."""
    return F.transform(F.split(path, "/"), lambda p, i: F.struct((i < F.size(F.split(path, "/")) - 1).alias("d"), p.alias("p")))


def suffix(name: Column) -> Column:
    base = F.element_at(F.split(name, "/"), -1)
    return F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1))


DOCUMENTS = tuple(".pdf .docx .txt .pptx .html .odt .rtf .csv .xml .xlsx .xlsm .xls .ods .dbf .jpg .jpeg .png .tif .tiff".split())
STRUCTURED = tuple(".pdf .docx .xlsx .xlsm .csv".split())
OFFICE = tuple(".docx .xlsx .xlsm .pptx .odt .ods".split())
ARCHIVES = ".zip .jar .cbz .war .ear .rar .cbr .7z .cb7 .gz .bz2 .bz3 .tbz2 .tar .tgz .txz .cbt .iso .udf .deb .rpm .ace .cba .arj .cab .chm .cpio .dms .lha .lzh .lzma .lzo .xz .zst .zoo .adf .alz .arc .shn .rz .lrz .a .z".split()


def magic(content: Column) -> Column:
    """S4 and S5 but for the members of a zip: .pdf .jpg .png .tif .rtf, .zip for any zip; null for the rest."""
    head = F.hex(F.substring(content, 1, 64))
    return (
        F.when(head.startswith("25504446"), ".pdf").when(head.startswith("FFD8FF"), ".jpg").when(head.startswith("89504E470D0A1A0A"), ".png")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), ".tif").when(head.startswith("504B0304"), ".zip")
        .when(head.rlike("^(09|0A|0B|0C|0D|20)*7B5C727466"), ".rtf")
    )
