"""Column functions over cell matrices (array of array of string, cells may be null, rows may be ragged)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNEVEN, one_space, strip

MATRIX = "array<array<string>>"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cell(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def bare(c: Column) -> Column:
    """``cell`` of a cell that is trimmed already; functions that take it as ``of`` are then spared the trimming."""
    return F.coalesce(c, F.lit(""))


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def filled(row: Column, of=cell) -> Column:
    return F.size(F.filter(row, lambda c: of(c) != ""))


def padded(rows: Column) -> Column:
    """Trimmed cells, all rows of one width."""

    def even(r: Column, w: Column) -> Column:
        cells = F.transform(r, cell)
        return F.when(F.size(r) == w, cells).otherwise(F.concat(cells, F.array_repeat(F.lit(""), w - F.size(r))))

    return let(rows, lambda x: let(width(x), lambda w: F.transform(x, lambda r: even(r, w))))


def nulled(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.when(c != "", c)))


def first_cell(row: Column) -> Column:
    return F.replace(cell(F.get(row, F.lit(0))), F.lit(" "), F.lit(""))


def is_data_row(row: Column) -> Column:
    """G1: the first cell is an item number."""
    return first_cell(row).rlike(r"^\d+(?:[.)]\d*)*\.?$")


def header_first(rows: Column) -> Column:
    return F.when(F.size(rows) > 0, ~is_data_row(F.get(rows, F.lit(0)))).otherwise(True)


def drop_empty(rows: Column, of=cell) -> Column:
    """N2."""
    return F.filter(rows, lambda r: F.exists(r, lambda c: of(c) != ""))


def _joined(group: Column) -> Column:
    """Rows of one width joined column by column with a space, empty cells left out."""
    return let(group, lambda g: F.transform(F.get(g, F.lit(0)), lambda _, j: F.array_join(F.filter(F.transform(g, lambda r: F.get(r, j)), lambda c: c != ""), " ")))


def collapse_header(rows: Column, most: int = 6) -> Column:
    """Leading rows that hardly fill their columns, and the first full one after them, become one header."""

    def fold(p: Column) -> Column:
        limit = F.greatest(F.lit(3), F.floor(F.size(F.get(p, F.lit(0))) / 2))

        def ends(r: Column) -> Column:
            text = F.lower(F.array_join(r, " "))
            return is_data_row(r) | text.startswith("valor total") | text.startswith("atenção")

        start = F.struct(F.lit(1).alias("k"), F.lit(False).alias("stop"))
        count = F.aggregate(F.slice(p, 2, most - 1), start, lambda a, r: F.when(a["stop"] | ends(r), F.struct(a["k"].alias("k"), F.lit(True).alias("stop"))).otherwise(F.struct((a["k"] + 1).alias("k"), (filled(r) > limit).alias("stop"))), lambda a: a["k"])
        return let(count, lambda k: F.concat(F.array(_joined(F.slice(p, F.lit(1), k))), F.slice(p, k + 1, F.size(p))))

    return let(rows, lambda x: F.when(F.size(x) > 0, nulled(let(padded(x), lambda p: F.when(F.size(p) < 2, p).otherwise(fold(p))))).otherwise(x))


def merge_continuations(rows: Column) -> Column:
    """A row without first cell goes on in the row before it."""

    def fold(p: Column) -> Column:
        opens = F.transform(p, lambda r, i: (i == 0) | (F.get(r, F.lit(0)) != "") | (filled(r) == 0))
        starts = F.filter(F.transform(opens, lambda o, i: F.when(o, i + 1)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda a, n: _joined(F.slice(p, a, F.coalesce(F.get(s, n + 1), F.size(p) + 1) - a))))

    return let(rows, lambda x: F.when(F.size(x) > 0, nulled(let(padded(x), fold))).otherwise(x))


def normalize(rows: Column, collapse_headers: bool = True, continuations: bool = True) -> Column:
    """N5."""
    out = drop_empty(rows)
    out = collapse_header(out) if collapse_headers else out
    out = merge_continuations(out) if continuations else out
    return drop_empty(out)


def word_splits(rows: Column, of=cell) -> Column:
    """Struct of ratio (null without a sample) and sample: how many neighbouring cells cut a word."""

    def of_row(r: Column) -> Column:
        after = lambda t, i: F.get(t, i + 1)  # noqa: E731  null behind the last cell
        n = lambda t: F.size(F.filter(t, lambda c, i: (c != "") & (after(t, i) != "")))
        cut = lambda t: F.size(F.filter(t, lambda c, i: after(t, i).rlike("^[A-Za-zÀ-ÿ]") & F.substring(c, -1, 1).rlike("[A-Za-zÀ-ÿ]")))
        return let(F.transform(r, of), lambda t: F.struct(cut(t).alias("cut"), n(t).alias("n")))

    sums = F.aggregate(F.transform(rows, of_row), F.struct(F.lit(0).alias("cut"), F.lit(0).alias("n")), lambda a, x: F.struct((a["cut"] + x["cut"]).alias("cut"), (a["n"] + x["n"]).alias("n")))
    return let(sums, lambda s: F.struct(F.when(s["n"] > 0, s["cut"] / s["n"]).alias("ratio"), s["n"].alias("sample")))


def meaningful(rows: Column, min_cols: int = 2, min_rows: int = 2, min_filled: int = 4, max_ratio: float = 0.7, min_sample: int = 8, of=cell) -> Column:
    """A table, and not a box of text."""

    def judge(full: Column) -> Column:
        enough = let(F.transform(full, lambda r: filled(r, of)), lambda n: (F.aggregate(n, F.lit(0), lambda a, x: a + x) >= min_filled) & F.exists(n, lambda x: x >= 2))
        cut = let(word_splits(full, of), lambda s: (s["sample"] >= min_sample) & (F.coalesce(s["ratio"], F.lit(0.0)) > max_ratio))
        return (F.size(full) >= min_rows) & enough & ~cut

    return F.coalesce(let(rows, lambda x: (width(x) >= min_cols) & let(drop_empty(x, of), judge)), F.lit(False))


def signature(rows: Column) -> Column:
    """Width, height and the first four cells of two rows, cut to 200 characters."""
    top = lambda i: F.array_join(F.transform(F.slice(F.get(rows, F.lit(i)), 1, 4), cell), "|")
    text = F.when(F.size(rows) > 1, F.concat(top(0), F.lit("||"), top(1))).when(F.size(rows) == 1, top(0)).otherwise("")
    return F.concat_ws("/", width(rows).cast("string"), F.size(rows).cast("string"), F.substring(text, 1, 200))


def markdown(rows: Column, header: bool = True) -> Column:
    """K1."""

    def line(r: Column, w: Column) -> Column:
        even = F.concat(F.transform(r, lambda c: F.replace(strip(one_space(F.coalesce(c, F.lit("")))), F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), w - F.size(r)))
        return F.concat(F.lit("| "), F.array_join(even, " | "), F.lit(" |"))

    def render(x: Column, w: Column) -> Column:
        rule = F.array(F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), w), " | "), F.lit(" |")))
        names = F.array(F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), w), lambda i: F.concat(F.lit("Col "), i.cast("string"))), " | "), F.lit(" |")))
        lines = F.transform(x, lambda r: line(r, w))
        all_lines = let(lines, lambda l: F.concat(F.slice(l, 1, 1), rule, F.slice(l, 2, F.size(l)))) if header else F.concat(names, rule, lines)
        return F.when(w > 0, F.array_join(all_lines, "\n")).otherwise("")

    return F.coalesce(let(rows, lambda x: let(width(x), lambda w: render(x, w))), F.lit(""))


def page_block(md: Column, page: Column, index: Column) -> Column:
    """K2: one table under its place."""
    return F.concat(F.lit("<!-- table page="), page.cast("string"), F.lit(" index="), index.cast("string"), F.lit(" -->\n"), md)


def html(rows: Column) -> Column:
    """K3."""

    def escaped(c: Column) -> Column:
        c = cell(c)
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(sign), F.lit(name))
        return F.concat(F.lit("<td>"), c, F.lit("</td>"))

    def render(x: Column, w: Column) -> Column:
        lines = F.transform(x, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, escaped), ""), F.repeat(F.lit("<td></td>"), w - F.size(r)), F.lit("</tr>")))
        return F.when(w > 0, F.concat(F.lit("<table>\n"), F.array_join(lines, "\n"), F.lit("\n</table>"))).otherwise("")

    return F.coalesce(let(rows, lambda x: let(width(x), lambda w: render(x, w))), F.lit(""))


def comment(source: Column, page: Column, index: Column, sheet: Column) -> Column:
    """K4."""
    body = F.concat_ws(" ", F.concat(F.lit("source="), source), F.concat(F.lit("page="), page.cast("string")), F.concat(F.lit("index="), index.cast("string")), F.concat(F.lit("sheet="), F.nullif(sheet, F.lit(""))))
    return F.concat(F.lit("<!-- table "), body, F.lit(" -->"))


_FOOTER = r"(?iu)^\s*(?:subtotal|total\s*geral|valor\s*total|aten[çc][ãa]o)\b"


def _body(rows: Column) -> Column:
    """Padded rows that are no footers."""

    def keep(r: Column, i: Column) -> Column:
        def judge(full: Column) -> Column:
            text = F.array_join(full, " ")  # cells are trimmed here, so the text is
            footer = let(text, lambda t: t.rlike(_FOOTER.replace("(?iu)", "(?iuU)")) | ((F.size(full) == 1) & (i > 0) & (F.length(t) > 80) & ~is_data_row(r)))
            return (F.size(full) > 0) & (((i == 0) & ~is_data_row(r)) | ~footer)

        return let(F.filter(r, lambda c: c != ""), judge)

    return F.filter(padded(rows), keep)


def drop_footers(rows: Column) -> Column:
    """G2."""
    return nulled(_body(rows))


_LETTERS = "A-Za-zÁÉÍÓÚÂÊÔÃÕÇáéíóúâêôãõç"


def _settled(text: Column, sign: str, pattern: str) -> Column:
    """``pattern`` replaced by its two groups until nothing changes; a pass that changes anything removes white space.

    ``sign`` is a cheaper pattern that every match of ``pattern`` holds. Mostly one pass settles a text, so the loop over as many
    passes as there is white space is run only for texts that hold ``sign`` after it.
    """

    def step(a: Column, _: Column) -> Column:
        return F.when(a["done"], a).otherwise(let(F.regexp_replace(a["t"], pattern, "$1$2"), lambda x: F.struct(x.alias("t"), (x == a["t"]).alias("done"))))

    def loop(x: Column) -> Column:
        start = F.struct(x.alias("t"), (~x.rlike(pattern)).alias("done"))
        return F.aggregate(F.sequence(F.lit(0), F.regexp_count(x, F.lit(r"\s"))), start, step, lambda a: a["t"])

    once = lambda t: let(F.regexp_replace(t, pattern, "$1$2"), lambda x: F.when(x.rlike(sign), F.when(x == t, x).otherwise(loop(x))).otherwise(x))
    return F.when(text.rlike(sign), once(text)).otherwise(text)


def clean_cell(c: Column, of=cell) -> Column:
    """Rejoin decimals and words that a layout cut off by one sign, however often; a pass joins a whole chain."""
    digits, letters = r"[0-9]\s+[0-9](?![0-9])", rf"[{_LETTERS}]\s+[{_LETTERS}](?![{_LETTERS}])"

    def clean(t: Column) -> Column:
        # Letters and white space exclude each other, so runs are possessive; a place inside a word fails on one sign before \b is asked.
        out = _settled(t, digits, r"(?:([0-9][.0-9]*+,[0-9]++)|\G(?!^))\s+([0-9])(?U:\b)")
        return one_space(let(out, lambda t: _settled(t, letters, rf"(?:(?<![{_LETTERS}])(?U:\b)([{_LETTERS}]{{2,}}+)|\G(?!^))\s+([{_LETTERS}])(?U:\b)")))

    # Most cells hold nothing of the three kinds, which one look tells.
    return let(of(c), lambda t: F.when(t.rlike(f"{digits}|{letters}|{UNEVEN}"), clean(t)).otherwise(t))


def prepare(rows: Column) -> Column:
    """G4."""
    return F.transform(_body(rows), lambda r: F.transform(r, lambda c: F.when(c != "", clean_cell(c, lambda t: t))))


_I = "(?iuU)"
ITEM = _I + r"\b(?:c[óo]d(?:igo)?|n[o°º]\.?|núm(?:ero)?|iten?s?|item)\b"
DESC = _I + r"\b(?:material|servi[çc]o|discrimin|nome do|produto|especifica|descri)"
QTD = _I + r"\b(?:quant|qtd\.?e?)\b"
UND = _I + r"\b(?:u\.?\s*m\.?|und\.?|unid(?:ade)?)\b"
WORKS = _I + r"\b(?:sinapi|insumo|c[óo]digo|servi[çc]o|composi[çc]|especific)\b"
LOT = _I + r"\blotes?\b"
VALUE = _I + r"lance|pre[çc]o|v\.?\s*(?:total|unit)|\bvalor\b"
UNIT_CELL = _I + r"^(?:PÇ|PC|CJ|JG|HR|H|GLB|VB|T|KG|M[23²³]?|ML|L|UNI?D?)$"


def header_row(rows: Column) -> Column:
    return F.when((F.size(rows) > 0) & header_first(rows), F.transform(F.get(rows, F.lit(0)), cell)).otherwise(F.array().cast("array<string>"))


def itemish(rows: Column) -> Column:
    """The header names an item list."""

    def judge(h: Column) -> Column:
        item, desc, qtd, und, works, lot = (h.rlike(p) for p in (ITEM, DESC, QTD, UND, WORKS, LOT))
        return (qtd & ((desc & (item | und)) | (und & (item | works)))) | (lot & (desc | item))

    return F.coalesce(let(F.array_join(header_row(rows), " | "), judge), F.lit(False))


def dense_works(rows: Column) -> Column:
    """A bill of quantities without header."""

    def judge(s: Column) -> Column:
        hits = lambda p: F.size(F.filter(s, lambda r: F.exists(r, p)))
        n = F.size(s)
        unit = hits(lambda c: c.rlike(UNIT_CELL))
        qty = hits(lambda c: c.rlike(r"^(?:\d+(?:[.,]\d+)?|[\d.]+,\d{2})$"))
        long = hits(lambda c: F.length(c) >= 12)
        third, quarter = F.greatest(F.lit(3), F.floor(n / 3)), F.greatest(F.lit(3), F.floor(n / 4))
        return (unit >= quarter) & (qty >= third) & (long >= third)

    return F.coalesce(let(rows, lambda x: (F.size(x) >= 6) & (width(x) >= 3) & let(F.slice(padded(x), 1, 40), judge)), F.lit(False))


def parseable(c: Column, of=cell) -> Column:
    """A digit, or a spelled-out infinity or not-a-number; so neither blank nor a bare currency sign."""
    return let(of(c), lambda t: t.rlike(r"\p{Nd}") | t.rlike(r"(?i)^(?:R\$\s*)?[+-]?(?:nan|inf|infinity)$"))


def score(rows: Column) -> Column:
    """The quality of a table for item extraction."""

    def counts(s: Column) -> Column:
        """What each row is asked, with the columns of the header found once."""
        any_number = lambda r: F.exists(F.when(F.size(r) > 1, F.slice(r, 2, F.size(r))).otherwise(r), lambda c: parseable(c, bare) & ~F.upper(bare(c)).startswith("R$"))
        qty = F.size(F.filter(s["d"], lambda r: F.when(s["qty_at"] > 0, parseable(F.get(r, (s["qty_at"] - 1).cast("int")), bare)).otherwise(any_number(r))))
        value = F.size(F.filter(s["d"], lambda r: F.exists(s["value_at"], lambda i: parseable(F.get(r, i), bare))))
        text = F.array_join(s["h"], " | ")
        auction = text.rlike(LOT) & (text.rlike(DESC) | text.rlike(ITEM))
        return F.struct(s["m"].alias("m"), s["f"].alias("f"), s["i"].alias("i"), F.size(s["d"]).alias("n"), (s["qty_at"] > 0).alias("has_qty"), (F.size(s["value_at"]) > 0).alias("has_value"), qty.alias("qty"), value.alias("value"), auction.alias("auction"))

    def rates(s: Column) -> Column:
        n = s["n"]
        qty = F.when(s["auction"] & ~s["has_qty"], 1.0).when(n == 0, 0.0).otherwise(s["qty"] / n)
        value = F.when(~s["has_value"], 1.0).when(n == 0, 0.0).otherwise(s["value"] / n)
        fine = s["m"] & s["i"] & (n >= 1) & (qty >= 0.5) & (~s["has_value"] | (value >= 0.5) | s["auction"])
        return F.struct(
            s["m"].alias("meaningful"), s["f"].alias("first_row_is_header"), s["i"].alias("has_itemish_header"), n.alias("n_data_rows"),
            F.bround(qty, 3).alias("qty_parse_rate"), F.bround(value, 3).alias("value_parse_rate"), fine.alias("ok_for_items"), (s["m"] & (n >= 3)).alias("has_usable_tables"),
        )

    def judge(w: Column, header_ok: Column) -> Column:
        body = F.filter(F.when(header_ok, F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).otherwise(w), lambda r: F.exists(r, lambda c: c.isNotNull()))
        item = (header_ok & itemish(w)) | dense_works(w)
        qty_at = lambda h: F.array_position(F.transform(h, lambda c: c.rlike(QTD)), True)
        value_at = lambda h: F.filter(F.transform(h, lambda c, i: F.when(c.rlike(VALUE), i)), lambda i: i.isNotNull())
        return let(header_row(w), lambda h: let(F.struct(meaningful(w, of=bare).alias("m"), header_ok.alias("f"), item.alias("i"), h.alias("h"), body.alias("d"), qty_at(h).alias("qty_at"), value_at(h).alias("value_at")), lambda s: let(counts(s), rates)))

    return let(prepare(rows), lambda w: let(header_first(w), lambda f: judge(w, f)))
