from pyspark.sql import functions as F

from parchment.functions import tables as M
from parchment.functions import text as T
from parchment.operators import merge as G
from parchment.operators import quality as Q
from parchment.operators import report as R


def value(spark, rows, f):
    df = spark.createDataFrame([(rows,)], "x array<array<string>>")
    return df.select(f(F.col("x")).alias("y")).first()["y"]


def scalar(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_markdown(spark):
    md = value(spark, [["Item", "Qtd"], ["Note|book", "10"], [None, ""]], M.markdown)
    assert md.split("\n") == ["| Item | Qtd |", "| --- | --- |", "| Note\\|book | 10 |", "|  |  |"]
    assert value(spark, [["a", "b"]], lambda r: M.markdown(r, False)).startswith("| Col 1 | Col 2 |")
    assert value(spark, [], M.markdown) == ""


def test_gates(spark):
    assert not value(spark, [["a"], ["b"], ["c"]], M.meaningful)
    assert value(spark, [["a", "1", "x"], ["b", "2", "y"], ["c", "3", "z"]], M.meaningful)
    prose = [["este é um te", "xto que foi cor", "tado em colunas"]] * 5
    assert not value(spark, prose, M.meaningful)
    assert not value(spark, None, M.meaningful)


def test_normalising(spark):
    rows = [["ITEM", "DESC", "QTD"], ["1", "caneta", "3"], ["", "azul", ""], ["2", "papel", "5"]]
    assert value(spark, rows, M.merge_continuations) == [["ITEM", "DESC", "QTD"], ["1", "caneta azul", "3"], ["2", "papel", "5"]]
    head = [["ITEM", "", ""], ["", "DESC", ""], ["", "", "QTD"], ["1.", "x", "3"]]
    assert value(spark, head, M.collapse_header) == [["ITEM", "DESC", "QTD"], ["1.", "x", "3"]]
    assert value(spark, [[None, " "], ["a"]], M.drop_empty) == [["a"]]


def test_items(spark):
    head = "ITEM/DESCRIÇÃO/UND/QUANT/VALOR UNT./VALOR TOTAL".split("/")
    good = [head, ["1", "Caneta esferográfica", "UN", "10", "R$ 1,00", "R$ 10,00"], ["2", "Papel sulfite", "UN", "5", "R$ 2,00", "R$ 10,00"]]
    q = value(spark, good, M.score)
    assert q["ok_for_items"] and q["n_data_rows"] == 2 and q["qty_parse_rate"] == 1.0
    bare = [head] + [[r[0], r[1], "UN", "3", "R$", "R$"] for r in good[1:]]
    q = value(spark, bare, M.score)
    assert not q["ok_for_items"] and q["value_parse_rate"] < 0.5
    lot = ["LOTE/DESCRIÇÃO/VALOR MÍNIMO".split("/"), ["1", "Veículo usado", "R$ 100,00"], ["2", "Moto usada", "R$ 50,00"]]
    assert value(spark, lot, M.score)["ok_for_items"]
    works = [[f"{i}", "Escavação manual de vala", "M3", f"{i},50", "x"] for i in range(1, 12)]
    q = value(spark, works, M.score)
    assert q["ok_for_items"] and not q["first_row_is_header"]


def test_cells(spark):
    assert scalar(spark, "ESTIMATIV A", M.clean_cell) == "ESTIMATIVA"
    assert "99.068,71" in scalar(spark, "R$99.068,7 1", M.clean_cell)
    assert scalar(spark, 'a&b<"\'', lambda c: M.html(F.array(F.array(c)))) == "<table>\n<tr><td>a&amp;b&lt;&quot;&#x27;</td></tr>\n</table>"


def test_cleaner(spark):
    for given, want in (("a  b   c", "a b c"), ("x\n\n\ty", "x y"), ("no..dots...here", "nodotshere"), ("  padded  ", "padded"), ("São  Paulo…", "São Paulo…"), (None, "")):
        assert scalar(spark, given, T.remove_noise) == want
    assert scalar(spark, "Ação à São…", T.clean_text) == "Acao a Sao..."


def test_cipher_tokens(spark):
    def is_bad(t):
        return scalar(spark, t, lambda c: Q.is_cipher(c) & ~Q.is_glued(c))

    assert all(is_bad(t) for t in ("soQdaJHP", "LICITAgAO", "contrataÉo"))
    assert not any(is_bad(t) for t in ("PREGÃO", "edital", "CNPJ", "kW", "ENiCrFe", "ERNiCrMo", "ModelodeProposta", "bateriasparareceptorGNSS"))


def test_encoded(spark):
    assert scalar(spark, "/5 /17 " * 12, T.encoded_glyphs)
    assert scalar(spark, "(cid:8)" * 15, T.encoded_glyphs)
    assert not scalar(spark, "uma frase curta e bem normal que passa de quarenta letras", T.encoded_glyphs)
    assert not scalar(spark, None, T.encoded_glyphs)


def test_rollup(spark):
    cases = {1: ["clean/pypdf"] * 2, 2: ["clean/pypdf", "recovered/poppler"], 3: ["corrupt_unrecoverable/"] * 2, 4: ["clean/pypdf", "corrupt_unrecoverable/"], 5: ["recovered/ocr"] * 3, 6: ["recovered/ocr", "corrupt_unrecoverable/"]}
    rows = [(k, i, *p.split("/"), "x" if "corrupt" in p else "") for k, v in cases.items() for i, p in enumerate(v)]
    df = spark.createDataFrame(rows, "k int, index int, status string, engine string, ocr_error string")
    got = {r.k: r.overall_status for r in R.rollup(df, "k").collect()}
    assert got == {1: "clean", 2: "partially_recovered", 3: "corrupt_unrecoverable", 4: "partially_recovered", 5: "clean", 6: "partially_recovered"}
    assert {r.k: r.overall_status for r in R.rollup(df, "k", demote=False).collect()}[5] == "partially_recovered"


def test_pages_merge_two_by_two(spark):
    rows = [["ITEM", "QTD"], ["1", "2"], ["2", "3"]]
    df = spark.createDataFrame([("d", p, 0, rows) for p in (1, 2, 3)], "doc string, page int, index int, rows array<array<string>>")
    got = [(r["index"], r.page, len(r.rows)) for r in G.merge_pages(df, "doc").orderBy("index").collect()]
    assert got == [(0, 1, 5), (1, 3, 3)]


def plan(spark, f):
    return spark.createDataFrame([], "x array<array<string>>").select(f(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()


def test_header_is_read_once_for_all_rows(spark):
    # twice as columns are found and once to judge the header; it was asked for each row before
    assert plan(spark, M.score).count("quant|qtd") == 2
    assert plan(spark, M.score).count("lance|pre[çc]o") == 1


def test_lines_are_rendered_once(spark):
    assert plan(spark, M.markdown).count("replace(") == 2


def test_signs_that_are_trimmed(spark):
    signs = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(s, f"{s}a{s}b{s}{s}") for s in signs], "s string, t string").select("s", T.strip("t").alias("x"), T.one_space(F.col("t")).alias("y")).collect()
    assert all((r.x, r.y) == ((f"a{r.s}b", " a b ") if r.s.isspace() else (f"{r.s}a{r.s}b{r.s}{r.s}",) * 2) for r in got)


def test_header_is_collapsed_once(spark, data):
    from parchment.plans import catalogue as C

    # the limit of six rows stands in each copy of the rule
    assert C.collapse_header(spark, data)._jdf.queryExecution().optimizedPlan().toString().count("valor total") == 1


def test_rows_are_read_once(spark):
    twice = lambda r: F.concat(r, r)
    assert plan(spark, lambda r: M.drop_footers(twice(r))).count("concat(x#") == 1


def test_order_of_lines_is_not_a_lambda(spark, data):
    from parchment.plans import catalogue as C

    p = C.table_markdown(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in p and "array_sort" not in p


def test_meaningful_reads_rows_once(spark):
    assert plan(spark, lambda r: M.meaningful(F.concat(r, r))).count("concat(x#") == 1


def test_neighbours_are_compared_in_place(spark):
    assert "zip_with" not in plan(spark, lambda r: M.word_splits(r)["ratio"])
    got = value(spark, [["ab", "cd", None, " x", "y "], [], ["1", "a"]], M.word_splits)
    assert (got["ratio"], got["sample"]) == (2 / 3, 3)
