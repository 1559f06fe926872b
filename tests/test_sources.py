import io
import tarfile
import zipfile
import zlib

from parchment.operators import archive as A
from parchment.sources import decode as D
from parchment.sources import files as S


def zipped(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in members.items():
            z.writestr(n, b)
    return buf.getvalue()


def explode(spark, name, data, **limits):
    df = spark.createDataFrame([(name, bytearray(data))], "filename string, content binary")
    return [(r.path, None if r.content is None else bytes(r.content), r.reason) for r in A.explode(df, limits=A.Limits(**limits)).orderBy("member_no").collect()]


def test_unsafe_members(spark):
    got = explode(spark, "x.zip", zipped({"../evil.txt": "a", "/abs.txt": "b", "ok.txt": "c"}))
    assert [(p, w) for p, _, w in got] == [("../evil.txt", "unsafe path"), ("/abs.txt", "unsafe path"), ("ok.txt", None)]


def test_limits(spark):
    z = zipped({f"{i}.txt": "x" * 100 for i in range(5)})
    assert [w for _, _, w in explode(spark, "x.zip", z, max_members=3)] == [None] * 3 + ["budget exhausted"]
    assert [w for _, _, w in explode(spark, "x.zip", z, max_member_bytes=50)] == ["member too large"] * 5
    assert [w for _, _, w in explode(spark, "x.zip", z, max_total_bytes=250)] == [None, None, "budget exhausted", "budget exhausted"]


def test_nesting(spark):
    inner = zipped({"a.txt": "deep"})
    for _ in range(3):
        inner = zipped({"n.zip": inner})
    assert any(w and "nested" in w for _, _, w in explode(spark, "x.zip", inner, max_depth=2))
    assert explode(spark, "x.zip", zipped({"n.zip": zipped({"a.txt": "hi"})})) == [("n.zip/a.txt", b"hi", None)]


def test_misnamed(spark):
    docx = zipped({"word/document.xml": "<x/>"})
    assert explode(spark, "a.zip", docx)[0][0] == "a.docx"
    assert explode(spark, "a.pdf", zipped({"in.txt": "x"})) == [("in.txt", b"x", None)]
    assert explode(spark, "a.zip", b"%PDF-1.4")[0][0] == "a.pdf"
    assert explode(spark, "a.bin", b"\x00\x01")[0][2] == "format not supported"


def test_tar_and_links(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        info = tarfile.TarInfo("a.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    assert explode(spark, "x.tgz", buf.getvalue()) == [("a.txt", b"hi", None), ("l", None, "not a regular file")]


def test_decoders():
    assert D.text("é\r\n".encode("latin-1")) == "é\n"
    assert D.csv_text(b'a,"b\nc"\n , \nd,e\n') == "a b\nc d e"
    assert D.html_text(b"<p>a &amp; b<script>x</script><b> c</b><!-- n --></p>") == "a & b c"
    assert D.xml_text(b"<r><a>x</a>tail<b> y </b></r>") == "x y"
    assert D.rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 Ol\'e1 mundo\par fim}").split() == ["Olá", "mundo", "fim"]
    odt = zipped({"content.xml": '<d xmlns:t="u"><t:p>a<t:span>b</t:span>c</t:p><t:p>d</t:p></d>'})
    assert D.odt_text(odt) == "abc d" and D.ods_text(odt) == "ac\nd"
    pptx = zipped({"ppt/slides/slide1.xml": '<s xmlns:p="p" xmlns:a="a"><p:spTree><p:sp><a:p><a:t>Hi</a:t></a:p></p:sp></p:spTree></s>'})
    assert D.pptx_text(pptx) == "Hi"
    dbf = b"\x03\0\0\0" + (1).to_bytes(4, "little") + (65).to_bytes(2, "little") + (6).to_bytes(2, "little") + b"\0" * 20 + b"NAME\0\0\0\0\0\0\0C" + b"\0" * 4 + b"\x05" + b"\0" * 15 + b"\r" + b" hello"
    assert D.dbf_text(dbf) == "NAME: hello"


def test_pdf():
    page = zlib.compress(b"BT /F1 12 Tf (Hello \\(world\\)) Tj 0 -14 Td [(se) -20 (cond) -300 (line)] TJ ET")
    pdf = b"%%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R>> endobj\n4 0 obj <</Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream endobj" % (len(page), page)
    assert D.pdf_pages(pdf) == ["Hello (world)\nsecond line"]


def test_folder_and_errors(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_text("deep")
    (tmp_path / "z.txt").write_text("top")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = S.folder_texts(spark, str(tmp_path)).collect()
    assert [r.tagged for r in got] == ['file_path_pwd:"z.txt"\ntop', 'file_path_pwd:"b/x.txt"\ndeep']


def test_uploads(spark):
    rows = [("..\\a\\x.zip", bytearray(zipped({"a.txt": "one", "s/b.txt": "two"}))), ("e.txt", bytearray(b"")), (None, bytearray(b"\x00\x01"))]
    got = {r.filename: r for r in S.upload_texts(spark.createDataFrame(rows, "filename string, content binary")).collect()}
    assert got["x.zip"].text == 'file_path_pwd:"a.txt"\none\n\nfile_path_pwd:"s/b.txt"\ntwo'
    assert got["e.txt"].text == "" and got["document"].skipped == ["document: format not supported"]


def test_stream(spark, tmp_path):
    from parchment.streaming.files import text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    q = text_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.text for r in spark.table("texts").collect()] == ["hello"]


def test_parser_registry(spark):
    D.add_parser(".foo", lambda b: "foo:" + b.decode())
    try:
        df = spark.createDataFrame([("a.foo", bytearray(b"x")), ("b.unknown", bytearray(b"y"))], "path string, content binary")
        assert {r.path: (r.text, r.error) for r in D.decode(df).collect()} == {"a.foo": ("foo:x", None), "b.unknown": ("", "format not supported")}
    finally:
        D.DECODERS.pop(".foo")
    assert S.capabilities()[".docx"] and not S.capabilities()[".xls"]
