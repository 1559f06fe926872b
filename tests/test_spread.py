"""Files made of a small table are dealt to all cores, rows travel in batches, and an upload is opened once."""

import io
import zipfile

import pyarrow as pa

from parchment.plans import catalogue as C
from parchment.sources import decode as D


def cores(spark, data, name):
    return C.queries()[name](spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_zip_explode_runs_on_all_cores(spark, data):
    assert cores(spark, data, "zip_explode")


def test_batches_hold_many_rows_and_few_bytes():
    schema = pa.schema([("n", pa.int64())])
    assert [b.num_rows for b in D.in_batches(((i,) for i in range(D.BATCH_ROWS * 2 + 1)), schema, lambda r: 1)] == [D.BATCH_ROWS, D.BATCH_ROWS, 1]
    assert [b.num_rows for b in D.in_batches(((i,) for i in range(3)), schema, lambda r: D.BATCH_BYTES)] == [1, 1, 1]


def test_uploads_are_opened_once_without_a_shuffle(spark, data):
    plan = C.queries()["upload_text"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_xlsx_is_opened_once(spark, data, monkeypatch):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{rel}"><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="s.xml"/></Relationships>')
        z.writestr("xl/s.xml", '<worksheet><sheetData><row><c r="A1"><v>7</v></c></row></sheetData></worksheet>')
    opened, whole = [], zipfile.ZipFile._RealGetContents
    monkeypatch.setattr(zipfile.ZipFile, "_RealGetContents", lambda z: opened.append(1) or whole(z))
    assert D.xlsx_text(buf.getvalue()) == "7 7" and len(opened) == 1


def test_xlsx_decode_runs_on_all_cores(spark, data):
    assert cores(spark, data, "xlsx_decode")


def test_structured_files_runs_on_all_cores(spark, data):
    raw = D.matrices(C._parts(spark, data).selectExpr("concat('f', p_partkey, '.csv') path", "content"))
    assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_docx_decode_runs_on_all_cores(spark, data):
    assert cores(spark, data, "docx_decode")
