import json

import pytest

from parchment.config import Settings
from parchment.operators import ocr


def test_deadline():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def busy():
        raise ocr.Transient

    with pytest.raises(ocr.Transient):
        ocr.until_deadline(busy, 5.0, sleep=sleep, clock=lambda: now[0], rng=lambda: 1.0)
    assert sum(slept) <= 5.0 and slept[:3] == [0.5, 1.0, 2.0]
    tries = []
    assert ocr.with_backoff(lambda: tries.append(1) or (1 / 0 if len(tries) < 3 else "ok"), sleep=lambda s: None) == "ok"


def test_recognise(spark):
    def engine(image):
        if image == b"no":
            raise ocr.Rejected("BadDocument")
        if image == b"busy":
            raise ocr.Transient
        if image == b"odd":
            raise ValueError
        return image.decode().upper()

    df = spark.createDataFrame([("d", 0, bytearray(b"ab")), ("d", 1, bytearray(b"no")), ("d", 2, bytearray(b"busy")), ("d", 3, bytearray(b"odd")), ("d", 9, bytearray(b"x"))], "doc string, index int, image binary")
    got = [(r["index"], r.text, r.reason) for r in ocr.recognise(df, engine, wait_s=0.0, max_pages=9).orderBy("index").collect()]
    assert got == [(0, "AB", None), (1, "", "rejected:BadDocument"), (2, "", "throttled"), (3, "", "error")]


def test_low_text(spark):
    df = spark.createDataFrame([("a", "x" * 100), ("a", None), ("b", " y ")], "k string, text string")
    assert {r.k: r.low_text for r in ocr.is_low_text(df, "k").collect()} == {"a": False, "b": True}


def test_block_tables(spark):
    def cell(i, r, c, words):
        return {"Id": i, "BlockType": "CELL", "RowIndex": r, "ColumnIndex": c, "Relationships": [{"Type": "CHILD", "Ids": words}] if words else None}

    blocks = [
        {"Id": "t", "BlockType": "TABLE", "Relationships": [{"Type": "CHILD", "Ids": ["c1", "c2", "c3", "c4"]}]},
        cell("c1", 1, 1, ["w1", "w2"]), cell("c2", 1, 2, []), cell("c3", 2, 1, ["w3"]), cell("c4", 2, 2, ["w1"]),
        *({"Id": f"w{i}", "BlockType": "WORD", "Text": t} for i, t in ((1, "b"), (2, "a"), (3, "c"))),
    ]
    df = spark.createDataFrame([(1, json.dumps(blocks)), (2, "[]")], "page int, blocks string")
    got = ocr.block_tables(df, "page", "blocks").collect()
    assert [(r.page, r.rows) for r in got] == [(1, [["b a", ""], ["c", "b"]])]


def test_full_md(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\n"), ("b", "")], "path string, full_md string")
    assert ocr.write_full_md(df, str(tmp_path / "o")) and spark.read.json(str(tmp_path / "o")).count() == 1
    assert not ocr.write_full_md(df.where("path = 'b'"), str(tmp_path / "p"))


def test_settings(tmp_path):
    s = Settings(max_file_bytes=5)
    s.save(str(tmp_path / "a" / "s.json"))
    assert Settings.load(str(tmp_path / "a" / "s.json")) == s
    with pytest.raises(FileNotFoundError):
        Settings.load(str(tmp_path / "none.json"))
