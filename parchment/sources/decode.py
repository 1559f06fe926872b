"""Format decoders on the standard library: bytes to text, and bytes to cell matrices. None of them raises to a caller."""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that one stream may unpack to.
MAX_STREAM = 120 << 20
#: Rows and rough bytes at which a worker hands a batch on.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch as Python values, one at a time."""
    columns = batch.columns
    return (tuple(c[i].as_py() for c in columns) for i in range(batch.num_rows))


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows packed into batches, so that neither a row has a batch of its own nor a batch grows with its input."""
    out, held = [], 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        held += size(row)
        if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield packed()
            out, held = [], 0
    if out:
        yield packed()


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _zip_xml(data: bytes | zipfile.ZipFile, member: str) -> ET.Element:
    if isinstance(data, bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return _zip_xml(z, member)
    with data.open(member) as f:
        body = f.read(MAX_STREAM + 1)
    if len(body) > MAX_STREAM or b"<!DOCTYPE" in body[:4096]:
        raise ValueError("refused")
    return ET.fromstring(body)


def text(data: bytes) -> str:
    """F1."""
    try:
        out = data.decode("utf-8")
    except UnicodeDecodeError:
        out = data.decode("latin-1")
    return re.sub("\r\n?", "\n", out)


def csv_text(data: bytes) -> str:
    """UTF-8 only."""
    rows = csv.reader(io.StringIO(data.decode("utf-8"), newline=""))
    return " ".join(" ".join(r) for r in rows if any(c.strip() for c in r))


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.buffer: list[str] = []
        self.hidden = 0

    def flush(self) -> None:
        if line := "".join(self.buffer).strip():
            self.found.append(line)
        self.buffer = []

    def handle_starttag(self, tag, attrs) -> None:
        self.flush()
        self.hidden += tag in ("script", "style", "template")

    def handle_startendtag(self, tag, attrs) -> None:
        self.flush()

    def handle_endtag(self, tag) -> None:
        self.flush()
        self.hidden = max(0, self.hidden - (tag in ("script", "style", "template")))

    def handle_comment(self, data) -> None:
        self.flush()

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.buffer.append(data)


def html_text(data: bytes) -> str:
    """F3, by a parser; functions.text.html_text is the same inside the JVM."""
    p = _Nodes()
    p.feed(text(data))
    p.close()
    p.flush()
    return " ".join(p.found)


def xml_text(data: bytes) -> str:
    """texts, not tails."""
    return " ".join(e.text.strip() for e in ET.fromstring(data).iter() if e.text and e.text.strip())


_RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr footnote themedata datastore listtable listoverridetable generator".split())


def rtf_text(data: bytes) -> str:
    """F5."""
    src, out, stack, hide, skip, drop = data.decode("latin-1"), [], [], False, 1, 0
    for m in re.finditer(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n])", src):
        word, arg, code, sign, brace, char = m.groups()
        if brace == "{":
            stack.append((hide, skip))
        elif brace == "}":
            hide, skip = stack.pop() if stack else (False, 1)
        elif sign == "*" or word in _RTF_SKIP:
            hide = True
        elif hide:
            continue
        elif word in ("par", "line", "row", "sect", "page"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "uc":
            skip = int(arg or 1)
        elif word == "u":
            out.append(chr(int(arg or 0) % 65536))
            drop = skip
        elif code:
            if drop:
                drop -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "ignore"))
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif sign == "~":
            out.append("\u00a0")
        elif char:
            if drop:
                drop -= 1
            else:
                out.append(char)
    return "".join(out)


def _w_text(p: ET.Element) -> str:
    return "".join(e.text or "" if _name(e.tag) == "t" else "\t" if _name(e.tag) == "tab" else "\n" if _name(e.tag) in ("br", "cr") else "" for e in p.iter())


def docx_text(data: bytes) -> str:
    """paragraphs of the body itself."""
    body = next(e for e in _zip_xml(data, "word/document.xml") if _name(e.tag) == "body")
    return " ".join(t for t in (_w_text(p) for p in body if _name(p.tag) == "p") if t)


def docx_tables(data: bytes) -> tuple[list[list[list[str]]], str]:
    """Matrices in the order of the document, and the prose."""
    body = next(e for e in _zip_xml(data, "word/document.xml") if _name(e.tag) == "body")
    kids = lambda e, n: [x for x in e if _name(x.tag) == n]
    tables = [[["\n".join(_w_text(p) for p in kids(c, "p")).strip() for c in kids(r, "tc")] for r in kids(t, "tr")] for t in kids(body, "tbl")]
    return tables, "\n".join(x for x in (_w_text(p).strip() for p in kids(body, "p")) if x)


def pptx_text(data: bytes) -> str:
    """shapes directly on a slide."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for _, n in slides:
        tree = next(e for e in _zip_xml(data, n).iter() if _name(e.tag) == "spTree")
        for shape in (e for e in tree if _name(e.tag) == "sp"):
            lines = ["".join(t.text or "" for t in p.iter() if _name(t.tag) == "t") for p in shape.iter() if _name(p.tag) == "p"]
            if any(lines):
                out.append("\n".join(lines))
    return " ".join(out)


def odt_text(data: bytes) -> str:
    """F8."""
    def spell(e: ET.Element) -> str:
        own = {"s": " " * int(next((v for k, v in e.attrib.items() if _name(k) == "c"), 1)), "tab": "\t", "line-break": "\n"}.get(_name(e.tag), e.text or "")
        return own + "".join(spell(x) + (x.tail or "") for x in e)

    return " ".join(spell(p) for p in _zip_xml(data, "content.xml").iter() if _name(p.tag) == "p")


def ods_text(data: bytes) -> str:
    """direct text nodes."""
    return "\n".join((p.text or "") + "".join(x.tail or "" for x in p) for p in _zip_xml(data, "content.xml").iter() if _name(p.tag) == "p")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """Title and rows of each sheet in the order of the workbook; cached values of formulas."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _sheets(z)


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, list[list[str | None]]]]:
    names = {*z.namelist()}
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter() if _name(t.tag) == "t") for si in _zip_xml(z, "xl/sharedStrings.xml")]
    dates: set[int] = set()
    if "xl/styles.xml" in names:
        root = _zip_xml(z, "xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if _name(f.tag) == "numFmt"}
        xfs = next((e for e in root if _name(e.tag) == "cellXfs"), [])
        for i, xf in enumerate(xfs):
            k = int(xf.get("numFmtId", 0))
            if 14 <= k <= 22 or 45 <= k <= 47 or re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, "").lower())):
                dates.add(i)
    targets = {e.get("Id"): e.get("Target") for e in _zip_xml(z, "xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in (e for e in _zip_xml(z, "xl/workbook.xml").iter() if _name(e.tag) == "sheet"):
        target = targets[next(v for k, v in sheet.attrib.items() if _name(k) == "id" and k != "sheetId")]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        rows = []
        for r in (e for e in _zip_xml(z, path).iter() if _name(e.tag) == "row"):
            row: list[str | None] = []
            for c in (e for e in r if _name(e.tag) == "c"):
                at = _column(c.get("r")) if c.get("r") else len(row)
                row += [None] * (at + 1 - len(row))
                kind, v = c.get("t", "n"), next((x.text for x in c if _name(x.tag) == "v"), None)
                if kind == "inlineStr":
                    row[at] = "".join(t.text or "" for t in c.iter() if _name(t.tag) == "t")
                elif v is None:
                    continue
                elif kind == "s":
                    row[at] = shared[int(v)]
                elif kind == "b":
                    row[at] = "True" if v == "1" else "False"
                elif kind == "n" and int(c.get("s", -1)) in dates:
                    row[at] = str(datetime(1899, 12, 30) + timedelta(days=float(v)))
                elif kind == "n":
                    row[at] = str(int(float(v))) if re.fullmatch(r"-?\d+(\.0+)?", v) else str(float(v))
                else:
                    row[at] = v
            rows.append(row)
        out.append((sheet.get("name"), rows))
    return out


def xlsx_text(data: bytes) -> str:
    """F10."""
    return " ".join(c for _, rows in xlsx_sheets(data) for r in rows for c in r if c is not None)


def dbf_text(data: bytes) -> str:
    """name and value of each field of each record that is not deleted."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while at + 32 <= head and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(data[at + 11]), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        rec = data[head + i * size : head + (i + 1) * size]
        if rec[:1] != b" ":
            continue
        at = 1
        for name, kind, width in fields:
            raw = rec[at : at + width].decode("latin-1").strip()
            at += width
            value: object = raw
            if kind in "NF":
                value = None if not raw else float(raw) if "." in raw else int(raw)
            elif kind == "D":
                value = f"{raw[:4]}-{raw[4:6]}-{raw[6:8]}" if raw else None
            elif kind == "L":
                value = {"T": True, "Y": True, "F": False, "N": False}.get(raw.upper())
            out.append(f"{name}: {value}")
    return " ".join(out)


_PDF_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)


def pdf_pages(data: bytes) -> list[str]:
    """P1 in its simplest form: show-text operators of each page in page order; flate streams and ToUnicode maps."""
    objects = {int(m[1]): m[3] for m in _PDF_OBJ.finditer(data)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1], MAX_STREAM) if b"FlateDecode" in body[: m.start()] else m[1]

    for body in [*objects.values()]:
        if b"/ObjStm" in body:
            raw, first = stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = [*map(int, raw[:first].split())]
            for k in range(0, len(heads), 2):
                end = heads[k + 3] if k + 3 < len(heads) else len(raw) - first
                objects.setdefault(heads[k], raw[first + heads[k + 1] : first + end])

    def ref(body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def cmap(font: bytes) -> dict[bytes, str]:
        out: dict[bytes, str] = {}
        for n in ref(font, b"ToUnicode"):
            src = stream(objects.get(n, b""))
            put = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", src, re.S):
                out |= {bytes.fromhex(a.decode()): put(b) for a, b in re.findall(rb"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>", block)}
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", src, re.S):
                for a, b, c in re.findall(rb"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>", block):
                    width, lo, hi, to = len(a) // 2, int(a, 16), int(b, 16), int(c, 16)
                    out |= {(lo + i).to_bytes(width, "big"): chr(to + i) for i in range(min(hi - lo + 1, 65536))}
        return out

    def pages(n: int, seen: frozenset = frozenset()) -> Iterator[int]:
        body = objects.get(n, b"")
        if n in seen:
            return
        if re.search(rb"/Type\s*/Pages\b", body):
            for k in ref(body, b"Kids"):
                yield from pages(k, seen | {n})
        elif re.search(rb"/Type\s*/Page\b", body):
            yield n

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
    out = []
    for page in (p for r in sorted(roots) for p in pages(r)):
        body = objects[page]
        res = body + b"".join(objects.get(n, b"") for n in ref(body, b"Resources"))
        fonts = {m[1]: cmap(objects.get(int(m[2]), b"")) for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", res)}
        src = b"\n".join(stream(objects.get(n, b"")) for n in ref(body, b"Contents"))
        lines, line, font = [], [], {}
        for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+[\d.]+\s+Tf|\(((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)|<([0-9a-fA-F\s]*)>|(-?[\d.]+)(?=[^\]]*\]\s*TJ)|(\bT[dDm*]|\bET\b|['\"](?=\s))", src, re.S):
            name, literal, hexed, kern, move = m.groups()
            if name is not None:
                font = fonts.get(name, {})
            elif move:
                if line:
                    lines.append("".join(line))
                line = []
            elif kern is not None:
                if float(kern) < -200:
                    line.append(" ")
            else:
                raw = bytes.fromhex(re.sub(rb"\s", b"", hexed).decode().ljust(len(hexed) + len(hexed) % 2, "0")) if hexed is not None else re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)", lambda e: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e[1], bytes([int(e[1], 8) & 255]) if e[1].isdigit() else e[1].strip()), literal)
                width = len(next(iter(font), b"x"))
                line.append("".join(font.get(raw[i : i + width], "") for i in range(0, len(raw), width)) if font else raw.decode("cp1252", "replace"))
        if line:
            lines.append("".join(line))
        out.append("\n".join(lines))
    return out


def pdf_text(data: bytes) -> str:
    return "\n".join(pdf_pages(data))


def refused(data: bytes) -> str:
    raise ValueError("no decoder for this format here")


#: S3: decoders by suffix. Images need an OCR engine, and .xls a reader of its own: register one.
DECODERS: dict[str, Callable[[bytes], str]] = {
    ".txt": text, ".csv": csv_text, ".html": html_text, ".xml": xml_text, ".rtf": rtf_text, ".docx": docx_text, ".pptx": pptx_text, ".odt": odt_text, ".ods": ods_text, ".xlsx": xlsx_text, ".xlsm": xlsx_text, ".dbf": dbf_text, ".pdf": pdf_text,
    ".xls": refused, ".jpg": refused, ".jpeg": refused, ".png": refused, ".tif": refused, ".tiff": refused,
}
KNOWN = frozenset(DECODERS)


def add_parser(suffix: str, decoder: Callable[[bytes], str]) -> None:
    """S10; the functions are sent to the executors with each plan."""
    DECODERS[suffix.lower()] = decoder


def sniff(data: bytes) -> str | None:
    """A suffix from the first bytes."""
    from parchment.operators.archive import is_office

    head = data[:64]
    for sign, suffix in ((b"\x89PNG\r\n\x1a\n", ".png"), (b"\xff\xd8\xff", ".jpg"), (b"%PDF", ".pdf"), (b"II*\0", ".tif"), (b"MM\0*", ".tif")):
        if head.startswith(sign):
            return suffix
    return ".rtf" if head.lstrip().startswith(b"{\\rtf") else is_office(data)


def csv_rows(data: bytes) -> list[list[str]]:
    """X1."""
    for encoding in ("utf-8-sig", "latin-1"):
        try:
            rows = csv.reader(io.StringIO(data.decode(encoding), newline=""))
            return [r for r in rows if any(c.strip() for c in r)]
        except UnicodeDecodeError:
            continue
    return []


def _decode(name: str, data: bytes, decoders: dict) -> tuple[str, str | None]:
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    decoder = decoders.get(suffix) or decoders.get(sniff(data) or "")
    if decoder is None:
        return "", "format not supported"
    try:
        return decoder(data), None
    except Exception as e:  # noqa: BLE001  a bad file must not end the job; its row says why
        return "", f"{type(e).__name__}: {e}"[:200]


def decode(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """S1 without the tag: path, text, error for each row. Bytes stay out of every shuffle."""
    decoders = dict(DECODERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, *_decode(p, c or b"", decoders)) for batch in batches for p, c in by_one(batch))
        return in_batches(rows, pa.schema([("path", pa.string()), ("text", pa.string()), ("error", pa.string())]), lambda r: len(r[1]))

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, "path string, text string, error string")


def matrices(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Path, source, index, sheet, rows, prose; one row for each raw table, and one without rows if there is none."""

    def tables(name: str, data: bytes) -> list[tuple]:
        low = name.lower()
        if low.endswith(".csv"):
            return [("csv", 0, None, csv_rows(data), None)]
        if low.endswith((".xlsx", ".xlsm")):
            return [("xlsx", i, t, [r for r in rows if any((c or "").strip() for c in r)], None) for i, (t, rows) in enumerate(xlsx_sheets(data))]
        if low.endswith(".docx"):
            found, prose = docx_tables(data)
            return [("docx", i, None, rows, prose) for i, rows in enumerate(found)] or [("docx", 0, None, None, prose)]
        return []

    def found(p: str, c: bytes) -> list[tuple]:
        try:
            return tables(p, c) or [(None, 0, None, None, None)]
        except Exception:  # noqa: BLE001  a bad file is an empty document
            return [(None, 0, None, None, None)]

    cells = pa.list_(pa.list_(pa.string()))
    schema = pa.schema([("path", pa.string()), ("source", pa.string()), ("index", pa.int32()), ("sheet", pa.string()), ("rows", cells), ("prose", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, *t) for batch in batches for p, c in by_one(batch) for t in found(p, c or b""))
        return in_batches(rows, schema, lambda r: sum(len(c or "") + 8 for row in r[4] or () for c in row) + len(r[5] or ""))

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, "path string, source string, index int, sheet string, rows array<array<string>>, prose string")
