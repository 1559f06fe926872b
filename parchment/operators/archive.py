"""Archive members under a budget: as a relational plan over listed members, and as a table function over bytes."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions.text import OFFICE


@dataclass(frozen=True)
class Limits:
    max_total_bytes: int = 1 << 30
    max_member_bytes: int = 200 << 20
    max_members: int = 500
    max_depth: int = 3


_FORMATS: dict[str, Callable[[bytes], Iterator[tuple[str, bytes]]]] = {}


def add_format(suffix: str, opener: Callable[[bytes], Iterator[tuple[str, bytes]]]) -> None:
    """Members (name, bytes) of archives with a suffix."""
    _FORMATS[suffix.lower()] = opener


def budget(members: DataFrame, root: str, order: list[str], size: str, limits: Limits) -> DataFrame:
    """Adds kept and reason. A member over its own limit is left out; from the first that breaks the count or the sum on, all are.

    The running count and sum are over members within their own limit. A root is one archive, so a window over it is
    as large as one archive's listing.
    """
    fits = F.col(size) <= limits.max_member_bytes
    w = W.partitionBy(root).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    n, total = F.sum(fits.cast("long")).over(w), F.sum(F.when(fits, F.col(size)).otherwise(0)).over(w)
    out = members.withColumn("_over", fits & ((n > limits.max_members) | (total > limits.max_total_bytes)))
    stop = F.max("_over").over(w)
    reason = F.when(stop, "budget exhausted").when(~fits, "member too large")
    return out.withColumn("reason", reason).withColumn("kept", reason.isNull()).drop("_over")


def renamed(paths: DataFrame, root: str, name: str, order: list[str]) -> DataFrame:
    """Dest, the name with _1, _2, ... before its suffix where an earlier file of the root has it.

    Only names that differ in such numbers can meet. Where a root has one name of a kind, its rows are counted;
    where it has several, they are named one after the other, as an extraction does that looks before it writes.
    """
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
    kind = F.concat(F.regexp_replace(stem, r"(_\d+)+$", ""), F.lit("\x00"), ext)
    same = W.partitionBy(root, "_kind")
    seen = paths.withColumn("_kind", kind).withColumn("_mixed", F.min(name).over(same) != F.max(name).over(same))
    n = F.row_number().over(W.partitionBy(root, name).orderBy(*order)) - 1
    plain = seen.where("not _mixed").withColumn("dest", F.when(n > 0, F.concat(stem, F.lit("_"), n.cast("string"), ext)).otherwise(F.col(name)))

    def one_by_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        used, dests, tried = set(), [], {}
        for given in pdf[name]:
            at, k = given, tried.get(given, 0)
            while at in used:
                k += 1
                cut = given.rfind(".") if "." in given.rsplit("/", 1)[-1] else len(given)
                at = f"{given[:cut]}_{k}{given[cut:]}"
            tried[given] = k
            used.add(at)
            dests.append(at)
        return pdf.assign(dest=dests)

    mixed = seen.where("_mixed").groupBy(root, "_kind").applyInPandas(one_by_one, plain.schema)
    return plain.unionByName(mixed).drop("_kind", "_mixed")


def flattened(path: Column) -> Column:
    """A path as one name, its suffix in lower case."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(ext))
    return F.concat(F.rtrim(F.replace(stem, F.lit("/"), F.lit("_")), F.lit("_")), F.lower(ext))


def _safe(name: str) -> bool:
    name = name.replace("\\", "/")
    return bool(name) and not re.search(r"^/|(^|/)\.\.(/|$)|^.:", name)


def _one(open_stream: Callable, strip: tuple[str, ...]) -> Callable:
    def members(data: bytes, name: str) -> Iterator[tuple[str, object]]:
        stem = next((name[: -len(s)] for s in strip if name.lower().endswith(s)), name + ".out")
        yield stem.rsplit("/", 1)[-1] or "member", open_stream(io.BytesIO(data))

    return members


def _zip(data: bytes, name: str) -> Iterator[tuple[str, object]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, z.open(info)


def _tar(data: bytes, name: str) -> Iterator[tuple[str, object]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
        for m in t:
            if m.isfile():
                yield m.name, t.extractfile(m)
            elif not m.isdir():
                yield m.name, None


def opener(name: str, data: bytes, force_zip: bool = False) -> Callable | None:
    low = name.lower()
    for s, given in _FORMATS.items():
        if low.endswith(s):
            return lambda d, _: ((n, io.BytesIO(b)) for n, b in given(d))
    if force_zip or low.endswith((".zip", ".jar", ".cbz", ".war", ".ear")):
        return _zip
    if low.endswith((".tar", ".tgz", ".tar.gz", ".tbz2", ".tar.bz2", ".txz", ".tar.xz", ".cbt")):
        return _tar
    if low.endswith(".gz"):
        return _one(lambda f: gzip.GzipFile(fileobj=f), (".gz",))
    if low.endswith(".bz2"):
        return _one(bz2.BZ2File, (".bz2",))
    if low.endswith((".xz", ".lzma")):
        return _one(lzma.LZMAFile, (".xz", ".lzma"))
    return None


def is_office(data: bytes) -> str | None:
    """S4 for zips: the suffix that the members of an office file betray."""
    if data[:4] != b"PK\x03\x04":
        return None
    try:
        names = {*zipfile.ZipFile(io.BytesIO(data)).namelist()}
    except (zipfile.BadZipFile, OSError):
        return None
    return next((s for m, s in (("word/document.xml", ".docx"), ("xl/workbook.xml", ".xlsx"), ("ppt/presentation.xml", ".pptx")) if m in names), None)


class Expander:
    """Members of one archive, nested ones included, under one budget; streamed, so no stated size is believed."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.members, self.total, self.spent = limits, 0, 0, False

    def expand(self, name: str, data: bytes, depth: int = 0, force_zip: bool = False) -> Iterator[tuple[str, bytes | None, str | None]]:
        """(path, bytes or None, reason why it was skipped)."""
        listing = opener(name, data, force_zip)
        if listing is None:
            yield name, None, "format not supported"
            return
        for member, stream in listing(data, name):
            if self.spent or self.members >= self.limits.max_members:
                self.spent = True
                yield member, None, "budget exhausted"
                return
            if stream is None or not _safe(member):
                yield member, None, "unsafe path" if stream is not None else "not a regular file"
                continue
            chunks, size, reason = [], 0, None
            while chunk := stream.read(1 << 20):
                size += len(chunk)
                if size > self.limits.max_member_bytes:
                    reason = "member too large"
                    break
                if self.total + size > self.limits.max_total_bytes:
                    reason, self.spent = "budget exhausted", True
                    break
                chunks.append(chunk)
            if reason:
                yield member, None, reason
                continue
            body = b"".join(chunks)
            self.members, self.total = self.members + 1, self.total + size
            if opener(member, body) is None or is_office(body):
                yield member, body, None
            elif depth + 1 >= self.limits.max_depth:
                yield member, None, f"nested deeper than {self.limits.max_depth} levels"
            else:
                try:
                    for inner, b, why in self.expand(member, body, depth + 1):
                        yield f"{member}/{inner}", b, why
                except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, RuntimeError):
                    yield member, body, None


def route(name: str, data: bytes, limits: Limits) -> Iterator[tuple[str, bytes | None, str | None]]:
    """Office files whole under their true suffix, archives expanded, misnamed ones by what they are."""
    from parchment.sources.decode import KNOWN, sniff

    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    stem = name[: -len(suffix)] if suffix else name
    office = suffix if suffix in OFFICE else is_office(data)
    if office:
        yield stem + office, data, None
        return
    broken = (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, RuntimeError)
    misnamed = suffix in KNOWN and data[:4] == b"PK\x03\x04"
    if opener(name, data) or misnamed:
        try:
            yield from [*Expander(limits).expand(name, data, force_zip=misnamed)]
            return
        except broken:
            pass
    if suffix in KNOWN:
        yield name, data, None
    elif (found := sniff(data)) in KNOWN:
        yield stem + found, data, None
    else:
        yield name, None, "format not supported"


def explode(uploads: DataFrame, name: str = "filename", content: str = "content", limits: Limits | None = None, root: str | None = None) -> DataFrame:
    """Root, member_no, path, content, reason; one task reads one archive at a time and never writes.

    ``root`` is the column that tells uploads apart, the name if there is none.
    """
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from parchment.sources.decode import by_one, in_batches

        schema = pa.schema([("root", pa.string()), ("member_no", pa.int32()), ("path", pa.string()), ("content", pa.binary()), ("reason", pa.string())])
        rows = ((r, i, *member) for batch in batches for r, n, data in by_one(batch) for i, member in enumerate(route(n, data or b"", limits)))
        return in_batches(rows, schema, lambda r: len(r[3] or b""))

    return uploads.select(F.col(root or name).cast("string").alias("r"), F.col(name).alias("n"), F.col(content).alias("c")).mapInArrow(run, "root string, member_no int, path string, content binary, reason string")
