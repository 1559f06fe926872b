"""SimHash near-dedup by multi-index hashing over distinct fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, lookup, one_of_each
from .near_copies import SIMILARITY, WIDTH, near_copies

#: Fingerprints link at so many differing bits at most.
RADIUS = 3
#: A segment value with more distinct fingerprints than this is linked through stars and not by pairs.
DENSE = 256
#: So many crowded values are broadcast at most (12 bytes each).
FEW = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, width: int) -> bytes:
    """The 64-bit hashes of all runs of ``width`` words, one after the other; of all words if there are fewer."""
    from xxhash import xxh64_digest

    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width])).tolist()
    return b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text; 0 if it has no word."""
    digests = shingle_hashes(text, width)
    if not digests:
        return 0
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 4096):
        ones += np.unpackbits(raw[at : at + 4096], axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])


def links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """All that is needed to connect distinct fingerprints ``nodes`` (fp: bigint) within three bits: edges (a, b).

    Three differing bits leave at most one of them in one of the two 32-bit segments: each fingerprint looks up the
    33 values of the ball of radius one around each of its segments and the whole distance of what it finds is
    checked. Segment values of over ``dense`` fingerprints would give pairs by the square; among those every point
    that is one flip from some and two flips from others stands for them: what is one flip away links to the least
    such, and so does what is two flips away. Both ways lose no link.
    """
    def seg(c, s):
        return F.shiftrightunsigned(c, 32) if s else c.bitwiseAND(F.lit(0xFFFFFFFF))

    table = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), seg(F.col("fp"), s).alias("v")) for s in (0, 1)])).alias("k")).select("fp", "k.*")
    crowd = table.groupBy("s", "v").count().where(F.col("count") > dense)
    crowd = checkpoint(crowd)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(32)])
    probes = table.select(F.col("fp").alias("a"), "s", F.explode(F.transform(flips, lambda m: F.col("v").bitwiseXOR(m))).alias("v"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("fp")))
    if crowd.isEmpty():
        return probes.join(table, ["s", "v"]).where((F.col("a") < F.col("fp")) & (far <= RADIUS)).select("a", F.col("fp").alias("b"))
    thin = table.join(crowd, ["s", "v"], "left_anti")
    apart = probes.join(F.broadcast(crowd) if crowd.count() <= FEW else crowd, ["s", "v"], "left_anti")
    pairs = apart.join(thin, ["s", "v"]).where((F.col("a") != F.col("fp")) & (far <= RADIUS)).select("a", F.col("fp").alias("b"))
    # Whoever may meet a crowd: its own members, and what has a crowd's value in its ball.
    near = probes.join(crowd.select("s", "v"), ["s", "v"], "left_semi").select(F.col("a").alias("fp")).distinct()
    one = [1 << i for i in range(64)]
    one = [m - (1 << 64) if m >> 63 else m for m in one]
    two = [(1 << i) | (1 << j) for s in (0, 32) for i in range(s, s + 32) for j in range(s, i)]
    two = [m - (1 << 64) if m >> 63 else m for m in two]
    at = [near.select("fp", F.explode(F.array(*map(F.lit, ms))).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("z")) for ms in ([0, *one], two)]
    least = at[0].groupBy("z").agg(F.min("fp").alias("lo"), F.count(F.lit(1)).alias("n"))
    stars = [lookup(x, least, ["z"], "n", "fp").where("lo is not null and lo != fp").select(F.col("lo").alias("a"), F.col("fp").alias("b")) for x in at]
    return pairs.unionByName(stars[0]).unionByName(stars[1])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id (least id reachable).

    Texts that are null or have no word have fingerprint zero and link like any other. Rows with a null id carry the
    least id of their component, null if there is none. Equal fingerprints are one node, so copies are never paired.
    Other columns are not read. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = checkpoint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"id {kind}, fp bigint"))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")))
    roots = checkpoint(components(links(nodes.select("fp"), dense)).select(F.col("node").alias("fp"), "root"))
    linked = nodes.join(roots, "fp")
    whole = linked.groupBy("root").agg(F.min("lo").alias("component"), F.count(F.lit(1)).alias("members"))
    linked = lookup(linked, whole, ["root"], "members", "fp").select("fp", "component")
    nodes = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "lo").alias("component_id"))
    out = lookup(rows, nodes, ["fp"], "n", "id")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, null being the greatest; all columns stay as they are.

    Components are of texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more,
    not of near fingerprints: 64 bits differ in about ten places at 0.8. Another text under an id that goes is not
    touched; of rows alike in id and text one stays. An empty table gives no rows.
    """
    return one_of_each(docs, near_copies(docs, id_col, text_col, width, similarity), id_col, text_col)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
