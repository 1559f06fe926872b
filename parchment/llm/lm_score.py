"""Language-model scoring: stupid backoff over n-gram count tables that are partitioned by hash."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ORDER, BACKOFF = 3, 0.4
#: Characters of text in a block of documents, and in what one partition of the count tables has to count.
BLOCK = 8_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd", 1)


class Block:
    """The n-grams of some documents: for each order the hash at each place, and the sorted distinct hashes."""

    def __init__(self, texts: list[str | None], order: int) -> None:
        from xxhash import xxh64_intdigest

        known: dict[str, int] = {}
        sizes, flat = [], []
        for t in texts:
            words = (t or "").lower().split()
            sizes.append(len(words))
            for w in {*words}:
                if w not in known:
                    known[w] = len(known)
            flat += [known[w] for w in words]
        table = np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known), np.uint64, len(known))
        self.sizes = np.array(sizes, np.int64)
        n = len(flat)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.place = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        words = table[np.array(flat, np.int64)] if n else np.zeros(0, np.uint64)
        self.at: list[np.ndarray] = []
        self.types: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        h = words
        for k in range(1, order + 1):
            if k > 1:
                h = np.concatenate((np.zeros(1, np.uint64), h[:-1])) * _MIX + words
                h ^= h >> np.uint64(29)
                h *= _MIX
                h ^= h >> np.uint64(32)
            valid = self.place >= k - 1
            types, at, counts = np.unique(h[valid], return_inverse=True, return_counts=True)
            full = np.full(n, -1, np.int32)
            full[valid] = at
            self.at.append(full)
            self.types.append(types)
            self.counts.append(counts)

    def own_counts(self, k: int) -> np.ndarray:
        """At each place, how often its n-gram stands in the same document."""
        at, out = self.at[k - 1], np.ones(len(self.place), np.int64)
        often = np.flatnonzero((at >= 0) & (np.append(self.counts[k - 1], 0)[at] > 1))
        key = self.doc[often] * max(len(self.types[k - 1]), 1) + at[often]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        out[often] = counts[inverse]
        return out

    def scores(self, totals: list[np.ndarray], backoff: float) -> tuple[np.ndarray, np.ndarray]:
        """By document, the summed log scores without the unigram divisor, and how many words need that divisor.

        An n-gram that stands elsewhere has its context there, as often at least. Where the counts say otherwise, two
        n-grams share a hash: such a place backs off, so no score is above zero and none is infinite.
        """
        n = len(self.place)
        rest = []
        for k, total in enumerate(totals, 1):
            c = np.append(total, 0)[self.at[k - 1]] - self.own_counts(k)
            rest.append(np.where(self.at[k - 1] >= 0, c, 0))
        score, done = np.zeros(n), np.zeros(n, bool)
        top = np.minimum(self.place + 1, len(totals))
        for k in range(len(totals), 1, -1):
            context = np.concatenate((np.zeros(1, np.int64), rest[k - 2][:-1]))
            hit = ~done & (self.place >= k - 1) & (rest[k - 1] > 0) & (rest[k - 1] <= context)
            where = np.flatnonzero(hit)
            score[where] = np.log(rest[k - 1][where] / context[where]) + (top[where] - k) * np.log(backoff)
            done |= hit
        left = np.flatnonzero(~done)
        score[left] = np.log(np.maximum(rest[0][left], 0.5)) + (top[left] - 1) * np.log(backoff)
        docs = len(self.sizes)
        return np.bincount(self.doc, score, docs).astype(np.float64), np.bincount(self.doc[left], minlength=docs)


def _bounds(types: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted hashes of each of ``parts`` equal ranges begin, and the end of the last."""
    first = [-(-(p << 64) // parts) for p in range(1, parts)]
    return np.concatenate(([0], np.searchsorted(types, np.array(first, np.uint64)), [len(types)]))


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers as one compressed string; each is written as planes of bytes, the highest first."""
    out = []
    for n in arrays:
        width = max(1, (int(n.max()).bit_length() + 7) // 8) if len(n) else 1
        out.append(struct.pack("<BI", width, len(n)) + n.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T.tobytes())
    raw = b"".join(out)
    return struct.pack("<I", len(raw)) + _ZSTD.compress(raw, asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = _ZSTD.decompress(data[4:], struct.unpack_from("<I", data)[0], asbytes=True)
    out, at = [], 0
    while at < len(raw):
        width, size = struct.unpack_from("<BI", raw, at)
        planes = np.frombuffer(raw, np.uint8, width * size, at + 5).reshape(width, size)
        n = np.zeros(size, np.uint64)
        for plane in planes:
            n = (n << np.uint64(8)) | plane
        out.append(n)
        at += 5 + width * size
    return out


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one batch and block as one compressed bundle, so their text is shuffled at a fraction of its size."""

    for batch in batches:
        table = pa.table([batch.column(0), batch.column(1)], names=["id", "text"])
        block = batch.column(2).to_numpy()
        order = np.argsort(block, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if len(at):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 7))) as out:
                    out.write_table(table.take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([pa.array([int(block[at[0]])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])


def _unbundled(bundles: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in bundles])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, log_score (natural, summed), mean_log_score.

    The model is all of ``docs``: every n-gram up to ``order`` of lower-cased words between white space is counted.
    Each document is scored by the counts of the others: its own occurrences are taken off. A word unseen elsewhere
    counts as half a word. Null and empty texts have no words, log_score 0 and a null mean. Copies and repeated rows
    are other documents to each other. Other columns are not read, whatever their names. An empty table gives no rows.

    Rows are dealt into blocks whatever they hold, so copies do not meet. A block sends each distinct n-gram once, with
    its count, to the partition of the count table that has the range of its hash, so the most common n-gram arrives
    once a block and not once a word; the partition adds up and answers with counts in the order of the question; the
    block joins them to its places. A block holds ``block`` characters or, if that is more, one text; it takes about
    30 bytes of memory for each. There are as many partitions as blocks, so a message between two holds about
    ``block`` ** 2 / (2 x characters of all texts) n-grams: raise ``block`` with the memory of the executors.

    A 64-bit hash stands for an n-gram: of 10^10 distinct ones two or three pairs share theirs, of 10^13 one in two
    million; what the counts then contradict is not used (see Block.scores). Text travels once, in compressed bundles.
    """
    total = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = total // block + 1
    parts = blocks
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)))
    rows = rows.mapInArrow(_bundles, "block bigint, docs binary").repartition(blocks, "block")

    def ask(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        b = Block(_unbundled(table.column("docs")).column("text").to_pylist(), order)
        ends = [_bounds(t, parts) for t in b.types]
        out = []
        for p in range(parts):
            at = [slice(e[p], e[p + 1]) for e in ends]
            if any(x.start < x.stop for x in at):
                out.append((p, number, _packed([x for t, c, i in zip(b.types, b.counts, at, strict=True) for x in (np.diff(t[i], prepend=np.uint64(0)), c[i])])))
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[]] * 3, schema=asked)

    def answer(table: pa.Table) -> pa.Table:
        given = [_unpacked(x.as_py()) for x in table.column("asked")]
        sums = []
        for k in range(order):
            types = [np.cumsum(x[2 * k]) for x in given]
            _, inverse = np.unique(np.concatenate(types), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([x[2 * k + 1] for x in given])).astype(np.int64)[inverse]
            sums.append(np.split(total, np.cumsum([len(t) for t in types])[:-1]))
        return pa.table([table.column("block"), table.column("part"), pa.array(map(_packed, zip(*sums, strict=True)), pa.binary())], schema=answered)

    def join(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _unbundled(texts.column("docs"))
        b = Block(texts.column("text").to_pylist(), order)
        given = [_unpacked(x.as_py()) for x in answers.sort_by("part").column("totals")]
        s, n = b.scores([np.concatenate([x[k] for x in given]).astype(np.int64) if given else np.zeros(0, np.int64) for k in range(order)], backoff)
        return pa.table([texts.column("id"), pa.array(b.sizes), pa.array(s), pa.array(n.astype(np.int64))], names=["id", "n_tokens", "s", "n"])

    asked = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("asked", pa.binary())])
    answered = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("totals", pa.binary())])
    questions = rows.groupBy("block").applyInArrow(ask, "part bigint, block bigint, asked binary").repartition(parts, "part")
    answers = questions.groupBy("part").applyInArrow(answer, "block bigint, part bigint, totals binary").repartition(blocks, "block")
    found = checkpoint(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, f"id {kind}, n_tokens bigint, s double, n bigint"))
    words = found.agg(F.sum("n_tokens")).first()[0] or 0
    log_score = F.col("s") - F.col("n") * F.log(F.greatest(F.lit(words) - F.col("n_tokens"), F.lit(1)).cast("double"))
    return found.select(F.col("id").alias(id_col), "n_tokens", log_score.alias("log_score"), F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).alias("mean_log_score"))


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
