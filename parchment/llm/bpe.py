"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, without

#: Mean bytes of a chunk; a cut is where the rolling hash of the last 16 bytes has its low bits unset.
MEAN_CHUNK = 1024
#: Bytes of chunks whose ids a worker keeps for later documents; a full store starts anew.
STORE_BYTES = 32 << 20
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: bytes, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Ends of content-defined chunks: they depend on the 16 bytes before them and on nothing else."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        shifted = h[:-k] << np.uint32(k)
        h[k:] += shifted
    return np.flatnonzero((h >> np.uint32(8)) % np.uint32(mean) == 0) + 1


def _settled(data: bytes, at: int) -> int:
    """The next place from ``at`` where the two sides encode as the whole does, or the end.

    That is before a space that follows a byte of visible ASCII: no pre-token goes on over it, none looks past it,
    and no added token of the vocabulary spans it.
    """
    while (at := data.find(b" ", max(at, 1))) >= 0:
        if 33 <= data[at - 1] < 127:
            return at
        at += 1
    return len(data)


def settled_chunks(data: bytes, mean: int = MEAN_CHUNK) -> Iterator[bytes]:
    """``data`` in chunks whose ends are moved on to settled places, for vocabularies whose pre-tokens are not known here."""
    begin = 0
    for cut in cuts(data, mean).tolist():
        if cut <= begin:
            continue
        end = _settled(data, cut)
        if end >= len(data):
            break
        yield data[begin:end]
        begin = end
    if begin < len(data):
        yield data[begin:]


def chunks(data: bytes, mean: int = MEAN_CHUNK) -> Iterator[bytes]:
    """``data`` in chunks that end where the rolling hash says, or at the end of the letter that stands there."""
    begin = 0
    for cut in cuts(data, mean).tolist():
        while cut < len(data) and data[cut] & 0xC0 == 0x80:
            cut += 1
        if begin < cut < len(data):
            yield data[begin:cut]
            begin = cut
    if begin < len(data):
        yield data[begin:]


#: The pre-tokens of byte-level vocabularies. A match depends on nothing before it, and on one letter after it at most.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    """Ids as the tokenizers library gives them from ``path``, and back.

    Where merges rank in the order of ids and no setting of the file asks for more, the same merges run in tiktoken,
    which is several times faster; any other file runs in tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec.get("normalizer") is None and not any(spec["model"].get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        ranks = [vocab[a + b] for a, b in merges]
        plain = plain and ranks == sorted(set(ranks)) and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", []))
        self.encode: Callable[[str], list[int]] = lambda text: self.slow.encode(text, add_special_tokens=False).ids
        self.pieces: list[bytes] | None = None
        if plain:
            import tiktoken

            letter = self._letters()
            known = {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in self.added}
            fast = tiktoken.Encoding("given", pat_str=PRE_TOKEN, mergeable_ranks=known, special_tokens=self.added)
            self.encode = lambda text: fast.encode(text, allowed_special="all")
            self.pieces = [b""] * size
            for token, i in [*known.items(), *((t.encode(), i) for t, i in self.added.items())]:
                self.pieces[i] = token
        self.numerals = [b"%d" % i for i in range(size)]

    @staticmethod
    def _letters() -> dict[str, int]:
        """The byte that each letter of a byte-level vocabulary stands for."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}

    def decode(self, ids: list[int]) -> str:
        if self.pieces is None:
            return self.slow.decode(ids, skip_special_tokens=False)
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", "replace")


class Reuse:
    """Encodes whole texts; a chunk that came before, in whichever document, is not encoded again.

    Chunks are encoded each for itself, so the ids around a join may be others than those of the whole. A join is
    repaired by encoding again from the last pre-token of the left side on, until a pre-token of the text ends where one
    of the right chunk does too: from there on both agree, since a pre-token depends on nothing before it.
    """

    def __init__(self, path: str, mean: int = MEAN_CHUNK, room: int = STORE_BYTES) -> None:
        import regex

        self.codec, self.mean, self.room, self.used, self.hits, self.chunks, self.repairs = Codec(path), mean, room, 0, 0, 0, 0
        self.store: dict[bytes, np.ndarray] = {}
        self.pre = regex.compile(PRE_TOKEN)
        self.added = regex.compile("|".join(map(regex.escape, sorted(self.codec.added, key=len, reverse=True)))) if self.codec.added else None

    def _ids(self, chunk: bytes) -> np.ndarray:
        key = hashlib.blake2b(chunk, digest_size=16).digest()
        part = self.store.get(key)
        self.chunks += 1
        if part is None:
            part = np.array(self.codec.encode(chunk.decode("utf-8", "surrogatepass")), np.uint32)
            if self.used > self.room:
                self.store.clear()
                self.used = 0
            self.used += part.nbytes + 150
            self.store[key] = part
        else:
            self.hits += 1
        return part

    def encode(self, text: str) -> list[int]:
        if len(text) < self.mean // 4:
            return self.codec.encode(text)
        if self.codec.pieces is None:
            return [i for c in settled_chunks(text.encode("utf-8", "surrogatepass"), self.mean) for i in self._ids(c).tolist()]
        if self.added is None or not self.added.search(text):
            return self._joined(text)
        # An added token is one id whatever stands around it, and what is between two is encoded for itself.
        ids, at = [], 0
        for m in self.added.finditer(text):
            ids += self._joined(text[at : m.start()])
            ids.append(self.codec.added[m[0]])
            at = m.end()
        return ids + self._joined(text[at:])

    def _joined(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        parts = [c.decode("utf-8", "surrogatepass") for c in chunks(data, self.mean)]
        if len(parts) < 2:
            return self._ids(data).tolist() if parts else []
        ends = np.cumsum([len(p) for p in parts]).tolist()
        ids: list[int] = []
        done = 0  # all before this letter of the text is encoded; a pre-token begins here
        reach = 0  # the pre-token that stands open goes on to here
        for i, part in enumerate(parts):
            begin, end = ends[i] - len(part), ends[i]
            last = i == len(parts) - 1
            stop = len(text) if last else begin + self._tail(part)
            first = begin
            if reach > stop and not last:
                continue
            if done < begin:
                # The open end of the left side, then whole pre-tokens until one ends where one of this chunk does.
                here, mine = begin, done
                agreed, open_end = None, []
                for m in self.pre.finditer(text, done):
                    mine = m.end()
                    open_end.append(m[0])
                    while here < mine and here < end:
                        here = begin + self.pre.match(part, here - begin).end()
                    if mine == here and mine >= begin:
                        agreed = mine
                        break
                    if mine >= stop:
                        reach = mine
                        break
                self.repairs += 1
                if agreed is None or agreed > stop:
                    if not last:
                        continue  # no agreement within this chunk: the open end grows by it
                    agreed, open_end = len(text), [text[done:]]
                # One by one: a run of white space is one pre-token at the end of a text and two before a letter.
                for piece in open_end:
                    ids += self.codec.encode(piece)
                first = agreed
            if first < stop:
                ids += self._between(part, first - begin, stop - begin)
            done = stop
        return ids

    def _tail(self, part: str) -> int:
        """Where a pre-token of ``part`` begins after which all may change with what follows."""
        at = len(part)
        while (at := part.rfind(" ", 1, at)) > 0:
            if "!" <= part[at - 1] <= "~":
                return at
        begin = 0
        for m in self.pre.finditer(part):
            begin = m.start()
        return begin

    def _between(self, part: str, first: int, stop: int) -> list[int]:
        """The ids of ``part`` between two letters at which pre-tokens begin or end."""
        ids = self._ids(part.encode("utf-8", "surrogatepass")).tolist()
        pieces = self.codec.pieces
        skip = len(part[:first].encode("utf-8", "surrogatepass"))
        a = 0
        while skip > 0:
            skip -= len(pieces[ids[a]])
            a += 1
        drop = len(part[stop:].encode("utf-8", "surrogatepass"))
        b = len(ids)
        while drop > 0:
            b -= 1
            drop -= len(pieces[ids[b]])
        return ids[a:b]


def _per_text(path: str, mean: int, make: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse = Reuse(path, mean)
        for batch in batches:
            yield make(reuse, batch)

    return run


def _ids(reuse: Reuse, batch: pa.RecordBatch) -> pa.RecordBatch:
    # Arrays of each text's ids at once: a batch of Python numbers takes nine times the room.
    ids = [np.array(reuse.encode(t.as_py() or ""), np.int32) for t in batch.column(batch.num_columns - 1)]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "ids"])


def _digests(reuse: Reuse, batch: pa.RecordBatch) -> pa.RecordBatch:
    n, by_ids, by_text = [], [], []
    for t in batch.column(1):
        ids = reuse.encode(t.as_py() or "")
        numerals = reuse.codec.numerals
        n.append(len(ids))
        by_ids.append(hashlib.sha256(b",".join([numerals[i] for i in ids])).hexdigest())
        by_text.append(hashlib.sha256(reuse.codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, mean_chunk: int = MEAN_CHUNK) -> DataFrame:
    """``docs`` with the column ids (array of int) instead of ``text_col``.

    A null or empty text has no ids; long texts are encoded whole. Repeated rows give repeated rows, an empty table
    none. A column named ids is replaced, all others stay as they are.
    """
    rest = [c for c in without(docs, "ids") if c != text_col]
    given = fresh(docs.select(*rest), "_bpe_text")[0]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, F.col(text_col).alias(given)).mapInArrow(_per_text(tokenizer or default_tokenizer(), mean_chunk, _ids), f"{schema}{', ' if rest else ''}ids array<int>")


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``rows`` with the text of ``ids_col`` instead of it; null ids give null, no ids the empty text.

    A column named ``text_col`` is replaced, all others stay as they are. An empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    rest = [c for c in without(rows, text_col) if c != ids_col]
    ids_at = fresh(rows.select(*rest), "_bpe_ids")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = [None if x.as_py() is None else codec.decode(x.as_py()) for x in batch.column(ids_at)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.string())], names=[*rest, text_col])

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in rest)
    return rows.select(*rest, F.col(ids_col).alias(ids_at)).mapInArrow(run, f"{schema}`{text_col}` string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, mean_chunk: int = MEAN_CHUNK) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens and the digests of its ids and of what they decode to.

    Texts are encoded whole; null is empty, with no ids and the digests of the empty string. Repeated rows give
    repeated rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_bpe_text")).mapInArrow(_per_text(tokenizer or default_tokenizer(), mean_chunk, _digests), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
