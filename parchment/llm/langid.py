"""Language identification: script ranges, per-word scores, and Viterbi spans with a switching penalty."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of each language that the model is fitted on, in expectation; whole texts of a hash-chosen sample.
PER_LANG = 1500
#: Cells of the model in all: hashed n-grams x languages.
CELLS = 1 << 19
#: Nats that a change of language costs.
SWITCH = 9.0
#: N-grams of a word overlap, so their evidence is scaled.
SCALE = 0.35
#: Words whose scores a worker keeps; a full store starts anew.
STORE = 200_000
_ASCII, _ALNUM = re.compile(r"[a-z]+"), re.compile(r"[^\W\d_]+")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Marks, which belong to words, and signs that stand for numbers, which ``_ALNUM`` takes for letters; all above U+FFFF.
_SPECIAL = re.compile("[%s\U00010000-\U0010ffff]" % "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) in ("Mn", "Mc", "Me", "Nl", "No")))
#: First code points of script ranges; words in ranges of one name are of one script.
_RANGES = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han")]
_STARTS = [a for a, _ in _RANGES]


def words_of(text: str) -> list[str]:
    """The words of a text in lower case: a letter and the letters and marks after it."""
    text = text.lower()
    if text.isascii():
        return _ASCII.findall(text)
    return (_WORDS if _SPECIAL.search(text) else _ALNUM).findall(text)


def script(word: str) -> str:
    return _RANGES[bisect_right(_STARTS, ord(word[0])) - 1][1]


def _grams(words: list[str], cells: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where each word begins among the letters of all, and by order of n-gram the cell at each letter and whether it holds.

    Orders are one to four letters with the ends of a word marked, and the word itself at its first letter.
    """
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    step = np.uint32(0x9E3779B1)
    h, out = codes * step, []
    for n in range(1, 5):
        if n > 1:
            h = h[:-1] * np.uint32(31) + codes[n - 1 :] * step if len(h) > 1 else h[:0]
            h ^= h >> np.uint32(15)
        at = np.zeros(len(codes), np.int64)
        at[: len(h)] = (h + np.uint32(n * 77)) % np.uint32(cells)
        out.append((at, left >= n))
    place = np.arange(len(codes), dtype=np.uint32) - np.repeat(starts, sizes).astype(np.uint32)
    whole = np.add.reduceat((codes + np.uint32(1)) * (place * np.uint32(2654435761) + step | np.uint32(1)), starts) if words else np.zeros(0, np.uint32)
    whole ^= whole >> np.uint32(13)
    at, holds = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at[starts], holds[starts] = (whole * step) % np.uint32(cells), True
    out.append((at, holds))
    return starts, out


class Model:
    """Log-probabilities of n-gram cells (cells x languages), priors, and the languages that each script admits."""

    def __init__(self, langs: list[str], counts: np.ndarray, words: np.ndarray, docs: np.ndarray, scripts: dict[str, np.ndarray]) -> None:
        self.langs, self.cells = langs, counts.shape[0]
        total = counts.sum(0)
        smooth = 0.5
        self.logp = np.log((counts + smooth) / (total + smooth * self.cells)).astype(np.float32)
        self.prior = np.log((docs + 1) / (docs.sum() + len(langs))).astype(np.float64)
        self.admits = {}
        for name, n in scripts.items():
            share = n / np.maximum(words, 1)
            self.admits[name] = (share >= 0.001) | (share >= share.max() * 0.05)

    def scores(self, words: list[str]) -> np.ndarray:
        """Words x languages; zeros for a script that no language was seen in."""
        starts, orders = _grams(words, self.cells)
        total = np.zeros((len(words), len(self.langs)), np.float32)
        for at, holds in orders:
            part = self.logp[at]
            part[~holds] = 0
            total += np.add.reduceat(part, starts, axis=0)
        total *= SCALE
        total -= total.max(1, keepdims=True)
        every = np.ones(len(self.langs), bool)
        kinds = [script(w) for w in words]
        admits = np.array([self.admits.get(k, every) for k in kinds])
        unseen = np.array([k not in self.admits for k in kinds])
        total = np.where(admits, total, np.float32(-40))
        total[unseen] = 0
        return total


def viterbi(scores: np.ndarray, start: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word: sum of scores less ``switch`` for each change; ties stay, then take the first."""
    n, k = scores.shape
    total = scores.sum(0, dtype=np.float64) + start
    top = int(total.argmax())
    if n:
        # No language beats the top one over all words. A path that uses the top one has as many changes as runs of
        # others, so it pays only if some run gains a change. A path of m runs of others alone pays m - 1 changes;
        # where no run gains one, its first and last run together have to.
        gain = np.cumsum(scores.astype(np.float64) - scores[:, [top]].astype(np.float64), axis=0)
        gain[:] += start - start[top]
        low = np.minimum.accumulate(np.vstack((np.zeros(k), gain[:-1])), axis=0)
        low = np.minimum(low, np.minimum(0, start - start[top]))
        if (gain - low).max() < switch and gain[:-1].max(initial=0.0) + (gain[-1] - low[-1]).max() < switch:
            return np.full(n, top, np.int32)
    rows, best, back = scores.tolist(), start.tolist(), []
    best = [x + y for x, y in zip(best, rows[0], strict=True)]
    for row in rows[1:]:
        most = max(best)
        lead, jump = best.index(most), most - switch
        back.append([i if x >= jump else lead for i, x in enumerate(best)])
        best = [(x if x >= jump else jump) + y for x, y in zip(best, row, strict=True)]
    at = best.index(max(best))
    path = [at]
    for b in reversed(back):
        at = b[at]
        path.append(at)
    return np.array(path[::-1], np.int32)


class Tagger:
    def __init__(self, model: Model, switch: float) -> None:
        self.model, self.switch = model, switch
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((4096, len(self.model.langs)), np.float32)

    def __call__(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language of most letters, their share, and spans of words (first, past the last, language)."""
        words = words_of(text or "")
        if not words or not self.model.langs:
            return "und", 0.0, []
        if len(self.known) > STORE:
            self.reset()
        known = self.known
        new = [w for w in {*words} if w not in known]
        if new:
            scores = self.model.scores(new)
            begin = len(known)
            while begin + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.empty_like(self.table)))
            self.table[begin : begin + len(new)] = scores
            known.update(zip(new, range(begin, begin + len(new)), strict=True))
        path = viterbi(self.table[[known[w] for w in words]], self.model.prior, self.switch)
        letters = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(self.model.langs))
        top = int(letters.argmax())
        ends = [*(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        spans = [(a, b, self.model.langs[path[a]]) for a, b in zip([0, *ends], ends, strict=False)]
        return self.model.langs[top], float(letters[top] / letters.sum()), spans


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """Learn from rows with a language, a text and an id: about ``per_lang`` of each language, chosen by the hash of their id.

    Every language is learned; the model has 2^19 cells, or 4096 for each language if that is more. Texts without a
    word teach nothing. Without any row nothing is learned, and ``identify`` answers ``und``.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    seen = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    langs = sorted(seen)
    if not langs:
        return Model([], np.zeros((1, 0)), np.zeros(0), np.zeros(0), {})
    cells = 1 << max(12, (CELLS // len(langs)).bit_length() - 1)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / seen[k])))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("langid"), id_col), F.lit(1_000_000)) < F.try_element_at(share, F.col(lang_col).cast("string")) * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {k: i for i, k in enumerate(langs)}
        counts = np.zeros((len(langs), cells))
        scripts: dict[tuple[str, int], int] = {}
        tally: list[Counter] = [Counter() for _ in langs]

        def put(k: int) -> None:
            words, n = [*tally[k]], np.array([*tally[k].values()], float)
            starts, orders = _grams(words, cells)
            by_letter = np.repeat(n, np.fromiter(map(len, words), np.int64, len(words)) + 2)
            for cell, holds in orders:
                counts[k] += np.bincount(cell[holds], by_letter[holds], cells)
            for w, m in tally[k].items():
                s = (script(w), k)
                scripts[s] = scripts.get(s, 0) + m
            tally[k].clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = at[lang]
                tally[k].update(words_of(text))
                if len(tally[k]) > STORE:
                    put(k)
        for k in range(len(langs)):
            if tally[k]:
                put(k)
        k, cell = np.nonzero(counts)
        kinds = [*(["gram"] * len(cell)), *(s for s, _ in scripts)]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([*cell.tolist(), *[0] * len(scripts)], pa.int32()), pa.array([*k.tolist(), *(k for _, k in scripts)], pa.int32()), pa.array([*counts[k, cell].astype(int).tolist(), *scripts.values()], pa.int64())], names=["kind", "cell", "lang", "n"])

    table = chosen.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(count, "kind string, cell int, lang int, n bigint")
    sums = table.groupBy("kind", "cell", "lang").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((cells, len(langs)))
    g = sums[sums.kind == "gram"]
    counts[g.cell.to_numpy(), g.lang.to_numpy()] = g.n.to_numpy()
    scripts: dict[str, np.ndarray] = {}
    for kind, k, n in sums.loc[sums.kind != "gram", ["kind", "lang", "n"]].itertuples(index=False):
        scripts.setdefault(kind, np.zeros(len(langs)))[k] = n
    words = sum(scripts.values()) if scripts else np.zeros(len(langs))
    return Model(langs, counts, words, np.array([seen[k] for k in langs], float), scripts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """id, lang_pred, score, spans for each row of ``docs``; only the text decides.

    ``und`` with score 0 and no span where the text is null or has no letter, or nothing was learned. The score is
    the share of letters in spans of lang_pred; of equal shares the first language in order of names wins. Whole
    texts are read, however long. Other columns are not read; repeated rows give repeated rows, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = Tagger(shared.value, switch)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            found = [tag(t.as_py()) for t in batch.column(1)]
            spans = [[{"first": a, "past": b, "lang": k} for a, b, k in s] for _, _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), pa.array(spans, kind)], names=["id", "lang_pred", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, spans array<struct<first: int, past: int, lang: string>>")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
