"""Text-layer detectors over token windows, lexicon rates, and the choice among recovery candidates."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parchment.functions import text as T

WINDOW, STEP, MIN_CIPHER, MIN_FRAGMENT = 400, 200, 80, 60
#: Above this many words a lexicon is joined by shuffle; up to it each worker has it as a set and nothing is shuffled.
BROADCAST_WORDS = 1_000_000
#: Rows of a batch that a worker holds as Python lists at a time, and answers it remembers.
SLICE, SEEN = 32, 100_000


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility folding, for which Spark has no function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def starts(toks: Column, window: int = WINDOW, step: int = STEP) -> Column:
    """Q6: where windows begin; the tail after the last whole step has none."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(toks) - window), F.lit(step))


def windows(docs: DataFrame, key: str, toks: str, least: int) -> DataFrame:
    """key, start, seg for each window of documents with ``least`` tokens and more."""
    return docs.where(F.size(toks) >= least).select(key, F.explode(starts(F.col(toks))).alias("start"), toks).select(key, "start", F.slice(toks, F.col("start") + 1, WINDOW).alias("seg"))


def is_cipher(tok: Column) -> Column:
    """Q7 without the lexicon: a capital after a small letter, from the third letter on; alloy codes excepted."""
    return (F.length(tok) >= 4) & ~tok.rlike(r"^ER?(?:[A-Z]|[A-Z][a-z]){2,}[-0-9]*$") & tok.rlike(r"^..*?(?<=\p{Ll})\p{Lu}") & (F.regexp_extract(tok, r"^.+?\p{Ll}(\p{Lu}.*)$", 1) != "")


def cipher_tail(tok: Column) -> Column:
    """What stands from the capital on; a word of the lexicon there excuses the token."""
    return F.regexp_extract(tok, r"^.+?\p{Ll}(\p{Lu}.*)$", 1)


_VOWEL = "aeiouyàáâãäåéêëíîïóôõöúûü"


def _word_shaped(seg: Column) -> Column:
    core = F.regexp_replace(seg, r"^(?:[A-Z]{2,6})(?=[à-ÿa-z])", "")
    low = F.lower(core)
    letters = F.length(F.regexp_replace(core, r"\P{L}", ""))
    vowels = F.length(F.regexp_replace(low, f"[^{_VOWEL}]", ""))
    begins = ~core.rlike(r"^[À-Þ]") & (low.rlike(f"^.?[{_VOWEL}]") | F.substring(low, 1, 2).isin(*"bl br ch cl cr dr fl fr gl gn gr lh mn nh pl pr ps tr vr".split()))
    return (F.length(core) >= 4) & begins & (vowels >= 0.28 * letters) & ~low.rlike(rf"(?:(?![{_VOWEL}])\p{{L}}){{5,}}")


def is_glued(tok: Column) -> Column:
    """Whole words that only lack their spaces."""
    cut = F.split(F.regexp_replace(tok, r"(?<=\p{Ll})(?=M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$)[MDCLXVI]+$", ""), r"(?<=\p{Ll})(?=\p{Lu})")
    good = F.filter(cut, _word_shaped)
    long = F.exists(good, lambda s: F.length(s) >= 10) & F.exists(cut, lambda s: s.rlike("^(?:[A-Z]{2,6})$"))
    return (F.length(tok) >= 8) & (F.size(cut) >= 2) & ((F.size(good) >= 2) | long)


def folded(word: Column) -> Column:
    """Q12."""
    return T.fold(F.lower(word))


def with_hits(words: DataFrame, lexicon: DataFrame, column: str) -> DataFrame:
    """``words`` with hit: whether the folded ``column`` is in ``lexicon`` (word), which may be of any size."""
    known = lexicon.select(F.col("word").alias("_w")).distinct().withColumn("hit", F.lit(True))
    return words.join(known, folded(F.col(column)) == F.col("_w"), "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("_w")


def _small(lexicon: DataFrame) -> frozenset[str] | None:
    """The words of a lexicon that has no more than BROADCAST_WORDS, else None."""
    words = lexicon.select("word").where("word is not null").distinct().limit(BROADCAST_WORDS + 1).toPandas()["word"]
    return frozenset(words) if len(words) <= BROADCAST_WORDS else None


class _Known:
    """Whether tokens, once folded, are in a set of words; remembers what it was asked."""

    def __init__(self, words: frozenset[str]) -> None:
        self.words, self.seen, self.table = words, {}, T.fold_table()

    def __call__(self, tok: str) -> bool:
        hit = self.seen.get(tok)
        if hit is None:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            hit = self.seen[tok] = tok.lower().translate(self.table) in self.words
        return hit


def _windows(n: int) -> range:
    return range(0, max(0, n - WINDOW) + 1, STEP)


def _by_document(docs: DataFrame, keys: list[str], columns: list[Column], known: frozenset[str], schema: str, judge: Callable, least: int = 0) -> DataFrame:
    """One Arrow pass without a shuffle: ``judge`` sees the token arrays of one document at a time.

    Rows whose first array has fewer than ``least`` tokens are left out. Arrays become Python lists a few rows at a time, so what a
    worker holds does not follow the batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    given = docs.select(*keys, *[c.alias(f"_{i}") for i, c in enumerate(columns)])
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"double": pa.float64(), "boolean": pa.bool_()}

    def rows(hit: _Known, batch: pa.RecordBatch) -> Iterator[tuple | None]:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            for x in zip(*[c.to_pylist() for c in part.columns[len(keys) :]], strict=True):
                yield judge(hit, *x) if not least or len(x[0] or ()) >= least else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = _Known(shared.value)
        for batch in batches:
            got = [*rows(hit, batch)]
            kept = pa.array([r is not None for r in got], pa.bool_())
            got = [r for r in got if r is not None]
            made = [pa.array([r[i] for r in got], kinds[k]) for i, (_, k) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*[c.filter(kept) for c in batch.columns[: len(keys)]], *made], names=[*keys, *[n for n, _ in fields]])

    types = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return given.mapInArrow(run, f"{types}, {schema}")


def _fragmented(hit: _Known, toks: list[str]) -> tuple[float, bool]:
    score, flag = 0.0, False
    for at in _windows(len(toks)):
        seg = toks[at : at + WINDOW]
        two = [t for t in seg if len(t) == 2]
        if two and sum(map(hit, two)) / len(two) >= 0.6:
            score, flag = max(score, len(two) / len(seg)), flag or len(two) / len(seg) >= 0.5
    return score, flag


def _ciphered(hit: _Known, toks: list[str], tails: list[str | None]) -> tuple[float, bool]:
    score, flag = 0.0, False
    bad = [x is not None and not (len(x) >= 3 and hit(x)) for x in tails]
    known = [hit(t) for t in toks] if any(bad) else []
    for at in _windows(len(toks)):
        if not any(bad[at : at + WINDOW]):
            continue
        size = len(toks[at : at + WINDOW])
        of = Counter(t.lower() for t, b in zip(toks[at : at + WINDOW], bad[at : at + WINDOW], strict=True) if b)
        n = of.total()
        if len(of) >= 0.3 * n and max(of.values()) <= 0.4 * n:
            rate, share = n / size, sum(known[at : at + WINDOW]) / size
            score = max(score, rate)
            flag = flag or rate >= 0.05 and share < 0.72 or 0.035 <= rate < 0.05 and share < 0.55
    return score, flag


def _tails(toks: str) -> Column:
    """For each token its tail if it is deformed, else null."""
    return F.transform(toks, lambda t: F.when(is_cipher(t) & ~is_glued(t), cipher_tail(t)))


def dict_rate(docs: DataFrame, key: str, toks: str, lexicon: DataFrame) -> DataFrame:
    """Q14: key, rate; repeated tokens count as often as they stand, no token gives zero."""
    if (words := _small(lexicon)) is not None:
        return _by_document(docs, [key], [F.col(toks)], words, "rate double", lambda hit, x: (sum(map(hit, x)) / len(x) if x else 0.0,))
    words = docs.select(key, F.explode_outer(toks).alias("tok")).groupBy(key, "tok").agg(F.count("tok").alias("n"))
    hit = with_hits(words, lexicon, "tok")
    return hit.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("rate"))


def fragments(docs: DataFrame, key: str, toks: str, lexicon: DataFrame) -> DataFrame:
    """Q8f: key, score, flag for documents with windows: the worst share of two-letter tokens that are mostly words."""
    if (words := _small(lexicon)) is not None:
        return _by_document(docs, [key], [F.col(toks)], words, "score double, flag boolean", _fragmented, MIN_FRAGMENT)
    w = windows(docs, key, toks, MIN_FRAGMENT)
    two = w.select(key, "start", F.size("seg").alias("n"), F.explode_outer(F.filter("seg", lambda t: F.length(t) == 2)).alias("tok"))
    two = with_hits(two.groupBy(key, "start", "n", "tok").agg(F.count("tok").alias("m")), lexicon, "tok")
    per = two.groupBy(key, "start", "n").agg(F.sum("m").alias("two"), F.sum(F.when(F.col("hit"), F.col("m")).otherwise(0)).alias("hits"))
    ratio, rate = F.col("two") / F.col("n"), F.coalesce(F.col("hits") / F.nullif(F.col("two"), F.lit(0)), F.lit(0.0))
    return per.groupBy(key).agg(F.coalesce(F.max(F.when(rate >= 0.6, ratio)), F.lit(0.0)).alias("score"), F.bool_or((ratio >= 0.5) & (rate >= 0.6)).alias("flag"))


def ciphers(docs: DataFrame, key: str, toks: str, lexicon: DataFrame) -> DataFrame:
    """Q8: key, score, flag for documents with windows: the worst share of tokens that a substitution has deformed."""
    if (words := _small(lexicon)) is not None:
        return _by_document(docs, [key], [F.col(toks), _tails(toks)], words, "score double, flag boolean", _ciphered, MIN_CIPHER)
    w = windows(docs, key, toks, MIN_CIPHER)
    words = w.select(key, "start", F.size("seg").alias("size"), F.explode("seg").alias("tok")).groupBy(key, "start", "size", "tok").agg(F.count(F.lit(1)).alias("n"))
    words = with_hits(words, lexicon, "tok")
    tail = cipher_tail(F.col("tok"))
    marked = words.withColumn("bad", is_cipher(F.col("tok")) & ~is_glued(F.col("tok"))).withColumn("tail", F.when(F.col("bad") & (F.length(tail) >= 3), tail)).withColumnRenamed("hit", "known")
    marked = with_hits(marked, lexicon, "tail").withColumn("bad", F.col("bad") & ~F.col("hit"))
    per = marked.groupBy(key, "start", "size", F.lower("tok").alias("low")).agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("known"))
    per = per.groupBy(key, "start", "size").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"), F.count_if(F.col("bad") > 0).alias("kinds"), F.max("bad").alias("top"))
    counts = (F.col("bad") > 0) & (F.col("kinds") >= 0.3 * F.col("bad")) & (F.col("top") <= 0.4 * F.col("bad"))
    rate, known = F.when(counts, F.col("bad") / F.col("size")).otherwise(0.0), F.col("known") / F.col("size")
    flag = ((rate >= 0.05) & (known < 0.72)) | ((rate >= 0.035) & (rate < 0.05) & (known < 0.55))
    return per.groupBy(key).agg(F.max(rate).alias("score"), F.bool_or(flag).alias("flag"))


def _cause() -> Column:
    return F.when(F.col("encoded"), "encoded").when(F.col("cipher"), "cipher").when(F.col("fragmented"), "fragmented")


def broken(docs: DataFrame, key: str, text: str, lexicon: DataFrame, fold: bool = True) -> DataFrame:
    """Q9: key, broken, cause (encoded, cipher, fragmented, or null); one row for each key. Null text is not broken."""
    plain = T.drop_urls(nfkc(F.col(text)) if fold else F.col(text))
    t = docs.select(key, T.encoded_glyphs(F.col(text)).alias("encoded"), T.tokens(plain).alias("toks"))
    if (words := _small(lexicon)) is not None:
        def judge(hit: _Known, toks: list[str], tails: list[str | None]) -> tuple[bool, bool]:
            return len(toks) >= MIN_CIPHER and bool(_ciphered(hit, toks, tails)[1]), len(toks) >= MIN_FRAGMENT and _fragmented(hit, toks)[1]

        t = _by_document(t, [key, "encoded"], [F.col("toks"), _tails("toks")], words, "cipher boolean, fragmented boolean", judge)
        return t.select(key, _cause().isNotNull().alias("broken"), _cause().alias("cause"))
    c = ciphers(t, key, "toks", lexicon).select(key, F.col("flag").alias("cipher"))
    f = fragments(t, key, "toks", lexicon).select(key, F.col("flag").alias("fragmented"))
    return t.select(key, "encoded").join(c, key, "left").join(f, key, "left").select(key, _cause().isNotNull().alias("broken"), _cause().alias("cause"))


def improves(o: dict[str, Column], c: dict[str, Column]) -> Column:
    """Q10 from the statistics of the original and a candidate: encoded, fragmented, n, two, rate."""
    mends = o["fragmented"] & ~c["fragmented"] & (o["two"] > 0) & (c["two"] <= 0.5 * o["two"]) & (c["n"] <= 0.7 * o["n"]) & (c["rate"] >= o["rate"] - 0.02)
    return o["encoded"] | ((c["n"] >= 20) & (mends | (c["rate"] - o["rate"] >= 0.15)))


def first_accepted(pages: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with the text of the accepted candidate of the least rank; status and engine follow.

    pages: keys, text, broken; candidates: keys, rank, engine, cand, accepted. A broken page without an accepted
    candidate keeps its text and is corrupt_unrecoverable with an empty engine.
    """
    best = candidates.where("accepted").groupBy(*keys).agg(F.min_by(F.struct("engine", "cand"), "rank").alias("best"))
    found = pages.join(best, keys, "left")
    status = F.when(~F.col("broken"), "clean").when(F.col("best").isNotNull(), "recovered").otherwise("corrupt_unrecoverable")
    engine = F.when(~F.col("broken"), "pypdf").when(F.col("best").isNotNull(), F.col("best.engine")).otherwise("")
    text = F.when(F.col("broken") & F.col("best").isNotNull(), F.col("best.cand")).otherwise(F.col("text"))
    return found.select(*keys, status.alias("status"), engine.alias("engine"), text.alias("text"))
