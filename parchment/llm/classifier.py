"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

#: Labelled documents that the model is fitted on, in expectation; chosen by the hash of their id.
SAMPLE = 4000
#: Hashed features.
CELLS = 1 << 18
#: Grades: 0 toxic, 1 poor, 2 good. A document stays if its grade is the best with this probability.
GRADES, KEEP = 3, 0.5
L1, ROUNDS = 4e-4, 200
#: Cells in fewer documents of the sample than this have no weight.
RARE = 6
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
_STORE = 300_000


def _token_cells(token: str, cells: int) -> list[int]:
    """The token, and for a word its beginnings and ends of four and five letters."""
    parts = ["=" + token]
    if token[0].isalpha() and len(token) > 4:
        parts += ["^" + token[:4], "^" + token[:5], "^" + token[:6], "$" + token[-5:]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % cells for p in parts]


def _shape(text: str, tokens: list[str], words: int, n_symbols: int) -> list[str]:
    """Marks of the whole text in coarse steps: length, share of symbols, capitals, repeated lines and words."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(len(text), 1)
    caps = sum(map(str.isupper, text)) / n
    step = lambda x: int(min(x, 1) * 10)
    return [f"#w{min(words, 4096).bit_length()}", f"#s{step(n_symbols / max(words, 1))}", f"#c{step(caps)}", f"#d{step(1 - len({*lines}) / len(lines)) if lines else 0}", f"#r{step(sum(map(str.__eq__, tokens, tokens[1:])) / max(len(tokens), 1))}"]


class Featurer:
    def __init__(self, cells: int = CELLS) -> None:
        self.cells, self.known = cells, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct cells of a text, sorted; presence alone counts, so length does not thin out a word."""
        text = text or ""
        tokens = _TOKEN.findall(text.lower())
        if len(self.known) > _STORE:
            self.known.clear()
        known, out = self.known, []
        for t in {*tokens}:
            if (c := known.get(t)) is None:
                c = known[t] = _token_cells(t, self.cells)
            out += c
        symbols = sum(not t[0].isalnum() for t in tokens)
        out += [zlib.crc32(m.encode()) % self.cells for m in _shape(text, tokens, len(tokens) - symbols, symbols)]
        return np.unique(np.array(out, np.int64))


class Model:
    """Weights shared by all grades, and ordered thresholds between them: P(grade <= k) = sigmoid(threshold_k - w.x)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def grades(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of the best one."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))
        return above.sum(1), above[:, -1]


def fit_arrays(flat: np.ndarray, sizes: np.ndarray, grade: np.ndarray, cells: int = CELLS, grades: int = GRADES, l1: float = L1, rounds: int = ROUNDS, rare: int = RARE) -> Model:
    """Accelerated proximal gradient on the mean log-likelihood with an L1 penalty; no random part.

    ``flat`` has the cells of all rows one after the other, ``sizes`` how many each row has.
    """
    n = len(sizes)
    if len({*grade.tolist()}) < 2:
        return Model(np.zeros(cells), np.arange(grades - 1) - 50.0)
    used = np.flatnonzero(np.bincount(flat, minlength=cells) >= min(rare, n // 50 + 1))
    place = np.zeros(cells, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    place = place[flat]
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[place > 0]
    # Each row begins with a cell without weight, so none is empty.
    owner = np.concatenate((np.arange(n, dtype=np.int32), owner))
    order = np.argsort(owner, kind="stable")
    flat = np.concatenate((np.zeros(n, np.int32), place[place > 0]))[order]
    owner = owner[order]
    used = np.append(cells, used)
    starts = np.searchsorted(owner, np.arange(n))
    sizes = np.diff(np.append(starts, len(flat)))
    share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    cut = np.concatenate(([first[0]], np.log(np.maximum(np.diff(first), 0.05))))
    w = np.zeros(len(used))
    v, u, t = w.copy(), cut.copy(), 1.0
    scale = np.ones(len(used))
    scale[0] = 0
    rate = 8.0 / max(1.0, sizes.mean() ** 0.5)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for _ in range(rounds):
        f = np.add.reduceat((v * scale)[flat], starts)
        theta = np.cumsum(np.concatenate(([u[0]], np.exp(u[1:]))))
        below = sig(np.concatenate((theta, [60.0]))[grade] - f)
        under = np.where(grade > 0, sig(np.concatenate(([0.0], theta))[grade] - f), 0.0)
        p = np.maximum(below - under, 1e-12)
        db, du = below * (1 - below) / p, under * (1 - under) / p
        g_f = (db * (grade < grades - 1) - du) / n
        g_w = np.bincount(flat, g_f[owner], len(used)) * scale
        g_theta = np.array([-(db[grade == k].sum() - du[grade == k + 1].sum()) / n for k in range(grades - 1)])
        g_u = np.concatenate(([g_theta.sum()], [g_theta[k:].sum() * np.exp(u[k]) for k in range(1, grades - 1)]))
        new = v - rate * g_w
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_cut = u - 0.5 * g_u
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if ((v - new) * (new - w)).sum() > 0:
            t2, t = 1.0, 1.0
        v, u = new + (t - 1) / t2 * (new - w), new_cut
        w, cut, t = new, new_cut, t2
    weights = np.zeros(cells + 1)
    weights[used] = w * scale
    return Model(weights[:cells], np.cumsum(np.concatenate(([cut[0]], np.exp(cut[1:])))))


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, grade: 0 toxic, 1 poor, 2 good. The worst of several labels holds; rows without id or quality do not count."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cells: int = CELLS) -> Model:
    """Fit on about ``sample`` of the rated documents (ratings: id, grade), whole texts; a Poisson bound, so it may be broadcast.

    The sample is chosen by the hash of ids, so a rerun fits the same model. Ratings of absent documents do not count,
    nor do other columns. Without two grades in the sample every document is given the best grade.
    """
    total = ratings.count()
    if not total:
        return fit_arrays(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), cells)
    bound = int(min(1.0, sample / total) * 1_000_000)
    chosen = ratings.where(F.pmod(F.xxhash64(F.lit("classifier"), "id"), F.lit(1_000_000)) < bound)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurer(cells)
        for batch in batches:
            rows = [make(t.as_py()).astype(np.int32) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["id", "grade", "cells"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "grade", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    table = rows.mapInArrow(features, f"id {kind}, grade int, cells array<int>").toArrow().sort_by("id")
    lists = table.column("cells").combine_chunks()
    return fit_arrays(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), table.column("grade").to_numpy(), cells)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` with expected_grade, p_good and kept (p_good >= ``keep``); columns of these names are replaced.

    Null and empty texts are scored by their shape alone; whole texts are read, however long. Equal texts get equal
    scores; repeated rows give repeated rows, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = without(docs, "expected_grade", "p_good", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        make = Featurer(len(m.weights))
        for batch in batches:
            s = np.array([m.weights[make(t.as_py())].sum() for t in batch.column(text_col)])
            expected, good = m.grades(s)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(expected), pa.array(good), pa.array(good >= keep)], names=[*names, "expected_grade", "p_good", "kept"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names).mapInArrow(run, f"{schema}, expected_grade double, p_good double, kept boolean")


def trained(spark, sf_dir: str, docs: DataFrame | None = None) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs, graded(labels))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text"), trained(spark, sf_dir, docs)).drop("text")
