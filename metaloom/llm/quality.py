"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .pieces import Bounded

#: Hashed n-gram space; the ratios and weights have this size at any input.
DIMENSIONS = 1 << 18
#: Labelled rows that the linear model is fitted on, chosen by a hash of the id; the counts use all of them.
FIT_ROWS = 8000
CUT = 0.7

_UPPER, _LOWER, _DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")
_U = np.uint64
_cache: dict = {}


def _shape(word: bytes) -> bytes:
    """Letters and digits as classes, other characters as they are: Word. -> Aa., 12:30 -> 0:0."""
    return _DIGIT.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word)))[:12]


_words = Bounded(lambda w: (xxhash.xxh3_64_intdigest(w.lower()), xxhash.xxh3_64_intdigest(_shape(w), 1)), 200_000)
_SAME = _U(0x51A7E5A1D0C0FFEE)


def features(text: bytes | None) -> np.ndarray:
    """Distinct buckets of word 1-grams, and of 1- to 3-grams of word shapes where a repeated word counts as a shape of its own."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int32)
    both = np.array(list(map(_words.__getitem__, words)), _U)
    word, shape = both[:, 0], both[:, 1].copy()
    shape[1:][word[1:] == word[:-1]] = _SAME
    grams, total = [word], shape
    for n in range(3):
        grams.append((total ^ _U(n + 1)) * _U(0x9E3779B97F4A7C15))
        if len(total) < 2:
            break
        total = total[:-1] * _U(0xC2B2AE3D27D4EB4F) + shape[n + 1 :]
    return np.unique((np.concatenate(grams) >> _U(40)) % _U(DIMENSIONS)).astype(np.int32)


@dataclass
class Model:
    """weight: of each bucket, ratio included; a and b turn the margin into a probability."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weight[x].sum() / np.sqrt(1 + (self.ratio[x] ** 2).sum()) + self.bias)

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -500, 500))))


def class_counts(rows: DataFrame) -> DataFrame:
    """(bucket, ones, zeros) over all labelled rows (text binary, label int), combined per task before the shuffle.

    A row counts once for each bucket that its text has. Null or empty text: no buckets. Any label but 1 counts as 0.
    Empty table: no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = np.zeros((2, DIMENSIONS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ones[int(label == 1), features(text.as_py())] += 1
        at = np.flatnonzero(ones.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ones[1, at]), pa.array(ones[0, at])], names=["bucket", "ones", "zeros"])

    return rows.mapInArrow(count, "bucket long, ones long, zeros long").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, seed: int = 1) -> Model | None:
    """Ratios from all labelled rows; hinge loss by dual coordinate descent on about fit_rows of them.

    Labels grow with the documents, so both sides of their join are shuffled at every size. Null text: as empty.
    Null label or null id: not learned from. An id with two different labels gives a row for each; equal labels of
    one id count once, rows that repeat an id once each. No labelled rows, or one class only: None. The sample is
    drawn by a hash of the id and sorted before the fit, so that partitioning changes nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("label is not null").distinct()
    rows = staged(rows.join(marks.hint("merge"), "id").select("id", "text", "label"), "quality-rows")
    n_rows = rows.count()
    got = class_counts(rows.select("text", "label")).toArrow()
    if not n_rows or not got.num_rows:
        return None
    p = np.ones((2, DIMENSIONS))
    at = got.column("bucket").to_numpy()
    p[1, at] += got.column("ones").to_numpy()
    p[0, at] += got.column("zeros").to_numpy()
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x.as_py()) for x in batch.column(1)], pa.list_(pa.int32())), batch.column(2)], names=["place", "x", "label"])

    draw = F.pmod(F.xxhash64(F.lit("quality sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < fit_rows / n_rows).select(F.xxhash64("id", "text", "label").alias("place"), "text", "label")
    sample = drawn.mapInArrow(chosen, "place long, x array<int>, label int").toArrow().sort_by("place")
    return descend([x.values.to_numpy() for x in sample.column("x")], sample.column("label").to_numpy(), ratio, seed)


def descend(xs: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, seed: int = 1, c: float = 1.0, epochs: int = 12, mix: float = 0.5) -> Model | None:
    """Dual coordinate descent: each step solves one row's multiplier exactly; weights are mixed with their mean size.

    A row without buckets only moves the bias. Classes weigh the same in sum. Repeated rows are rows of their own.
    One class only, or no rows: None.
    """
    y = np.where(label == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        return None
    cost = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y < 0).sum()))
    values = [ratio[x] / np.sqrt(1 + (ratio[x] ** 2).sum()) for x in xs]
    square = np.array([(v**2).sum() + 1 for v in values])
    w, bias, alpha, order = np.zeros(len(ratio)), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            x, v = xs[i], values[i]
            new = min(max(alpha[i] - (y[i] * (w[x] @ v + bias) - 1) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    model = Model((mix * w + (1 - mix) * np.abs(w[w != 0]).mean()) * ratio, ratio, bias, 1.0, 0.0)
    margins = np.array([model.margin(x) for x in xs])
    model.a, model.b = _calibrated(margins, label == 1)
    return model


def _calibrated(m: np.ndarray, one: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the margins by Newton steps, with a weak pull to a plain slope."""
    a, b = 1.0, 0.0
    target = np.where(one, (one.sum() + 1) / (one.sum() + 2), 1 / ((~one).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - target) * m).sum() + 0.01 * (a - 1), (p - target).sum() + 0.01 * b])
        q = p * (1 - p)
        h = np.array([[(q * m * m).sum() + 0.01, (q * m).sum()], [(q * m).sum(), q.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and score, the probability of label 1 given the whole text.

    Null, empty or wordless texts have no n-grams and get the score of the bias alone. Without a model (no
    labels, or one class only) every score is 0.5. Null and repeated ids pass through, a row each. Very long
    texts use all their n-grams. Empty table: no rows. Extra columns are ignored.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _cache:
            _cache.clear()
            _cache[name] = shared.value
        own = _cache[name]
        for batch in batches:
            scores = [0.5 if own is None else own.score(features(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
