"""Quality classifier: Naive Bayes support vectors.

Hashed n-gram indicators (words, word pairs, word shapes and triples of
them; a shape is a word's first and last kind of byte, its length class and
whether it repeats the word before) are scaled by the classes' log-count ratios and brought to unit
length; a linear hinge-loss model over them is fit by dual coordinate descent
and its margins become probabilities by a logistic fit to cross-validated
margins.  The model is fit on a bounded sample of labelled rows and is of a
fixed size; every document is scored over its whole text.

Edge cases: a null or empty text has no n-grams and gets the score of the
bias alone; without labels every score is 0.5, with one class only it is that
class's smoothed share; repeated rows are scored each; doc_id is an integer
column; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receptory.llm.common import BYTE_WEIGHT, LOWER, NOT_SPACE, U64, fold, mix, prefix_hashes, row_starts, slices, span_hashes, table, text_bytes, text_column, word_spans
from receptory.llm.labels import FOLDS, labelled_sample

#: Hashed features.
BITS = 18
#: Labelled documents a model is fit on at most.
FIT_DOCUMENTS = 4000

_SHAPE = np.zeros(256, np.int64)
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[ord("0") : ord("9") + 1] = 2
_SHAPE[128:] = 3
for _i, _c in enumerate(".,;:!?|*#$%&@\"'()-"):
    _SHAPE[ord(_c)] = 4 + _i


def indicators(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed features of a string array's distinct n-grams, by row."""
    data, offsets = text_bytes(array)
    low = LOWER[data]
    found = []

    def put(rows: np.ndarray, hashes: np.ndarray, family: int) -> None:
        found.append(rows << BITS | (mix(hashes + U64(family * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> U64(64 - BITS)).astype(np.int64))

    starts, ends, counts = word_spans(low, offsets, NOT_SPACE)
    if len(starts):
        words = span_hashes(prefix_hashes(BYTE_WEIGHT[low]), starts, ends)
        rows = np.repeat(np.arange(len(array)), counts)
        put(rows, words, 1)
        same = rows[1:] == rows[:-1]
        put(rows[1:][same], (words[:-1] * U64(3) + words[1:])[same], 3)
        again = np.zeros(len(words), np.int64)
        again[1:] = same & (words[1:] == words[:-1])
        shape = _SHAPE[low[starts]] | _SHAPE[low[ends - 1]] << 5 | np.minimum(ends - starts, 31) // 4 << 10 | again << 13
        same = rows[2:] == rows[:-2]
        put(rows[2:][same], (shape[:-2] | shape[1:-1] << 16 | shape[2:] << 32)[same].astype(U64), 4)
        put(rows, shape.astype(U64), 5)
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class QualityModel:
    """weight and scale by feature; a score is logistic(slope * margin + offset)."""

    weight: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        dot = np.bincount(rows, self.weight[features], n)
        norm = np.sqrt(np.bincount(rows, self.scale[features].astype(np.float64) ** 2, n))
        return dot / np.maximum(norm, 1e-12) + self.bias

    def scores(self, array: pa.Array) -> np.ndarray:
        rows, features = indicators(array)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows, features, len(array)) + self.offset, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log of the features' smoothed shares in the classes' indicator counts."""
    logs = []
    for label in (1, 0):
        own = [x for x, y in zip(rows, labels, strict=True) if y == label]
        count = smoothing + np.bincount(np.concatenate([np.zeros(0, np.int64), *own]), minlength=1 << BITS)
        logs.append(np.log(count / count.sum()))
    return logs[0] - logs[1]


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost * hinge loss, by updates of one dual variable at a time."""
    weight, bias = np.zeros(1 << BITS), 0.0
    dual = np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (weight[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - gradient / square[i], 0), costs[i])
            if step := new - dual[i]:
                weight[rows[i]] += step * signs[i] * values[i]
                bias += step * signs[i]
                dual[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-2:
            break
    return weight, bias


def logistic_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins probabilities, by Newton's method on smoothed targets."""
    n = labels.sum()
    target = np.where(labels == 1, (n + 1) / (n + 2), 1 / (len(labels) - n + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum() + 1e-3 * slope, (p - target).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def _fit(rows: list[np.ndarray], labels: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray, float]:
    ratio = log_count_ratios(rows, labels)
    values = [(v := ratio[x]) / max(np.sqrt((v * v).sum()), 1e-12) for x in rows]
    share = labels.mean()
    costs = cost * np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    weight, bias = dual_coordinate_descent(rows, values, 2.0 * labels - 1, costs)
    return weight * ratio, ratio, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, parts: int = 3) -> QualityModel:
    """The model of these rows' features; calibrated on margins of models that did not see the row."""
    zero = np.zeros(1 << BITS)
    if len(labels) == 0 or labels.min() == labels.max():
        share = 0.5 if len(labels) == 0 else (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    part = np.arange(len(rows)) % parts
    margins = np.zeros(len(rows))
    for k in range(parts):
        inside = part != k
        if not (part == k).any() or labels[inside].min() == labels[inside].max():
            continue
        model = QualityModel(*_fit([x for x, y in zip(rows, inside, strict=True) if y], labels[inside], cost), 1, 0)
        for i in np.flatnonzero(~inside):
            margins[i] = model.margins(np.zeros(len(rows[i]), np.int64), rows[i], 1)[0]
    return QualityModel(*_fit(rows, labels, cost), *logistic_fit(margins, labels))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_DOCUMENTS) -> QualityModel:
    """Features are taken on the executors; the driver gets at most limit rows of hashed features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, features = indicators(batch.column(1))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["doc_id", "label", "features"])

    sample = labelled_sample(docs, labels, label, limit)
    got = sorted(sample.mapInArrow(run, "doc_id long, label int, features binary").collect())
    return fit([np.frombuffer(x.features, "<i4").astype(np.int64) for x in got], np.array([x.label for x in got], np.int64))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2**BITS weights and scales

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(batch.column(1)))], ["doc_id", "score"])

    scored = docs.select("doc_id", text_column()).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, scored by a model of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
