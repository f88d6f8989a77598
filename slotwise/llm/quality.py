"""Quality classifier: naive Bayes support vectors over character n-grams.

1. A document is the set of its byte n-grams (indicators, hashed into a fixed
   number of columns).
2. Each indicator is scaled by the log ratio of its smoothed counts in the two
   classes (naive Bayes), and the scaled row to unit length.
3. A linear hinge-loss model is fitted by dual coordinate descent: one dual
   variable at a time, each step exact, over shuffled passes.
4. Margins of rows outside the fitting folds give a logistic map from margin
   to probability.

Fitting uses at most about ``PER_CLASS`` training rows of each class, drawn by
a hash of the id; the model has ``2**COLUMN_BITS`` weights.  Scoring is one
pass over the documents without a shuffle.

Defined cases: null text and empty text have no indicators: margin 0 plus the
bias; without training rows of both classes every score is the share of
label 1 among training rows (0 without any).  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import crc_mod, ready
from slotwise.llm.sampling import draw, labelled_texts

# Bound of the training sample, rows of each class.
PER_CLASS = 3000
COLUMN_BITS = 18
ORDERS = (1, 2, 3, 4)
FOLDS = 3
SMOOTHING, COST, PASSES = 1.0, 1.0, 12


class Indicators:
    """Distinct hashed byte n-grams of a text."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << COLUMN_BITS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8"), np.uint8).astype(np.uint32)
        parts, code = [], np.zeros(0, np.uint32)
        for n in ORDERS:
            if len(data) < n:
                break
            code = data if n == 1 else (code[:-1] << np.uint32(8)) | data[n - 1 :]
            mixed = (code + np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            parts.append((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - COLUMN_BITS))
        if not parts:
            return np.zeros(0, np.uint32)
        columns = np.concatenate(parts)
        # The last writer of a column stands for it: distinct columns without a sort.
        place = np.arange(len(columns), dtype=np.int32)
        self.last[columns] = place
        return columns[self.last[columns] == place]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log of (smoothed share of a column among label 1 / among label 0)."""
    size = 1 << COLUMN_BITS
    counts = np.full((2, size), SMOOTHING)
    for row, label, weight in zip(rows, y, w, strict=True):
        counts[int(label), row] += weight
    totals = np.array([w[y == k].sum() + 2 * SMOOTHING for k in (0, 1)])
    return np.log(counts[1] / totals[1]) - np.log(counts[0] / totals[0])


@dataclass
class NbSvm:
    """Weights already times the ratios; ``square`` are the squared ratios."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, columns: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[columns].sum())) or 1.0
        return float(self.weight[columns].sum()) / norm + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, w: np.ndarray, seed: int = 5) -> NbSvm:
    """min |v|^2 / 2 + sum C_i max(0, 1 - y_i v.x_i), a coordinate of the dual at a time."""
    ratio = log_count_ratio(rows, y, w)
    v, bias = np.zeros(len(ratio)), 0.0
    values = []
    for row in rows:
        x = ratio[row]
        values.append(x / (float(np.sqrt(x @ x)) or 1.0))
    sign = np.where(y == 1, 1.0, -1.0)
    # Classes count alike; the probabilities are set right by the logistic map.
    cost = COST * np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    norm = np.array([float(x @ x) + 1.0 for x in values])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            row, x = rows[i], values[i]
            slack = sign[i] * (float(v[row] @ x) + bias) - 1.0
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                v[row] += step * x
                bias += step
                alpha[i] = new
    return NbSvm(v * ratio, ratio**2, bias)


def logistic_map(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic map, by Newton's method with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = w * (p - y)
        h = w * p * (1 - p) + 1e-9
        grad = np.array([g @ margin + 1e-3 * (a - 1.0), g.sum()])
        hess = np.array([[(h * margin) @ margin + 1e-3, h @ margin], [h @ margin, h.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


@dataclass
class Model:
    svm: NbSvm | None
    prior: float


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from the training rows: labelled, and crc32(doc_id) mod 5 is not 0."""
    ready(docs.sparkSession)
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
        .dropDuplicates(["doc_id"])
    )
    chosen, weight = draw(known, "quality", per_class, seed=5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for b in batches:
            packed = [indicators(t.as_py()).astype("<u4").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array(packed, pa.binary())], ["doc_id", "quality", "columns"]
            )

    got = labelled_texts(docs, chosen).mapInArrow(run, "doc_id long, quality int, columns binary").collect()
    got.sort(key=lambda r: r[0])
    y = np.array([r[1] for r in got], float)
    if len(set(y)) < 2:
        return Model(None, float(y.mean()) if len(y) else 0.0)
    rows = [np.frombuffer(r[2], "<u4") for r in got]
    w = np.array([weight[int(v)] for v in y])
    w /= w.mean()
    fold = np.random.default_rng(7).integers(0, FOLDS, len(y))
    margin = np.full(len(y), np.nan)
    for k in range(FOLDS):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[inside])) == 2:
            part = dual_descent([rows[i] for i in inside], y[inside], w[inside])
            margin[outside] = [part.margin(rows[i]) for i in outside]
    model = dual_descent(rows, y, w)
    seen = ~np.isnan(margin)
    if len(set(y[seen])) == 2:
        model.slope, model.offset = logistic_map(margin[seen], y[seen], w[seen])
    return Model(model, float(w @ y / w.sum()))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every document, in one pass."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**COLUMN_BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, indicators = held.value, Indicators()
        for b in batches:
            if m.svm is None:
                score = np.full(b.num_rows, m.prior)
            else:
                score = m.svm.probability(np.array([m.svm.margin(indicators(t.as_py())) for t in b.column("text")]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score_documents(docs, fit(docs, labels)).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
