"""Quality classifier: support vectors on Naive Bayes features.

A text's features are indicators of its byte n-grams (1 to 4 bytes) and of its words, in ``HASHED`` places by hash, and
of word n-grams that repeat one word (2 to ``MOST_RUN`` times), which have places of their own behind those. Each is
scaled by the class log-count ratio r = log((p / |p|) / (q / |q|)), p and q being the smoothed counts of the features in
the texts of both classes and |.| their sums; a linear hinge-loss model is then fitted to the scaled vectors, brought to
length 1, by dual coordinate descent, and blended with the mean weight as usual for this method. A logistic curve fitted
on rows that the model did not see turns margins into scores.

Learning takes at most ``SAMPLE`` labelled rows, in the order of a hash of their id; scoring is one pass over the
documents without a shuffle.

Defined results: null and empty texts have no features and get the score of the intercept; without labels of both
kinds every score is the share of label 1 (0.5 without any); repeated rows are scored row by row; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import RollingHash, crc_mod, labelled_sample, mix64, slices, table

SAMPLE, DIMS, THRESHOLD = 6000, 1 << 16, 0.3
ORDERS = (1, 2, 3, 4)
#: The longest word n-gram of one word that counts, and the places that hashes fill; n-grams of one word have the rest.
MOST_RUN = 24
HASHED = DIMS - MOST_RUN - 1


def _places(hashes: np.ndarray) -> np.ndarray:
    """Hashes dealt to the places 0 to HASHED - 1, by their low 16 bits."""
    return ((hashes & np.uint64(0xFFFF)) * np.uint64(HASHED) >> np.uint64(16)).astype(np.int64)


def indicators(data: bytes, hasher: RollingHash) -> np.ndarray:
    """The sorted places of a text's n-grams and words."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) == 0:
        return np.zeros(0, np.int64)
    seen = np.zeros(DIMS, bool)
    x = raw.astype(np.uint64)
    code = np.zeros(len(x), np.uint64)
    for n in ORDERS:
        if len(x) < n:
            break
        code = (code[: len(x) - n + 1] << np.uint64(8)) | x[n - 1 :]
        seen[_places(mix64(code + np.uint64(n << 40)))] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (raw > 32).astype(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    if len(start):
        words = hasher.ranges(hasher.prefix(raw), start, end)
        seen[_places(words)] = True
        # Word n-grams that repeat one word, whichever: their longest run tells which of them there are.
        change = np.flatnonzero(np.append(words[1:] != words[:-1], True))
        run = int(np.diff(change, prepend=-1).max())
        seen[HASHED + 2 : HASHED + min(run, MOST_RUN) + 1] = True
    return np.flatnonzero(seen)


class ScaledRows:
    """Rows (places, values) made when they are asked for: scaled indicators of length 1 and an intercept of 1."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray) -> None:
        self.rows, self.ratio = rows, np.append(ratio, 1.0)
        self.length = np.array([max(1e-12, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows])

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(self.rows[i], len(self.ratio) - 1)
        v = self.ratio[at] / self.length[i]
        v[-1] = 1.0
        return at, v


def dual_coordinate_descent(rows, y: np.ndarray, dims: int, c: np.ndarray, epochs: int = 15, seed: int = 0) -> np.ndarray:
    """Weights of the linear hinge-loss (L1) support vector machine; rows: a sequence of (places, values), y: -1 or 1, c: cost by row."""
    w, alpha = np.zeros(dims), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in (rows[i][1] for i in range(len(rows)))])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if square[i] == 0:
                continue
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each place, the log of its share in the counts of class 1 over that in the counts of class 0, both smoothed by 1."""
    counts = np.ones((2, DIMS))
    for at, label in zip(rows, y, strict=True):
        counts[int(label)][at] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


@dataclass
class QualityModel:
    """weight: by place, the log ratio included; the margin is scaled by the length of the text's scaled vector."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, at: np.ndarray) -> float:
        norm = np.sqrt(self.square[at].sum()) if len(at) else 0.0
        margin = self.bias + (self.weight[at].sum() / norm if norm else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with smoothed targets."""
    ones, zeros = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hessian = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train_model(rows: list[np.ndarray], y: np.ndarray, held: np.ndarray, blend: float = 0.25, cost: float = 1.0) -> QualityModel:
    """rows: places by text; held: rows for the logistic curve only."""
    share = float(y.mean()) if len(y) else 0.5
    flat = QualityModel(np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    fit = np.flatnonzero(~held)
    if len(fit) == 0 or y[fit].min() == y[fit].max():
        return flat
    ratio = log_count_ratio([rows[i] for i in fit], y[fit])
    square = ratio * ratio
    scaled = ScaledRows([rows[i] for i in fit], ratio)
    sign = np.where(y[fit] == 1, 1.0, -1.0)
    weight_of = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(fit)
    w = dual_coordinate_descent(scaled, sign, DIMS + 1, cost * weight_of)
    mean = np.abs(w[:-1]).mean()
    blended = (1 - blend) * mean + blend * w[:-1]
    model = QualityModel(blended * ratio, square, float(w[-1]), 1.0, 0.0)
    check = np.flatnonzero(held) if 0 < y[held].sum() < held.sum() else fit
    margins = np.array([_margin(model, rows[i]) for i in check])
    model.slope, model.offset = _logistic(margins, y[check])
    if model.slope <= 0:
        return flat
    return model


def _margin(model: QualityModel, at: np.ndarray) -> float:
    norm = np.sqrt(model.square[at].sum()) if len(at) else 0.0
    return model.bias + (model.weight[at].sum() / norm if norm else 0.0)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, limit: int = SAMPLE) -> QualityModel:
    """docs: doc_id, text; labels: doc_id, quality; train: the rows of ``labels`` that may be used."""
    sample = labelled_sample(docs, labels, "quality", train, limit).select("at", "y", F.col("text").cast("binary").alias("data"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()
        for batch in slices(batches):
            places = [indicators(d or b"", hasher).astype("<u2").tobytes() for d in batch.column("data").to_pylist()]
            yield pa.record_batch([batch.column("at"), batch.column("y"), pa.array(places, pa.binary())], names=["at", "y", "places"])

    got = sample.mapInArrow(measure, "at bigint, y int, places binary").orderBy("at").collect()
    rows = [np.frombuffer(r["places"], "<u2").astype(np.int32) for r in got]
    held = np.array([(r["at"] >> 1) % 4 == 0 for r in got], bool)
    return train_model(rows, np.array([r["y"] for r in got], float), held)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out and score of docs' rows (doc_id, held_out, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()
        for batch in slices(batches):
            scores = [model.score(indicators(d or b"", hasher)) for d in batch.column("data").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("data")).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, F.coalesce(crc_mod(5) != 0, F.lit(True)))
    rows = docs.select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "text")
    return score_quality(rows, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
