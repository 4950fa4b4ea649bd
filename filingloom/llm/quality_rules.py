"""Quality rules: fixed rules first, then gradient-boosted trees over statistics of a document.

The trees are flattened into numpy node arrays and score whole batches. The score may not rise with the share of
symbols, of repeated lines or of repeated words, nor with that of capitals (monotonic constraints).

Learning takes at most ``SAMPLE`` labelled rows, in the order of a hash of their id. Scoring is one pass over the
documents without a shuffle.

Defined results: null and empty texts have no words and fail the base rules; without labels of both kinds the base
rules alone decide; repeated rows are judged row by row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import labelled_sample, mix64, slices, table
from filingloom.llm.trees import Forest, fit_forest

SAMPLE, KEEP_AT, WINDOW = 8000, 0.3, 8
SPACES = b" \t\n\x0b\f\r"
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "digit_share", "exclaim_share", "pipe_share", "percent_share",
    "end_mark_share", "words_per_line", "distinct_share", "stop_share", "high_byte_share", "longest_word",
)
#: The score may not rise with these.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "capital_share")
MONOTONE = {FEATURES.index(name): -1 for name in FALLING}


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in windows that occur at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = dict.fromkeys(words)
    if len(ids) == len(words):
        return 0
    ids = dict(zip(ids, range(len(ids)), strict=True))
    x = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = mix64(key + x[i : i + n] + np.uint64(1))
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[where] > 1)
    if len(starts) == 0:
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((edge.cumsum()[:-1] > 0).sum())


def statistics(data: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    """The base counts and the features of a text."""
    words = data.split()  # bytes split at space and 0x09-0x0D, as the words are defined
    n = len(words)
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    word_chars = int(by.sum() - by[list(SPACES)].sum() - by[0x80:0xC0].sum())
    n_symbols = int(by[list(SYMBOLS)].sum())
    seen: set[bytes] = set()
    lines = dup_lines = end_marks = 0
    for line in data.split(b"\n"):
        body = line.strip()
        if body:
            lines += 1
            dup_lines += line in seen
            seen.add(line)
            end_marks += body[-1] in b".!?:"
    repeat = repeated_words(words)
    base = (n, word_chars, n_symbols, dup_lines, repeat)
    x = np.zeros(len(FEATURES))
    if n:
        letters = max(1, int(by[65:91].sum() + by[97:123].sum()))
        x[:] = (
            np.log1p(n), word_chars / n, n_symbols / n, dup_lines / lines, repeat / n, by[65:91].sum() / letters, by[48:58].sum() / max(1, word_chars), by[33] / n, by[124] / n, by[37] / n,
            end_marks / lines, n / lines, len(set(words)) / n, (by[46] + by[44]) / n, by[0xC0:].sum() / max(1, word_chars), np.log1p(max(map(len, words))),
        )
    return base, x


def base_failed(base: tuple[int, ...]) -> bool:
    n, repeat = base[0], base[4]
    return n < 20 or 100 * repeat > 30 * n


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    for batch in slices(batches):
        rows = [statistics(data or b"") for data in batch.column("data").to_pylist()]
        yield batch, [r[0] for r in rows], np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES))


def fit_rules(docs: DataFrame, labels: DataFrame, train: Column, limit: int = SAMPLE) -> Forest:
    """docs: doc_id, text; labels: doc_id, quality (1: good)."""
    sample = labelled_sample(docs, labels, "quality", train, limit).select("at", "y", F.col("text").cast("binary").alias("data"))

    def measure(batches):
        for batch, _, x in _measured(batches):
            yield pa.record_batch([batch.column("at"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["at", "y", "x"])

    rows = sample.mapInArrow(measure, "at bigint, y int, x array<double>").orderBy("at").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_forest(x, np.array([r["y"] for r in rows], float), n_trees=60, depth=3, monotone=MONOTONE)


def apply_rules(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of each row."""
    decided = len(forest.feature) > 0

    def judge(batches):
        for batch, base, x in _measured(batches):
            score = 1 / (1 + np.exp(-np.clip(forest.margin(x), -30, 30)))
            failed = np.array([base_failed(b) for b in base], bool)
            kept = ~failed & ((score >= keep_at) | (not decided))
            counts = np.array(base, np.int64).reshape(len(base), len(BASE))
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(counts[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(kept, pa.bool_())], names=["doc_id", *BASE, "base_failed", "score", "kept"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(judge, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, score double, kept boolean")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return apply_rules(docs, fit_rules(docs, labels, F.lit(True)))
