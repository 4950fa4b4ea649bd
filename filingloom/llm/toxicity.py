"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of toxic words from a fixed lexicon and from two learned ones (words, and beginnings of words), how
often such words stand near a second-person pronoun, shares of capitals and of punctuation, and rates of obfuscation
(letters replaced by digits or signs, stretched letters).

Learning takes at most ``SAMPLE`` labelled rows. Half of them, told apart by a hash of the id, teach the lexicons
(counted on the executors, at most ``TERMS`` terms kept); of the others three quarters fit the trees and one quarter the
calibration. Scoring is one pass over the documents without a shuffle.

Defined results: null and empty texts get a score from features that are all 0; without labels of both kinds (no
labels, labels of other documents, all of one kind) there is no model: every score is 0 and no document is rejected;
null labels are not used; repeated rows are scored row by row; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import crc_mod, labelled_sample, slices, table
from filingloom.llm.trees import Forest, Isotonic, fit_forest, fit_isotonic

SAMPLE, TERMS, THRESHOLD = 8000, 600, 0.3
#: Words that a worker keeps the flags of.
CACHE = 200_000
PREFIXES = (4, 5, 6, 7, 8)
SEED_WORDS = frozenset(
    "idiot idiots moron morons stupid dumb fool trash garbage scum loser losers worthless pathetic disgusting clown "
    "dumm idiotisch abschaum wertlos ekelhaft idiota estúpido basura inútil imbécil stupide nul ordure débile crétin".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros vuestro".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
STRETCHED = re.compile(r"(.)\1\1")
EDGES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
SENTENCE = ".,;:!?\"'()[]"
FEATURES = (
    "seed_density", "word_density", "prefix_density", "seed_hits", "word_hits", "prefix_hits", "strong_density", "near_second_person", "second_person_density",
    "capital_share", "exclaim_share", "punctuation_share", "leet_rate", "stretched_rate", "hidden_hits", "log_words",
)
SEED, WORD, PREFIX, STRONG, YOU, HIDDEN, LEETED, STRETCH = (1 << i for i in range(8))


@dataclass
class Lexicon:
    words: frozenset = frozenset()
    prefixes: frozenset = frozenset()
    strong: frozenset = frozenset()


class _Flags(dict):
    """Flags of a token, worked out when it is first seen."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        lex, low = self.lexicon, token.lower()
        bare = low.strip(EDGES)
        flags = self._hits(bare)
        if STRETCHED.search(bare):
            flags |= STRETCH
            if not flags & (SEED | WORD | PREFIX) and self._hits(re.sub(r"(.)\1+", r"\1", bare)) & (SEED | WORD):
                flags |= HIDDEN
        plain = low.strip(SENTENCE).translate(LEET).strip(EDGES)
        if plain != bare and any(c.isalpha() for c in bare) and any(not c.isalpha() for c in bare):
            flags |= LEETED
            if not flags & (SEED | WORD | PREFIX) and self._hits(plain) & (SEED | WORD):
                flags |= HIDDEN
        if bare in SECOND_PERSON:
            flags |= YOU
        if bare in lex.strong:
            flags |= STRONG
        self[token] = flags
        return flags

    def _hits(self, bare: str) -> int:
        lex = self.lexicon
        flags = SEED * (bare in SEED_WORDS) | WORD * (bare in lex.words)
        for n in PREFIXES:
            if len(bare) >= n and (p := bare[:n]) in lex.prefixes:
                flags |= PREFIX | STRONG * (p + "*" in lex.strong)
        return flags


def features(text: str, flags: _Flags) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    tokens = text.split()
    if not tokens:
        return out
    f = np.fromiter(map(flags.__getitem__, tokens), np.uint8, len(tokens))
    n = len(tokens)
    hit = np.flatnonzero(f & (SEED | WORD | PREFIX))
    you = np.flatnonzero(f & YOU)
    near = 0
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        before = hit - you[np.maximum(at - 1, 0)]
        after = you[np.minimum(at, len(you) - 1)] - hit
        near = int((((before >= 0) & (before <= 5)) | ((after >= 0) & (after <= 5))).sum())
    by = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    letters = max(1, int(by[65:91].sum() + by[97:123].sum() + by[192:].sum()))
    punctuation = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    seed, word, prefix = ((f & b > 0).sum() for b in (SEED, WORD, PREFIX))
    out[:] = (
        seed / n, word / n, prefix / n, np.log1p(seed), np.log1p(word), np.log1p(prefix), (f & STRONG > 0).sum() / n, near / n, len(you) / n,
        by[65:91].sum() / letters, by[33] / n, punctuation / n, (f & LEETED > 0).sum() / n, (f & STRETCH > 0).sum() / n, (f & HIDDEN > 0).sum() / n, np.log1p(n),
    )
    return out


def _terms(text: str) -> set[str]:
    """Words and, marked by a star, beginnings of words."""
    words = {t.strip(EDGES) for t in text.lower().split()}
    return {w for w in words if 2 < len(w) <= 40} | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term and label, summed within the task; emptied whenever it holds half a million terms."""
    ones, zeros = Counter(), Counter()

    def flush():
        terms = list(ones.keys() | zeros.keys())
        out = pa.record_batch([pa.array(terms, pa.string()), pa.array([ones[t] for t in terms], pa.int64()), pa.array([zeros[t] for t in terms], pa.int64())], names=["term", "ones", "zeros"])
        ones.clear()
        zeros.clear()
        return out

    for batch in slices(batches):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            (ones if y else zeros).update(_terms(text))
            if len(ones) + len(zeros) > 500_000:
                yield flush()
    yield flush()


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms that stand in labelled-1 documents far oftener than chance gives."""
    texts = sample.groupBy("text").agg(F.max("y").alias("y"))  # copies teach nothing more
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon()
    counts = texts.select("text", "y").mapInArrow(_count_terms, "term string, ones bigint, zeros bigint").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    expected = F.col("zeros") * (n1 / n0)
    z = (F.col("ones") - expected) / F.sqrt(expected + 0.5)
    least = min(4, max(2, n1 // 10))
    kept = counts.where((F.col("ones") >= least) & (F.col("ones") > 4 * expected)).withColumn("z", z).where(F.col("z") > 3.5).orderBy(F.desc("z"), "term").limit(TERMS).collect()
    strong = frozenset(r["term"] for r in kept if r["ones"] >= max(6, n1 // 40) and r["ones"] > 12 * r["zeros"] * n1 / n0)
    return Lexicon(frozenset(r["term"] for r in kept if r["term"][-1] != "*"), frozenset(r["term"][:-1] for r in kept if r["term"][-1] == "*"), strong)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    forest: Forest
    calibration: Isotonic
    report: dict = field(default_factory=dict)

    @property
    def fitted(self) -> bool:
        """Whether there were labels of both kinds to learn from."""
        return len(self.forest.feature) > 0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.forest.margin(x)) if self.fitted else np.zeros(len(x))


def _matrix(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    flags = _Flags(lexicon)
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        yield batch, np.array([features(t or "", flags) for t in texts]).reshape(len(texts), len(FEATURES))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, limit: int = SAMPLE) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic; train: the rows of ``labels`` that may be used."""
    sample = labelled_sample(docs, labels, "toxic", train, limit).persist()
    try:
        lexicon = learn_lexicon(sample.where(F.pmod("at", F.lit(2)) == 0))

        def measure(batches):
            for batch, x in _matrix(batches, lexicon):
                yield pa.record_batch([batch.column("at"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["at", "y", "x"])

        rows = sample.where(F.pmod("at", F.lit(2)) == 1).mapInArrow(measure, "at bigint, y int, x array<double>").orderBy("at").collect()
    finally:
        sample.unpersist()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([r["y"] for r in rows], float)
    last = np.array([(r["at"] >> 1) % 4 == 0 for r in rows], bool)
    forest = fit_forest(x[~last], y[~last], n_trees=60, depth=3, least=1.0)
    calibration = fit_isotonic(forest.margin(x[last]), y[last]) if 0 < y[last].sum() < last.sum() else Isotonic(np.zeros(0), np.zeros(0))
    return ToxicityModel(lexicon, forest, calibration, {"rows": len(rows), "ones": int(y.sum())})


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out and score of docs' rows (doc_id, held_out, text)."""

    def score(batches):
        for batch, x in _matrix(batches, model.lexicon):
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(x), pa.float64())], names=["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, with all their columns; all rows where nothing could be learned."""
    if not model.fitted:
        return docs

    def keep(batches):
        for batch, x in _matrix(batches, model.lexicon):
            yield batch.filter(pa.array(model.scores(x) < threshold, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def trained_on(labels: DataFrame) -> Column:
    return F.coalesce(crc_mod(4) != 2, F.lit(True))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, trained_on(labels))
    rows = docs.select("doc_id", F.coalesce(crc_mod(4) == 2, F.lit(False)).alias("held_out"), "text")
    return score_toxicity(rows, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
