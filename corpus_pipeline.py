"""A training corpus from raw documents: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents
(the last one adds the copies' columns). ``run`` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import discard, materialise, table
from filingloom.llm.decontaminate import drop_contaminated
from filingloom.llm.jaccard_join import keep_one
from filingloom.llm.line_dedup import dedup_lines
from filingloom.llm.mixing import mix_sources
from filingloom.llm.toxicity import drop_toxic, fit_toxicity, trained_on

#: Near duplicates: words in a shingle, and the similarity in percent.
SHINGLE, SIMILAR = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labelled documents of the input."""
    labels = table(spark, sf_dir, "labels")
    return drop_toxic(docs, fit_toxicity(docs, labels, trained_on(labels)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go, and n_chars follows the text. A text whose lines were all kept stays as it is."""
    out, cut = dedup_lines(docs, keep_row=True), F.col("n_dropped") > 0
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(F.when(cut, changed[c]).otherwise(F.col("row")[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by near equality, the one with the smallest doc_id stays."""
    return keep_one(docs, k=SHINGLE, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of characters for all sources, as many characters as before, in random order."""
    return mix_sources(docs, seed=17)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: The toxicity model and near duplicates are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the shared folder; what the stages before it wrote is deleted as soon as it was read."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard(written)
        written = docs
    return docs
