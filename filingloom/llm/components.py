"""Connected components of a graph given by links, with labels that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (a, b): comp is the smallest node of the component.

    Each round links every node to the smallest label around it (the neighbourhood's labels too, so paths shorten by
    half and more), and ends when no label changed. Labels are written to the shared folder after each round. A node
    with very many links is met by partial minima only.
    """
    edges = links.where(F.col("a") != F.col("b")).select("a", "b")
    edges = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp")), "cc-labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("comp").alias("far"))
        # What a node hears from its neighbours, and what it passes on to the node that is its label.
        heard = edges.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        best = labels.join(heard, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        passed = best.select(F.col("old").alias("node"), "comp").unionByName(best.select("node", "comp")).groupBy("node").agg(F.min("comp").alias("comp"))
        up = passed.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        following = passed.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        following = materialise(following, "cc-labels")
        changed = following.join(labels.withColumnRenamed("comp", "old"), "node").where(F.col("comp") != F.col("old"))
        done = changed.isEmpty()
        discard(labels)
        if done:
            discard(edges)
            return following
        labels = following
