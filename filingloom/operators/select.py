"""Scoring, ranking and choosing candidates as expressions over a document's array of candidates.

A document stays one row, so nothing is shuffled: sorting is ``array_sort`` by a key struct, and equal candidates at the
top are told apart by what they say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.arrow import let
from filingloom.functions.text import content_key, count_tokens, has_any
from filingloom.profiles import TableProfile

DISQUALIFIED = -999
CANDIDATE = "backend string, kind int, index int, seq int, snippet string, header string, full string, caption boolean, title boolean, grid array<array<string>>"


def tier_weight(low: Column, profile: TableProfile) -> Column:
    """The header strength of a text snippet: of its first complete tier, else 1 for any identity term."""
    out = None
    for i, terms in enumerate(profile.tiers):
        every = F.lit(True)
        for t in terms:
            every &= low.contains(t)
        out = F.when(every, max(3 - i, 1)) if out is None else out.when(every, max(3 - i, 1))
    return out.when(has_any(low, profile.identity_terms), 1).otherwise(0)


def text_score(snippet: Column, profile: TableProfile) -> Column:
    low = F.lower(snippet)
    score = tier_weight(low, profile) + count_tokens(low, profile.tokens) + 1 + F.when(snippet.rlike(r"[$,]|(?U:\d)"), 1).otherwise(0) - F.when(has_any(low, profile.decoys), profile.decoy_penalty).otherwise(0)
    return F.when(has_any(low, profile.required_tokens), score).otherwise(DISQUALIFIED) if profile.required_tokens else score


def table_score(c: Column, profile: TableProfile) -> Column:
    header = c["header"]
    by_kind = F.when(c["kind"] == 3, 7).when(c["kind"] == 2, 5).when(c["kind"] == 1, 2).otherwise(0)
    score = (
        by_kind
        + F.least(count_tokens(header, tuple(dict.fromkeys(profile.tokens))), F.lit(profile.token_cap))
        + F.when(c["full"].rlike(r"(?U)\$|\b\d{3,}\b"), 2).otherwise(0)
        - F.when(has_any(header, profile.decoys), profile.decoy_penalty).otherwise(0)
        + F.when(c["caption"], profile.caption_bonus).otherwise(0)
        + F.when(c["title"], profile.title_bonus).otherwise(0)
    )
    return F.when(has_any(header, profile.required_tokens), score).otherwise(DISQUALIFIED) if profile.required_tokens else score


def scored(candidates: Column, profile: TableProfile) -> Column:
    """Candidates in rank order: by score, header strength, index, and order of appearance."""

    def one(c: Column) -> Column:
        dom = c["backend"] == "dom"
        score = F.when(dom, table_score(c, profile)).otherwise(text_score(c["snippet"], profile)).cast("int")
        said = F.when(dom, c["full"]).otherwise(content_key(c["snippet"]))
        return F.struct((-score).alias("k1"), (-c["kind"]).alias("k2"), c["index"].alias("k3"), c["seq"].alias("k4"), score.alias("score"), said.alias("said"), c.alias("of"))

    return F.array_sort(F.transform(candidates, one))


def collapsed(ranked: Column) -> Column:
    """Of the candidates with the top score, one for each content: the best ranked."""
    return let(ranked, _collapsed)


def _collapsed(ranked: Column) -> Column:
    top = F.try_element_at(ranked, F.lit(1))["score"]
    tied = F.filter(ranked, lambda c: c["score"] == top)
    first = F.filter(tied, lambda c, i: ~F.exists(F.slice(tied, F.lit(1), i), lambda d: d["said"] == c["said"]))
    return F.concat(first, F.filter(ranked, lambda c: c["score"] != top))


def margin(ranked: Column) -> Column:
    return F.when(F.size(ranked) > 1, F.try_element_at(ranked, F.lit(1))["score"] - F.try_element_at(ranked, F.lit(2))["score"])


def rank_rows(rows: DataFrame, keys: list[str], score: str, weight: str, index: str, seq: str) -> DataFrame:
    """The same ranking over rows, for candidates kept in a table: rank and margin to the next."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(weight), index, seq)
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.when(F.col("rank") == 1, F.col(score) - F.lead(score).over(w)))
