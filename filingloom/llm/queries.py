"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filingloom.llm.chat import OP4_SQL, op4_chat_formatting
from filingloom.llm.decontaminate import OP1_SQL, op1_decontamination
from filingloom.llm.jaccard_join import op8_jaccard_join
from filingloom.llm.line_dedup import OP5_SQL, op5_line_dedup
from filingloom.llm.mixing import OP10_SQL, op10_mixing
from filingloom.llm.quality_classifier import op2_quality_classifier
from filingloom.llm.quality_rules import op7_quality_rules
from filingloom.llm.suffix_dedup import op9_suffix_dedup
from filingloom.llm.token_counts import op3_token_counts
from filingloom.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_counts": op3_token_counts,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op10_mixing": OP10_SQL,
}
