"""Chat formatting of reply trees.

A message points to the message that it answers. Jump tables of 1, 2, 4, ... replies, each a self-join of the one
before, give every message its root and the score of its whole branch in log2(depth) joins; leaves are ranked by
branch score within their tree and the best ones are walked back to the root by the same tables, so that a path of any
length takes log2(depth) joins more. Each chosen path becomes one conversation. DataFrame functions only.

The joins carry ids and scores; texts are joined once, to the chosen paths, and a path's messages meet only to be put
into their one string. Rounds are written to the shared folder, so none is computed twice.

Template: ``<|turn|>role<|text|>text<|end|>`` and a line feed for each turn. A backslash in a role or text is doubled
and one is put behind the first character of each control string, this template's or another common one's, so texts
can neither end a turn nor open one, and ``unescape`` gives them back.

Defined results: null role or text is empty; a null tree id is one tree; a parent that does not exist makes its child
a root; turns that tie are ordered by role and text, with both kept; a message that is on a cycle of replies reaches no
root and is left out, as are its branches; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.llm.common import materialise, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common others, without their first character.
_TAILS = r"\|[a-z_]+\|>|/?s>|<SYS>>|</SYS>>|/?INST\]"
_CONTROL = rf"([<\[])(?={_TAILS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _jump_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up, sum) for 1, 2, 4, ... replies, and (tree, node, sum) of each node's whole branch.

    A table holds only the nodes that lie as deep, so the rounds shrink; the others are done, and their sums complete
    those of the nodes that point to them.
    """
    nodes = materialise(nodes, "chat-nodes")
    n = nodes.count()
    done = [nodes.where(F.col("parent").isNull()).select("tree", "node", F.col("score").alias("sum"))]
    jump = nodes.where(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("sum"))
    tables = []
    while not jump.isEmpty() and 1 << len(tables) <= n:  # what still points up then is on a cycle
        tables.append(jump)
        far = jump.unionByName(_union(done), allowMissingColumns=True).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("sum").alias("sum2"))
        joined = jump.join(far, jump["tree"].eqNullSafe(F.col("t2")) & (jump["up"] == F.col("n2"))).select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"))
        joined = materialise(joined, "chat-jump")
        jump = joined.where(F.col("up").isNotNull())
        done.append(joined.where(F.col("up").isNull()).drop("up"))
    return tables, _union(done)


def choose_paths(messages: DataFrame, top_k: int | None = None) -> DataFrame:
    """(tree, leaf, rank, node, offset) of the ``top_k`` best branches of each tree, by sum of scores; None: all.

    messages: tree, node, parent (null: none), score.
    """
    known = messages.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = nodes.join(known, nodes["tree"].eqNullSafe(F.col("t2")) & (nodes["parent"] == F.col("n2")), "left").select("tree", "node", F.col("n2").alias("parent"), "score")
    tables, whole = _jump_tables(nodes)
    leaves = whole
    if tables:
        answered = tables[0].select(F.col("tree").alias("t2"), F.col("up").alias("n2")).distinct()
        leaves = whole.join(answered, whole["tree"].eqNullSafe(F.col("t2")) & (whole["node"] == F.col("n2")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), "node")))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    parts = [materialise(ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("offset")), "chat-path")]
    for k in range(len(tables) - 1, -1, -1):
        paths, jump = _union(parts), tables[k].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        further = paths.join(jump, paths["tree"].eqNullSafe(F.col("t2")) & (paths["node"] == F.col("n2"))).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("offset") + (1 << k)).alias("offset"))
        parts.append(materialise(further, "chat-path"))
    return _union(parts)


def format_paths(messages: DataFrame, paths: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): loss has the spans (start, length in code points) that training scores."""
    texts = messages.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), *(escape(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("role", "text")), F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("scored"))
    turns = paths.join(texts, paths["tree"].eqNullSafe(F.col("t2")) & (paths["node"] == F.col("n2")))
    turns = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("offset")).alias("at"), "role", "text", "scored"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END + "\n"))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    head, tail = len(TURN) + len(TEXT), len(END) + 1

    def add(acc: Column, t: Column) -> Column:
        at = acc["at"] + head + F.length(t["role"])
        span = F.array(F.struct(at.cast("int").alias("start"), F.length(t["text"]).alias("length")))
        return F.struct((at + F.length(t["text"]) + tail).cast("int").alias("at"), F.when(t["scored"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return turns.select("tree", "leaf", "rank", formatted.alias("formatted"), F.aggregate("turns", start, add, lambda acc: acc["spans"]).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: F.length(x) > 0)
    body = lambda x: F.substring_index(x, END, 1)
    return F.transform(
        pieces,
        lambda x: F.struct(unescape(F.substring_index(body(x), TEXT, 1)).alias("role"), unescape(F.substring_index(body(x), TEXT, -1)).alias("text")),
    )


def scored_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def chain(conversations: DataFrame) -> DataFrame:
    """Conversations as trees in which each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = materialise(chain(rows), "chat-messages")
    out = format_paths(messages, choose_paths(messages))
    out = out.select(F.col("tree").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"), scored_text(F.col("formatted"), F.col("loss")).alias("scored"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("scored").cast("long").alias("loss_chars"),
        F.sha2(F.col("scored").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(role)
    + (length(text) - length(replace(text, '\', ''))) + (length(role) - length(replace(role, '\', '')))
    + len(regexp_extract_all(text, '[<\[](?:\|[a-z_]+\|>|/?s>|<SYS>>|</SYS>>|/?INST\])')) AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(n + 8 + 8 + 7 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
