"""Line dedup: drop lines that many documents share.

Lines are exploded as normalised keys, hashed to 128 bits, and the distinct documents of each hash are counted; lines
of frequent keys go and the rest is put together again by position. DataFrame functions only.

Shuffles: the distinct (hash, document) pairs once, so that a line in a third of all documents is spread over the
documents; one partial sum for each hash and task; the pairs against the frequent hashes (a plain sort-merge join,
which AQE may split or turn into a broadcast after seeing its real size); and the texts once by document.

Defined results: a null or empty text is one empty line; an empty key is never dropped; rows with the same doc_id are
one document when documents are counted, and each is returned; a null doc_id is one document; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import ascii_lower, table

SPACES = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key, F.length(key)).alias("b"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_row: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text (what is kept), n_lines, n_dropped; with keep_row also row, all its columns."""
    whole = [F.struct(*docs.columns).alias("row")] if keep_row else []
    lines = docs.select(*whole, F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    keys = lines.select("doc_id", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("key"))
    keys = keys.where(F.length("key") >= min_chars).select("doc_id", _hashes(F.col("key")).alias("h"))
    pairs = keys.select("doc_id", "h.a", "h.b").distinct()
    frequent = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b")
    drops = pairs.join(frequent, ["a", "b"]).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("drops"))
    joined = lines.join(drops.withColumnRenamed("doc_id", "drop_id"), F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda line: ~((F.length(line_key(line)) >= min_chars) & F.array_contains(F.col("drops"), _hashes(line_key(line)))))
    )
    whole = ["row"] if keep_row else []
    return joined.select(*whole, "doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")).select(
        *whole, "doc_id", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), frequent AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k
GROUP BY doc_id
"""
