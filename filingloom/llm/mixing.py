"""Mixing sources to target weights by Poisson replication.

Each source's mean repetition rate is its target share of the mixture over its present share of the characters. A
document's count is a Poisson variable of that mean, inverted from a uniform number that is hashed from the seed and
the document's id; so it is the same in every run and on every executor. Documents are exploded by their counts and
dealt out anew by a hash of id and copy, then sorted by it: a global shuffle without a sampling pass. DataFrame
functions only.

The statistics are one partial sum for each source and task, so a source with a third of all rows costs nothing more.
They are written first, and the join has no hint: Spark broadcasts them when their measured size allows, and otherwise
sorts and merges, splitting a hot source.

Defined results: a null source is a source of its own; null text counts as empty; sources without characters get rate 0
unless every text is empty, when rows are counted in place of characters; a tiny source with a share of its own is
repeated as often as that share takes, thousands of times if need be, unless ``most_rate`` bounds the mean; repeated rows of one id share their count and
are all copied; documents drawn 0 times do not appear; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import materialise, table

#: Hash digits of the uniform number: 13 hex digits are 52 bits.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the SHA-256 of the parts, joined by colons."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return (F.conv(F.substring(F.sha2(text, 256), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k whose cumulative probability exceeds ``u``.

    The sum runs so far that the tail beyond it is below the smallest step of ``u``; rates above 500 are sums of
    chunks in log space, so exp(-rate) never underflows to a wrong count.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = F.when(rate < 500, acc["p"] * rate / i).otherwise(F.exp(i * F.log(rate) - rate - _log_factorial(i)))
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["k"] + F.when(acc["c"] <= u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda acc: acc["k"])


def _log_factorial(i: Column) -> Column:
    """Stirling's series; only used far from 0."""
    x = i.cast("double") + 1
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_rate: float | None = None
) -> DataFrame:
    """All columns of ``docs`` for each copy, with mix_copy (from 1), mix_copies and mix_key before them (in place of such columns of ``docs``).

    ``weights``: target shares by source, scaled to a sum of 1; sources that it lacks get none. None: equal shares.
    ``epochs``: characters of the mixture over characters of the input. ``most_rate``: the most that a source's documents
    are repeated on average; what a source falls short of its share then is left out of the mixture. None: no bound.
    """
    docs = docs.drop("mix_source", "mix_rate", "mix_copy", "mix_copies", "mix_key")
    chars = F.length(F.coalesce(F.col(text_col), F.lit("")))
    stats = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("rows"))
    if weights is None:
        stats = stats.withColumn("weight", F.lit(1.0))
    else:
        named = stats.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        stats = stats.join(named, F.col("mix_source") == F.col("name"), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    stats = materialise(stats, "mix-stats")  # a row for each source, of known size: no need to shuffle texts to find out
    all_chars, all_rows = stats.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    size = (F.col("chars") if all_chars else F.col("rows")).cast("double")
    weight = F.when(size > 0, F.col("weight")).otherwise(0.0)
    all_weight = stats.agg(F.sum(weight)).first()[0] or 1.0
    rate = F.when(weight > 0, F.col("weight") / float(all_weight) * float(all_chars or all_rows) * float(epochs) / size).otherwise(0.0)
    rates = stats.select("mix_source", (rate if most_rate is None else F.least(rate, F.lit(float(most_rate)))).alias("mix_rate"))
    drawn = docs.join(rates, docs[source_col].eqNullSafe(F.col("mix_source"))).withColumn("mix_copies", poisson_inverse(uniform(F.lit(seed), docs[id_col]), F.col("mix_rate")))
    copies = drawn.where(F.col("mix_copies") > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    copies = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), docs[id_col], F.col("mix_copy")))
    out = copies.select("mix_copy", "mix_copies", "mix_key", *(docs[c] for c in docs.columns))
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), seed=17)
    return mixed.select("doc_id", "source", F.col("mix_copy").cast("long").alias("copy"), F.col("mix_copies").cast("long").alias("n_copies"), "text")


OP10_SQL = r"""
WITH RECURSIVE s AS (
  SELECT source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY source
), r AS (
  SELECT source, CASE WHEN chars > 0 THEN
    1.0::DOUBLE / (SELECT count(*) FROM s WHERE chars > 0) * (SELECT sum(chars) FROM s)::DOUBLE / chars ELSE 0 END AS rate FROM s
), cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 40)
), d AS (
  SELECT doc_id, source, text, ((('0x' || substr(sha256('17:' || doc_id::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents
), n AS (
  SELECT d.doc_id, count(*) AS n_copies FROM d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u GROUP BY d.doc_id
)
SELECT d.doc_id, d.source, unnest(range(1, n.n_copies + 1)) AS copy, n.n_copies, d.text FROM d JOIN n USING (doc_id)
"""
