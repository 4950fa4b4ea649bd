"""Filings as they arrive, with Structured Streaming.

A file stream over an archive folder feeds the same stateless extraction as a batch does, so a stream's results are a
batch's. A filing that is delivered again is dropped by its token within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filingloom.plans.extract import extract
from filingloom.profiles import TableProfile
from filingloom.sources import filings as S

#: What the binaryFile source gives; streams need it stated.
FILES = "path string, modificationTime timestamp, length long, content binary"


def filing_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New documents below an archive folder, with identity from their paths and a token."""
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{html,htm,txt}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(per_trigger)).load(root)
    )
    rows = S.parse_paths(files.withColumnRenamed("length", "bytes")).where(F.col("bytes") > 0)
    return rows.withColumn("filing_id", S.token(F.lit(""), F.col("locator")))


def extract_stream(filings: DataFrame, profile: str | TableProfile, watermark: str = "7 days") -> DataFrame:
    """Extractions of a stream, each filing once."""
    fresh = filings.withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["filing_id"])
    return extract(fresh, profile)


def write_extractions(extractions: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet, exactly once by the sink's log; ``once`` takes what is there and stops."""
    writer = extractions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def tumbling(events: DataFrame, size: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Counts and sums of event types by window; ``events`` is a stream or a table."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "12 hours", lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
