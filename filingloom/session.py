"""A session with the settings that the engine is tuned for; any session works."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Filings are large: few of them at a time in a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def session(app: str = "filingloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
