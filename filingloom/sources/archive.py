"""Sources in two steps, and a cache that is an archive itself.

``list`` says what there is without opening a document; ``read`` opens those that were chosen, and no others. A source is
anything with these two operations; ``ArchiveSource`` serves folder trees of any store that pyarrow can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from filingloom.sources import filings as S


class FilingSource(Protocol):
    def list(self, tickers: list[str] | None = None, forms: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
        """Filings without their content: ticker, form, filing_date, suffix, locator, bytes."""

    def read(self, listing: DataFrame) -> DataFrame:
        """The rows of a listing with their content; null where a document cannot be read."""


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def read_documents(listing: DataFrame, locator: str = "locator") -> DataFrame:
    """``listing`` with the bytes behind each locator, read where the row is."""
    kept = [f for f in listing.schema.fields if f.name != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part, content = batch.slice(at, 16), []
                for path in part.column(locator).to_pylist():
                    try:
                        store, inner = _open(path)
                        with store.open_input_stream(inner) as f:
                            content.append(f.read())
                    except OSError:
                        content.append(None)
                yield pa.record_batch([*(part.column(f.name) for f in kept), pa.array(content, pa.binary())], names=[*(f.name for f in kept), "content"])

    return listing.mapInArrow(run, StructType([*kept, StructField("content", BinaryType())]))


class ArchiveSource:
    """A tree of <ticker>/<form>/<date>_<form>[_<token>].<suffix>."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def list(self, tickers: list[str] | None = None, forms: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
        """Years prune files by name before anything is listed further; the content column is never asked for."""
        names = "*.{html,htm,txt}" if not years else "{" + ",".join(f"{y:04d}" for y in years) + "}-*.{html,htm,txt}"
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(self.root)
        return S.list_filings(S.parse_paths(files.select("path", F.col("length").alias("bytes"))), tickers, forms, years)

    def read(self, listing: DataFrame) -> DataFrame:
        return read_documents(listing)


class HistorySource:
    """Filings of history files of an archive that serves documents by URL; ``root`` stands in for the archive's address,
    so a mirror in any store can be read."""

    def __init__(self, history: DataFrame, root: str) -> None:
        self.history, self.root = history, root

    def list(self, tickers: list[str] | None = None, forms: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
        """history: ticker, cik, form, filing_date, accession, document."""
        url = S.archive_url(F.col("cik"), F.col("accession"), F.col("document"), F.col("filing_date"))
        rows = self.history.withColumn("locator", F.replace(url, F.lit(S.ARCHIVE), F.lit(self.root))).withColumn("suffix", F.regexp_extract("locator", r"\.(\w+)$", 1))
        return S.list_filings(rows.where(F.coalesce("accession", F.lit("")) != ""), tickers, forms, years)

    def read(self, listing: DataFrame) -> DataFrame:
        return read_documents(listing)


def default_cache() -> str:
    """Where documents are cached unless told otherwise: a setting of the environment, its cache folder, or the home's."""
    base = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.environ.get("FILINGLOOM_CACHE") or os.path.join(base, "filingloom")


def write_archive(filings: DataFrame, root: str) -> DataFrame:
    """Keep documents (ticker, form, filing_date, suffix, content, and token or locator) as files that ``scan`` and
    ``ArchiveSource`` read. Each file is written aside and moved into place, so it is there whole or not at all, and
    writing it again changes nothing; empty documents are refused. The writing happens when the result (locator,
    bytes) is used."""
    tok = F.col("token") if "token" in filings.columns else S.token(F.lit(""), F.col("locator"))
    path = S.cache_path(F.col("ticker"), F.col("form"), F.col("filing_date"), tok, F.col("suffix"))
    rows = filings.where(F.octet_length("content") > 0).select(F.concat(F.lit(root.rstrip("/") + "/"), path).alias("locator"), F.col("content").cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = batch.column("locator").to_pylist(), []
            for path, content in zip(paths, batch.column("content").to_pylist(), strict=True):
                store, inner = _open(path)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                with store.open_output_stream(inner + ".part") as f:
                    f.write(content)
                store.move(inner + ".part", inner)
                sizes.append(len(content))
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["locator", "bytes"])

    return rows.mapInArrow(run, StructType.fromDDL("locator string, bytes bigint"))


def through_cache(wanted: DataFrame, cache: ArchiveSource, source: FilingSource) -> DataFrame:
    """The content of ``wanted`` (a listing with token): from the cache where it holds a file of that token, else from the source."""
    held = cache.list().withColumn("token", F.regexp_extract("locator", r"_([^_/]+)\.\w+$", 1)).where((F.col("token") != "") & (F.col("bytes") > 0))
    held = held.groupBy(F.col("token").alias("_token")).agg(F.min_by("locator", S.suffix_rank(F.col("suffix"))).alias("_held"))
    split = wanted.join(held, F.col("token") == F.col("_token"), "left").drop("_token")
    cached = read_documents(split.where(F.col("_held").isNotNull()), "_held")
    fetched = source.read(split.where(F.col("_held").isNull()))
    return reduce(DataFrame.unionByName, (part.withColumn("from_cache", F.col("_held").isNotNull()).drop("_held") for part in (cached, fetched)))

