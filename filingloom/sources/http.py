"""Documents over HTTP: one place that opens URLs, tries again where the archive is busy, and keeps to its rate.

``fetch_documents`` reads a listing's locators on the executors. The rate is shared out: a listing is dealt to ``lanes``
partitions, and each lane keeps to its part of the rate, so all of them together do, however many run at a time. Rows
are retried with their task, so a lost executor asks again for what its lanes had open.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Requests a second, tries after the first, and the seconds that random waiting adds at most.
RATE, MOST, JITTER = 5.0, 4, 0.5


def busy(status: int) -> bool:
    """Whether the archive may answer later."""
    return status in (403, 429) or status >= 500


def pause(attempt: int, stated: str | None, jitter: float) -> float:
    """Seconds to wait: as long as the archive states, else twice as long each time and a random bit more."""
    try:
        return max(0.0, float(stated))
    except (TypeError, ValueError):
        return 2.0**attempt + jitter


def get(url: str, agent: str, most: int = MOST, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep, chance: Callable[[], float] = random.random) -> bytes:
    """The bytes behind a URL. What is missing fails at once; a busy archive is asked ``most`` times more."""
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    for attempt in range(most + 1):
        try:
            with opener(request, timeout=60) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if not busy(e.code) or attempt == most:
                raise
            sleep(pause(attempt, e.headers.get("Retry-After") if e.headers else None, JITTER * chance()))
        except (urllib.error.URLError, TimeoutError):
            if attempt == most:
                raise
            sleep(pause(attempt, None, JITTER * chance()))
    raise AssertionError("unreachable")


def fetch_documents(listing: DataFrame, agent: str, locator: str = "locator", rate: float = RATE, lanes: int = 4, most: int = MOST) -> DataFrame:
    """``listing`` with content and error: the bytes behind each locator, or what kept them away."""
    if "@" not in agent or " " not in agent.strip():
        raise ValueError("the archive asks for a name and a mail address as user agent")
    kept = [f for f in listing.schema.fields if f.name not in ("content", "error")]
    gap = lanes / rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = time.monotonic()
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                content, errors = [], []
                for url in part.column(locator).to_pylist():
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = max(due, time.monotonic()) + gap
                    try:
                        content.append(get(url, agent, most))
                        errors.append(None)
                    except (OSError, ValueError) as e:  # ValueError: no URL at all
                        content.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.record_batch([*(part.column(f.name) for f in kept), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=[*(f.name for f in kept), "content", "error"])

    schema = StructType([*kept, StructField("content", BinaryType()), StructField("error", StringType())])
    return listing.repartition(lanes, F.xxhash64(locator)).mapInArrow(run, schema)
