"""Request limits and caches over time: folds per key whose state feeds back, so windows cannot express them.

Events of a key are folded in order as sorted batches stream through (``_fold``): a key's state is small and bounded by
its limit, and no key is ever held whole, however many of the rows it has. In-flight counts need no fold and are a
running sum.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _fold(events: DataFrame, key: str, ts: str, order: str, schema: str, start: Callable, step: Callable) -> DataFrame:
    """(order, *schema) of each event; ``step(state, seconds)`` gives the row's values. Times travel as microseconds."""
    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("o"))
    kind = dict(rows.dtypes)["o"]
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if state is None or k != key_now:
                    key_now, state = k, start()
                out.append(step(state, t))
            yield pa.record_batch([batch.column("o"), *(pa.array([r[i] for r in out], kinds[i]) for i in range(len(kinds)))], names=["o", *names])

    sorted_rows = rows.repartition("k").sortWithinPartitions("k", "t", "o")
    return sorted_rows.mapInArrow(run, f"o {kind}, {schema}").withColumnRenamed("o", order)


def sliding_limit(events: DataFrame, key: str, ts: str, order: str, limit: int = 60, window_s: int = 300) -> DataFrame:
    """allowed, remaining and retry_after of each request; refused requests do not count."""
    window = window_s * 1_000_000

    def step(hits: deque, t: int) -> tuple:
        while hits and hits[0] <= t - window:
            hits.popleft()
        if len(hits) >= limit:
            return False, 0, max(1, (hits[0] + window - t) // 1_000_000 + 1)
        hits.append(t)
        return True, limit - len(hits), 0

    return _fold(events, key, ts, order, "allowed boolean, remaining int, retry_after bigint", deque, step)


def token_bucket(events: DataFrame, key: str, ts: str, order: str, rate: float = 4.0) -> DataFrame:
    """When each request may go out at ``rate`` a second: at once, or 1/rate after the one before (microseconds)."""
    gap = round(1_000_000 / rate)

    def step(state: dict, t: int) -> tuple:
        sent = max(t, state["next"])
        state["next"] = sent + gap
        return (sent, sent - t)

    return _fold(events, key, ts, order, "sent_us bigint, waited_us bigint", lambda: {"next": -(1 << 62)}, step)


def ttl_cache(events: DataFrame, key: str, ts: str, order: str, ttl_s: int = 86_400) -> DataFrame:
    """Whether each lookup hits: an entry lives ``ttl_s`` from when it was put, and hits do not prolong it."""
    ttl = ttl_s * 1_000_000

    def step(state: dict, t: int) -> tuple:
        hit = state["put"] is not None and t - state["put"] <= ttl
        if not hit:
            state["put"] = t
        return (hit,)

    return _fold(events, key, ts, order, "hit boolean", lambda: {"put": None}, step)


def in_flight(intervals: DataFrame, start: str, end: str, bucket: str, slot_s: int = 3600) -> DataFrame:
    """The most intervals open at once in each bucket, ends first at one instant.

    Time is cut into slots: what opens and closes within a slot is summed first, a running sum over a bucket's slots gives
    what each begins with, and only a slot's own ends are put in order together; so a busy bucket is many tasks.
    """
    time, slot = F.unix_micros(F.col("at").cast("timestamp")), F.col("t").cast("long")
    ends = intervals.select(F.col(bucket).alias("key"), F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.select("key", "e.at", "e.d").select("key", "d", time.alias("t")).withColumn("slot", F.floor(slot / (slot_s * 1_000_000)))
    sums = ends.groupBy("key", "slot").agg(F.sum("d").alias("net"))
    before = F.coalesce(F.sum("net").over(Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = sums.select(F.col("key").alias("k"), F.col("slot").alias("s"), before.alias("base"))
    w = Window.partitionBy("key", "slot").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    within = ends.withColumn("open", F.sum("d").over(w)).groupBy("key", "slot").agg(F.max("open").alias("open"))
    peaks = within.join(begin, within["key"].eqNullSafe(F.col("k")) & (within["slot"] == F.col("s")))
    return peaks.groupBy(F.col("key").alias(bucket)).agg(F.max(F.col("base") + F.col("open")).cast("long").alias("peak"))
