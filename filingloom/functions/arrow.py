"""Appending a Python-made column to a DataFrame batch by batch.

``mapInArrow`` is a barrier in the plan: what it makes is computed once, however often it is used afterwards.
"""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StringType, StructField, StructType, _parse_datatype_string


def _within(seconds: float, make: Callable, *row):
    """``make(*row)``, stopped by a timer of the worker's process."""

    def stop(*_):
        raise TimeoutError(f"a row took more than {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return make(*row)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def append(df: DataFrame, name: str, kind: str, inputs: list[str], make: Callable, drop: tuple[str, ...] = (), error: str | None = None, limit_s: float | None = None) -> DataFrame:
    """``df`` with a column: ``make`` of the input columns' values of each row. Columns in ``drop`` go in but do not come back.

    error: a string column that gets the name of what ``make`` raised, the new column being null then; without it a row
    that fails fails the job. A name that is there already stays. limit_s: seconds that one row may take; then it fails
    with a TimeoutError.
    """
    spark_type: DataType = _parse_datatype_string(kind)
    arrow_type = to_arrow_type(spark_type)
    kept = [f for f in df.schema.fields if f.name not in (name, error, *drop)]
    names = [f.name for f in kept]
    had = error in df.columns
    timed = make if limit_s is None else partial(_within, limit_s, make)

    def guarded(*row):
        try:
            return timed(*row), None
        except Exception as e:  # whatever a document brings about is that document's result
            return None, type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)
            if error is None:
                more = {name: pa.array([timed(*row) for row in rows], arrow_type)}
            else:
                made = [guarded(*row) for row in rows]
                before = batch.column(error).to_pylist() if had else [None] * len(made)
                more = {name: pa.array([m for m, _ in made], arrow_type), error: pa.array([old or new for old, (_, new) in zip(before, made, strict=True)], pa.string())}
            yield pa.record_batch([*(batch.column(c) for c in names), *more.values()], names=[*names, *more])

    added = [StructField(name, spark_type), *([StructField(error, StringType())] if error else [])]
    return df.mapInArrow(run, StructType([*kept, *added]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, though used many times."""
    return F.element_at(F.transform(F.array(value), use), 1)
