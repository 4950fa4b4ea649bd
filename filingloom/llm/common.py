"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gives freed memory back, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only in local mode, where one machine runs all, a
    temporary folder stands in for a missing one; a cluster without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: operators write intermediate tables to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="filingloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor never replays what lies before.

    The tables lie below ``<shared folder>/filingloom-<application id>``. ``discard`` deletes one that nothing reads any
    more; those that a returned DataFrame still reads stay until ``forget`` or whoever owns the folder deletes them.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/filingloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that no DataFrame in use reads."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def forget(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder. DataFrames that read it cannot be used afterwards."""
    _delete(spark, _own_dir(spark))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that where every character is one byte."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def byte_table(is_word, lower: bool = True) -> bytes:
    """A ``bytes.translate`` table that turns what is no word byte into a space and lower-cases A-Z."""
    out = bytearray(range(256))
    for b in range(256):
        if lower and 0x41 <= b <= 0x5A:
            out[b] = b + 32
        elif not is_word(b):
            out[b] = 0x20
    return bytes(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 over uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """Polynomial hashes modulo 2**64 of any ranges of a byte string, from one prefix sum.

    Equal ranges have equal hashes; unlike ones may be made to collide, so this finds candidates and proves nothing.
    Powers are kept between texts and grow to the longest one seen.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.pow = np.ones(1, np.uint64)
        self.inv = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pow) <= n:
            size = 1 << max(12, int(n).bit_length())
            inverse = pow(self.BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                for name, base in (("pow", self.BASE), ("inv", inverse)):
                    step = np.full(size, base, np.uint64)
                    step[0] = 1
                    setattr(self, name, np.multiply.accumulate(step))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of byte * BASE**position, one longer than ``data``."""
        n = len(data)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.pow[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64))


class WordHash:
    """64-bit hashes of words under a key: eight bytes at a time are mixed in; long words go through keyed BLAKE2b.

    The key is drawn anew for each run (``secret``), so no text can be written to collide.
    """

    LONG = 256
    _MASK = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.seed, odd = np.frombuffer(hashlib.blake2b(key, digest_size=16).digest(), np.uint64)
        self.odd = odd | np.uint64(1)

    def of(self, data: bytes) -> np.ndarray:
        """Hashes of the words of a text that holds one space between words and none at its ends."""
        raw = np.frombuffer(data + bytes(8), np.uint8)
        gap = np.flatnonzero(raw[:-8] == 32)
        at, end = np.append(0, gap + 1), np.append(gap, len(data))
        left = end - at
        out = mix64(self.seed + left.astype(np.uint64))
        eights = np.lib.stride_tricks.as_strided(raw, (len(data) + 1, 8), (1, 1))
        for i in np.flatnonzero(left > self.LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[at[i] : end[i]], digest_size=8, key=self.key).digest(), "little")
        live = np.flatnonzero(left <= self.LONG)
        at, left = at[live], left[live]
        while len(live):
            block = eights[at].view(np.uint64).ravel()
            short = np.flatnonzero(left < 8)
            block[short] &= self._MASK[left[short]]
            out[live] = mix64((out[live] ^ block) * self.odd)
            more = np.flatnonzero(left > 8)
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return out


def secret() -> bytes:
    """A key for the hashes of one run; the driver draws it and the tasks get it with their code."""
    return uuid.uuid4().bytes


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def slices(batches, rows: int = 256) -> Iterator:
    """Arrow batches in parts of a few rows, so that few texts are Python objects at a time. At the end of a task its
    memory goes back to the machine, since the worker stays for other stages."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int, seed: int = 0) -> DataFrame:
    """At most ``limit`` labelled documents, in the order of a hash of their id: doc_id, text, y, at (that hash).

    train: which rows of ``labels`` may be used. Several labels of an id count as their largest; several texts of an
    id likewise, so repeated rows cannot pass the limit. What is broadcast are the ids, at most ``limit``.
    """
    at = F.xxhash64("doc_id", F.lit(seed))
    some = labels.where(train & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    some = some.withColumn("at", at).orderBy("at", "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"), F.max("at").alias("at"))


def crc_mod(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))
