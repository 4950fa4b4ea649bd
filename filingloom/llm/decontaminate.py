"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 10 consecutive words of the test items (an item of fewer words is one window). For each window
length there is a shift table over blocks of two words: it tells how far the scan may move on, since no window can end
sooner. Where the shift is 0, the bucket of that suffix block lists the windows that end so, told apart by their first
two words, and a direct comparison of all words confirms an occurrence. Texts are scanned as bytes, whole.

The distinct windows are worked out on the executors and written to the shared folder. The driver streams them into
blocks of ``BLOCK`` windows, each broadcast on its own, and holds one block at a time. The documents are scanned once, for
any number of blocks: a task takes texts of ``CHUNK`` bytes, runs them through block after block and puts together what
they find; it holds one block and one chunk.

Defined results: null and empty texts have no words; a null or wordless item has no window; repeated items share their
windows; null item ids are left out of the id list but still mark words; repeated doc_ids are scanned and returned row
by row; an empty benchmark leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import byte_table, discard, materialise, merged, slices, table

WINDOW = 10
#: Windows of a block, some 2 KB each with their tables, and bytes of text that go through several blocks together.
BLOCK, CHUNK = 50_000, 64 << 20
WORDS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and all beyond ASCII."""
    return data.translate(WORDS).split() if data else []


def windows_of(words: list[bytes], width: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if 0 < len(words) < width:
        yield tuple(words)
    for i in range(len(words) - width + 1):
        yield tuple(words[i : i + width])


class WuManber:
    """Search for word tuples of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list], width: int) -> None:
        self.patterns, self.width = patterns, width
        self.block = min(2, width)
        self.far = width - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list]] = {}
        for p in patterns:
            for end in range(self.block, width + 1):
                key = b" ".join(p[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.far), width - end)
            suffix, head = b" ".join(p[-self.block :]), b" ".join(p[: self.block])
            self.buckets.setdefault(suffix, {}).setdefault(head, []).append(p)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(position, pattern) of each occurrence."""
        shift, far, width, block = self.shift.get, self.far, self.width, self.block
        end, last = width, len(words)
        while end <= last:
            key = words[end - 2] + b" " + words[end - 1] if block == 2 else words[end - 1]
            move = shift(key, far)
            if move:
                end += move
                continue
            start = end - width
            for p in self.buckets[key].get(b" ".join(words[start : start + block]), ()):
                if all(map(bytes.__eq__, words[start:end], p)):
                    yield start, p
            end += 1


class Matcher:
    """One Wu-Manber search for each window length: short items do not shorten the shifts of long ones."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list]]) -> None:
        by_width: dict[int, dict] = {}
        for p, items in windows:
            by_width.setdefault(len(p), {}).setdefault(p, []).extend(items)
        self.searches = [WuManber(p, width) for width, p in sorted(by_width.items())]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words and the ids of the items that occur."""
        spans, items = [], set()
        for s in self.searches:
            for at, p in s.occurrences(words):
                spans.append((at, at + s.width))
                items.update(s.patterns[p])
        return merged(spans), items


@dataclass
class Block:
    """Windows as (words joined by spaces, item ids), sent to the executors."""

    name: str
    windows: Broadcast

    def matcher(self, keep: bool) -> Matcher:
        """keep: it is the only block, so it is built once in a worker, not once for each task."""
        if self.name in _MATCHERS:
            return _MATCHERS[self.name]
        _MATCHERS.clear()
        made = Matcher([(tuple(w.split(b" ")), ids) for w, ids in self.windows.value])
        vars(self.windows).pop("_value", None)  # it lies on disk; the next who needs it reads it again
        if keep:
            _MATCHERS[self.name] = made
        return made


_MATCHERS: dict[str, Matcher] = {}


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """words (joined by spaces), ids (those of the items that have the window, sorted): a row for each distinct window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [(i, b" ".join(p)) for i, data in zip(*(batch.column(c).to_pylist() for c in ("id", "data")), strict=True) for p in windows_of(words_of(data), width)]
            yield pa.record_batch([pa.array([w for _, w in out], pa.binary()), pa.array([i for i, _ in out], pa.string())], names=["words", "id"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(windows, "words binary, id string").groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def blocks_of(windows: DataFrame) -> list[Block]:
    """The windows in blocks of at most ``BLOCK``, sent one after another; without windows one empty block."""
    written, blocks, block = materialise(windows, "benchmark-windows"), [], []
    send = lambda: blocks.append(Block(uuid.uuid4().hex, windows.sparkSession.sparkContext.broadcast(block)))
    for row in written.toLocalIterator():
        block.append((bytes(row["words"]), list(row["ids"])))
        if len(block) >= BLOCK:
            send()
            block = []
    if block or not blocks:
        send()
    discard(written)
    return blocks


def _chunks(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together to ``CHUNK`` bytes of text."""
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.column(text_col).nbytes
        if size >= CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _scanner(blocks: list[Block], text_col: str, keep_clean: bool):
    alone = len(blocks) == 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches) if alone else _chunks(batches, text_col):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            n_words, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for block in blocks:
                matcher = block.matcher(alone)
                for i, data in enumerate(texts):
                    if keep_clean and spans[i]:
                        continue
                    words = words_of(data)
                    found, ids = matcher.scan(words)
                    n_words[i] = len(words)
                    spans[i] += found
                    items[i] |= ids
            if keep_clean:
                yield batch.filter(pa.array([not s for s in spans], pa.bool_()))
                continue
            hits = [[{"start": a, "end": b} for a, b in merged(s)] for s in spans]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "spans", "item_ids"],
            )

    return scan


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, spans of hit words, item_ids sorted as strings."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("scan_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scanner(blocks_of(benchmark_windows(benchmark)), "scan_bytes", False), f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    return docs.mapInArrow(_scanner(blocks_of(benchmark_windows(benchmark)), text_col, True), docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
), hit AS (
  SELECT d.doc_id, d.i, d.n, p.item_id FROM d JOIN p ON d.n = p.n AND d.k = p.k
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
