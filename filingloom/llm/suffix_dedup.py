"""Suffix-array dedup: remove every byte that lies in a string of ``MATCH`` bytes which starts anywhere else as well.

Repeats are found by logarithmic families of suffix arrays (``SuffixFamily``): the corpus comes in ``RANGES`` ranges; the
texts of each range get a suffix array of their own, which is merge-scanned against the arrays of all levels for long
matches; then arrays of one level merge into one of the next, so that a suffix is merged log2(ranges) times. What is
removed is what the scans find, on the bytes themselves.

One array over everything cannot be held, so suffixes are dealt out such that equal strings meet: of the ``SPREAD``
substrings of SEEN - SPREAD + 1 bytes in the first SEEN bytes of a string, the one of the least hash (the first of
equals) is its anchor, and suffixes with one anchor form one family. Neighbouring suffixes share anchors, so they travel
as runs. Counts with partial sums keep the rest at home: an anchor that stands once has no repeats, and of runs that
are one text (by 128 bits of keyed BLAKE2b) two go into the family, which compares their bytes and speaks for all.

An anchor with more than ``HOT`` distinct texts (a passage within very many surroundings) would be too much for one task:
its strings are told apart by 128-bit digests that are counted with partial sums instead, which finds the same.

Beside removal, passages are told: strings of ``SEEN`` bytes that start elsewhere too mark where a document shares a
passage that is too short to be removed.

Defined results: null text is empty; matches neither cross rows nor wrap; rows that are equal, also in doc_id, match each
other; bytes are cut without regard to characters, so what is kept is binary; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import RollingHash, discard, materialise, merged, secret, slices, table

MATCH, SEEN, SPREAD = 400, 272, 176
#: Distinct texts of a family: some 60 KB each while its arrays stand.
HOT = 2500
#: Bytes of a text that are looked at together, ranges of the corpus, and words that a passage exceeds.
SEGMENT, RANGES, PASSAGE = 1 << 20, 8, 50
_LOW = np.uint64(0xFFFFFF)


class Windows:
    """Hashes of all windows of ``k`` bytes of a buffer of at most SEGMENT + ``seen`` bytes; equal windows have equal hashes."""

    def __init__(self, seen: int, spread: int) -> None:
        self.k = seen - spread + 1
        power, inverse = (np.full(SEGMENT + seen, base, np.uint64) for base in (RollingHash.BASE, pow(RollingHash.BASE, -1, 1 << 64)))
        power[0] = inverse[0] = 1
        self.power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=sums[1:])
        out = (sums[self.k :] - sums[: -self.k]) * self.inverse[: len(raw) - self.k + 1]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        return out


def runs(texts: list[bytes], seen: int, spread: int, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, text, first start, last start) of all runs. Texts are laid end to end and taken segment by segment."""
    k, sizes = windows.k, np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = b"".join(texts)
    for base in range(0, max(0, len(data) - seen + 1), SEGMENT):
        raw = np.frombuffer(data[base : base + SEGMENT + seen - 1], np.uint8)
        n = len(raw) - seen + 1
        hashes = windows.hashes(raw)
        keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        least = np.append(keys, np.full(-len(keys) % spread, ~np.uint64(0))).reshape(-1, spread)
        before = np.minimum.accumulate(least, axis=1).ravel()
        after = np.minimum.accumulate(least[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(after[:n], before[spread - 1 : spread - 1 + n]) & _LOW).astype(np.int64)
        # Only starts whose string ends within their own text.
        whole = np.zeros(n + 1, np.int8)
        lo, hi = np.maximum(begin - base, 0), np.minimum(begin + sizes - seen + 1 - base, n)
        here = np.flatnonzero(lo < hi)
        if len(here) == 0:
            continue
        whole[lo[here]] += 1
        whole[hi[here]] -= 1
        start = np.flatnonzero(np.cumsum(whole[:-1]))
        of = anchor[start]
        cut = np.flatnonzero(np.diff(of)) + 1  # the next text's anchor lies in that text
        first, last = start[np.append(0, cut)], start[np.append(cut - 1, len(start) - 1)]
        which = np.searchsorted(begin, base + first, side="right") - 1
        yield hashes[of[np.append(0, cut)]].view(np.int64), which, base + first - begin[which], base + last - begin[which]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of a few rows and, but for single long texts, of few bytes."""
    for batch in slices(batches):
        size, at = np.cumsum([0, *pc.fill_null(pc.binary_length(batch.column("data")), 0).to_pylist()]), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + 4 * SEGMENT, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class SuffixFamily:
    """Suffix arrays of growing size over the texts of one anchor.

    A text has ``starts`` suffixes, each of ``match`` bytes or to the text's end; they are compared by those bytes.
    """

    def __init__(self, match: int, seen: int) -> None:
        self.match, self.seen = match, seen
        #: Per level an array of (suffix, text, start) in order, or None.
        self.levels: list[list[tuple[bytes, int, int]] | None] = []
        self.texts: dict[tuple[bytes, int], int] = {}
        #: Texts that stand twice, as a whole; starts whose match or shorter string stands twice.
        self.whole: set[int] = set()
        self.long: set[tuple[int, int]] = set()
        self.short: set[tuple[int, int]] = set()
        self.waiting: list[tuple[int, bytes, int]] = []

    def add(self, text: bytes, starts: int, twice: bool) -> int:
        """The text's number; a text with the bytes of an earlier one gets that one's."""
        key = self.texts.get((text, starts))
        if key is None:
            key = self.texts[text, starts] = len(self.texts)
            self.waiting.append((key, text, starts))
        else:
            twice = True
        if twice:
            self.whole.add(key)
        return key

    def flush(self) -> None:
        """The waiting texts' array, scanned against the arrays of all levels and merged into them."""
        m = self.match
        new = sorted((text[i : i + m], key, i) for key, text, starts in self.waiting for i in range(starts))
        self.waiting = []
        if not new:
            return
        self._scan(new)
        merges = [sorted(array + new) if array else None for array in self.levels]  # two runs in order: linear merges
        for both in filter(None, merges):
            self._scan(both)
        carry = new
        for i, array in enumerate(self.levels):
            if array is None:
                self.levels[i] = carry
                return
            self.levels[i], carry = None, merges[i] if carry is new else sorted(array + carry)
        self.levels.append(carry)

    def _scan(self, array: list[tuple[bytes, int, int]]) -> None:
        """Neighbours that begin alike. A suffix has its longest match beside it."""
        m, s = self.match, self.seen
        for (a, x, i), (b, y, j) in pairwise(array):
            if a[s - 1] == b[s - 1] and a.startswith(b[:s]):
                self.short.update(((x, i), (y, j)))
                if len(a) == m and a == b:
                    self.long.update(((x, i), (y, j)))

    def spans(self) -> Iterator[tuple[int, tuple[int, int] | None, list[int] | None, list[int] | None]]:
        """Of the texts with repeats: the text; the ends of both kinds of span where it stands twice as a whole, else its
        flat spans of repeated matches and of repeated shorter strings."""
        whole = self.whole
        if len(whole) < len(self.texts) and len(self.texts) > 1:
            self.flush()
        by: dict[int, tuple[list, list]] = {}
        for which, (found, size) in enumerate(((self.long, self.match), (self.short, self.seen))):
            for key, i in found:
                if key not in whole:
                    by.setdefault(key, ([], []))[which].append((i, i + size))
        for (text, starts), key in self.texts.items():
            if key in whole:
                fit = min(starts, len(text) - self.match + 1)
                yield key, (fit - 1 + self.match if fit > 0 else 0, starts - 1 + self.seen), None, None
        for key, (long, short) in by.items():
            yield key, None, [x for s in merged(long) for x in s], [x for s in merged(short) for x in s]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))


def _tag(data: bytes, key: bytes) -> int:
    """Tells texts of one doc_id apart."""
    return int.from_bytes(blake2b(data, digest_size=8, key=key).digest(), "little", signed=True)


def _anchors(seen: int, spread: int):
    """How often each anchor stands, summed within a group of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(seen, spread)
        for batch in _groups(batches):
            if parts := [part[0] for part in runs(batch.column("data").to_pylist(), seen, spread, windows)]:
                anchor, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array(anchor), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return run


def _survey(match: int, seen: int, spread: int, key: bytes):
    """A row for each run: anchor, digest of its text, doc_id, tag, first start and how many more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(seen, spread)
        for batch in _groups(batches):
            texts = batch.column("data").to_pylist()
            parts = list(runs(texts, seen, spread, windows))
            if not parts:
                continue
            anchor, which, first, last = (np.concatenate(c) for c in zip(*parts, strict=True))
            digests = b"".join(blake2b(texts[i][a : b + match] + (b - a).to_bytes(2), digest_size=16, key=key).digest() for i, a, b in zip(which.tolist(), first.tolist(), last.tolist(), strict=True))
            digest, tags = np.frombuffer(digests, np.int64).reshape(-1, 2), np.array([_tag(t, key) for t in texts], np.int64)
            yield pa.record_batch(
                [pa.array(anchor), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), batch.column("doc_id").take(pa.array(which)), pa.array(tags[which]), pa.array(first), pa.array((last - first).astype(np.int16))],
                names=["anchor", "d1", "d2", "doc_id", "tag", "first", "more"],
            )

    return run


def _compressed(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            data = batch.column("data").to_pylist()
            yield pa.record_batch([batch.column("doc_id"), pa.array([_tag(d, key) for d in data], pa.int64()), pa.array([pack.compress(d) for d in data], pa.binary())], names=["doc_id", "tag", "packed"])

    return run


_WANTED = ("anchor", "d1", "d2", "hot", "twice", "more")
_PART = {"anchor": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "hot": pa.bool_(), "twice": pa.bool_(), "more": pa.int16(), "range": pa.int32(), "part": pa.binary()}


def _extract(match: int):
    """The texts of wanted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            wanted = batch.column("wanted")
            sizes, w = pc.list_value_length(wanted).to_pylist(), wanted.flatten()
            first, more = (w.field(c).to_pylist() for c in ("first", "more"))
            parts, at = [], 0
            for packed, n in zip(batch.column("packed").to_pylist(), sizes, strict=True):
                data = unpack.decompress(packed)
                parts += [data[a : a + b + match] for a, b in zip(first[at : at + n], more[at : at + n], strict=True)]
                at += n
            of = np.repeat(batch.column("range").to_numpy(), sizes)
            yield pa.record_batch([*(w.field(c) for c in _WANTED), pa.array(of, pa.int32()), pa.array(parts, pa.binary())], names=list(_PART))

    return run


#: gone and shared are flat (start, end, ...); where a text stands twice as a whole, the two ends alone are given.
_CLASS = {"anchor": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "gone_end": pa.int32(), "shared_end": pa.int32(), "gone": pa.list_(pa.int32()), "shared": pa.list_(pa.int32())}


def _families(match: int, seen: int):
    """Repeated spans of the texts; rows come sorted by anchor and range of the corpus."""
    columns = ("range", "d1", "d2", "twice", "more", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _CLASS]

        def tell(anchor: int, d1: int, d2: int, gone_end: int | None, shared_end: int | None, gone: list | None, shared: list | None) -> None:
            for column, value in zip(out, (anchor, d1, d2, gone_end, shared_end, gone, shared), strict=True):
                column.append(value)

        def settle(anchor: int, rows: list[tuple]) -> None:
            """One anchor's family. Each row: range, d1, d2, twice, more, part."""
            family, names, part_of = SuffixFamily(match, seen), {}, None
            for of, d1, d2, twice, more, part in rows:
                if of != part_of and part_of is not None and len(family.texts) > 1:
                    family.flush()
                part_of = of
                names.setdefault(family.add(part, more + 1, twice), (d1, d2))
            for key, ends, gone, shared in family.spans():
                tell(anchor, *names[key], *(ends or (None, None)), gone, shared)

        def give() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, t) for c, t in zip(out, _CLASS.values(), strict=True)], names=list(_CLASS))
            for column in out:
                column.clear()
            return made

        anchor, rows = None, []
        for batch in slices(batches, 2048):
            anchors = batch.column("anchor").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), len(anchors)]
            every = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
            for a, b in zip(cut, cut[1:], strict=False):
                if anchors[a] != anchor:
                    if rows:
                        settle(anchor, rows)
                    anchor, rows = int(anchors[a]), every[a:b]
                else:
                    rows += every[a:b]
            if len(out[0]) > 10_000:
                yield give()
        if rows:
            settle(anchor, rows)
        yield give()

    return run


def _strings(match: int, seen: int, key: bytes):
    """A digest for each string of hot texts: of match bytes and, if shorter ones are asked for, of seen bytes. Equal ones
    are counted within a slice; whose string it is matters only where it stands once."""
    sizes = (match,) if seen == match else (match, seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s1", "s2", "n", "anchor", "d1", "d2", "at", "long"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        for batch in slices(batches):
            count: Counter[bytes] = Counter()
            owner: dict[bytes, tuple] = {}
            for a, d1, d2, twice, more, part in zip(*(batch.column(c).to_pylist() for c in ("anchor", "d1", "d2", "twice", "more", "part")), strict=True):
                for size in sizes:
                    tail = size.to_bytes(4)
                    for i in range(min(more + 1, len(part) - size + 1)):
                        digest = blake2b(part[i : i + size] + tail, digest_size=16, key=key).digest()
                        count[digest] += 2 if twice else 1
                        owner[digest] = (a, d1, d2, i, size == match)
            both = np.frombuffer(b"".join(count), np.int64).reshape(-1, 2)
            columns = [both[:, 0].copy(), both[:, 1].copy(), list(count.values()), *(zip(*owner.values(), strict=True) if owner else [()] * 5)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _joined(flat: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans given flat."""
    if len(flat) == 0:
        return []
    start, end = flat[::2], flat[1::2]
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(start[1:] > end[:-1]) + 1
    return list(zip(start[np.append(0, new)].tolist(), end[np.append(new - 1, len(end) - 1)].tolist(), strict=True))


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column, null ones empty."""
    values, at = column.flatten().to_numpy(), 0
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield values[at : at + n]
        at += n


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in slices(batches):
        out: list[list] = [[] for _ in range(5)]
        for packed, gone, shared in zip(batch.column("packed").to_pylist(), _lists(batch.column("gone")), _lists(batch.column("shared")), strict=True):
            data, gone = unpack.decompress(packed), _joined(gone)
            kept, at = [], 0
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            passages = sum(len(data[a:b].split()) > PASSAGE for a, b in _joined(shared))
            for column, value in zip(out, (b"".join(kept), len(data), sum(b - a for a, b in gone), len(gone), passages), strict=True):
                column.append(value)
        yield pa.record_batch([batch.column("doc_id"), pa.array(out[0], pa.binary()), *(pa.array(c, pa.int64()) for c in out[1:])], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "n_passages"])


def repeated_spans(rows: DataFrame, key: bytes, match: int, seen: int, spread: int) -> DataFrame:
    """doc_id, tag, gone and shared (flat spans, which may overlap) of the documents (doc_id, data) with repeats."""
    kind = dict(rows.dtypes)["doc_id"]
    long_enough = rows.where(F.octet_length("data") >= seen)
    counts = long_enough.mapInArrow(_anchors(seen, spread), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    # Written, so that the join below does not share the aggregate's partitioning and a hot anchor's rows can be split.
    anchors = materialise(counts.where(F.col("n") > 1).select("anchor"), "suffix-anchors")
    found = long_enough.mapInArrow(_survey(match, seen, spread, key), f"anchor bigint, d1 bigint, d2 bigint, doc_id {kind}, tag bigint, first bigint, more smallint")
    met = materialise(found.join(anchors, "anchor"), "suffix-runs")
    discard(anchors)

    of_text = ["anchor", "d1", "d2"]
    one = F.struct("doc_id", "tag", "first", "more")
    texts = materialise(met.groupBy(*of_text).agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("lo"), F.max(one).alias("hi")), "suffix-texts")
    hot = materialise(texts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot")), "suffix-hot")
    # Two holders of a text that has several; one where they are the same row, repeated, and of hot anchors.
    holders = texts.join(hot, "anchor", "left").withColumn("hot", F.col("hot").isNotNull())
    both = (F.col("n") > 1) & ~F.col("hot") & (F.col("lo") != F.col("hi"))
    holders = holders.select(*of_text, "hot", ((F.col("n") > 1) & ~both).alias("twice"), F.explode(F.when(both, F.array("lo", "hi")).otherwise(F.array("lo"))).alias("of"))
    wanted = holders.groupBy(F.col("of.doc_id").alias("id2"), F.col("of.tag").alias("tag2")).agg(F.collect_list(F.struct(*of_text, "hot", "twice", "of.first", "of.more")).alias("wanted"))
    packed = long_enough.mapInArrow(_compressed(key), f"doc_id {kind}, tag bigint, packed binary")
    part_of = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(RANGES)).cast("int").alias("range")
    joined = packed.join(wanted, packed["doc_id"].eqNullSafe(F.col("id2")) & (packed["tag"] == F.col("tag2"))).select(part_of, "packed", "wanted")
    parts = materialise(joined.mapInArrow(_extract(match), "anchor bigint, d1 bigint, d2 bigint, hot boolean, twice boolean, more smallint, range int, part binary"), "suffix-parts")
    discard(texts)

    dealt = parts.where(~F.col("hot")).repartition("anchor").sortWithinPartitions("anchor", "range")
    kinds = "anchor bigint, d1 bigint, d2 bigint, gone_end int, shared_end int, gone array<int>, shared array<int>"
    classes = dealt.mapInArrow(_families(match, seen), kinds)
    if not hot.isEmpty():
        classes = classes.unionByName(_by_digests(parts.where("hot"), match, seen, key))
    classes = materialise(classes, "suffix-classes")
    discard(parts, hot)
    absolute = lambda which: F.transform(F.coalesce(which, F.array(F.lit(0), F.col(f"{which}_end"))), lambda x: x + F.col("first"))
    some = lambda which: F.when((F.size(which) > 0) | (F.col(f"{which}_end") > 0), absolute(which))
    spans = met.join(classes, of_text).select("doc_id", "tag", *(some(which).alias(which) for which in ("gone", "shared")))
    spans = spans.groupBy("doc_id", "tag").agg(*(F.flatten(F.collect_set(which)).alias(which) for which in ("gone", "shared")))
    spans = materialise(spans, "suffix-spans")
    discard(met, classes)
    return spans


def _by_digests(texts: DataFrame, match: int, seen: int, key: bytes) -> DataFrame:
    """What ``_families`` gives, of texts of hot anchors: their strings without those whose digest stands once."""
    strings = texts.mapInArrow(_strings(match, seen, key), "s1 bigint, s2 bigint, n bigint, anchor bigint, d1 bigint, d2 bigint, at int, long boolean")
    once = strings.groupBy("s1", "s2").agg(F.sum("n").alias("n"), F.min(F.struct("anchor", "d1", "d2", "at", "long")).alias("of")).where(F.col("n") == 1).select("of.*")
    once = once.groupBy("anchor", "d1", "d2").agg(F.collect_list(F.when(F.col("long"), F.col("at"))).alias("not_gone"), F.collect_list(F.when(~F.col("long"), F.col("at"))).alias("not_shared"))
    named = texts.select("anchor", "d1", "d2", "more", F.octet_length("part").alias("size")).join(once, ["anchor", "d1", "d2"], "left")

    def spans(which: str, size: int) -> Column:
        last = F.least(F.col("more").cast("int"), F.col("size") - size)
        alone = F.coalesce(F.col(which), F.array().cast("array<int>"))
        starts = F.when(last >= 0, F.array_except(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), alone)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda i: F.array(i, i + size)))

    shared = spans("not_gone" if seen == match else "not_shared", seen)
    return named.select("anchor", "d1", "d2", F.lit(None).cast("int").alias("gone_end"), F.lit(None).cast("int").alias("shared_end"), spans("not_gone", match).alias("gone"), shared.alias("shared"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, seen: int | None = None, spread: int | None = None) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans and n_passages of each row.

    seen: the least bytes of a shared passage, at most ``match``; n_passages counts the stretches of over 50 words that
    lie in such strings. spread: how many starts may share an anchor; it changes the cost only.
    """
    seen = min(match, SEEN) if seen is None else seen
    spread = max(1, min(SPREAD, seen // 2)) if spread is None else spread
    rows, key = _keyed(docs, id_col, text_col), secret()
    kind = dict(rows.dtypes)["doc_id"]
    spans = repeated_spans(rows, key, match, seen, spread).withColumnsRenamed({"doc_id": "id2", "tag": "tag2"})
    packed = rows.mapInArrow(_compressed(key), f"doc_id {kind}, tag bigint, packed binary")
    joined = packed.join(spans, packed["doc_id"].eqNullSafe(F.col("id2")) & (packed["tag"] == F.col("tag2")), "left").select("doc_id", "packed", "gone", "shared")
    return joined.mapInArrow(_remove, f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, n_passages bigint")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")
