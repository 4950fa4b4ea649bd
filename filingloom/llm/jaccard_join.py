"""N-gram Jaccard join over prefix trees.

A document's set holds its distinct word shingles as hashes in one global order: rare ones first, by a fixed-size sketch
of how often each occurs over all documents, then by hash. Two sets of the wanted similarity share a shingle among the
first ones of each (the prefix); so documents meet by the shingles of their prefixes. Where some meet, their ordered
sets are stored in a prefix tree (branches compressed), and each set walks the tree of those no larger than it, sharing
the overlaps found so far on common paths; a subtree is left when what remains of it or of the set cannot bring the
overlap that is needed. Only links that join two components are looked for within a task.

How it keeps together at scale:

* equal sets are one node, found by a digest before anything else, so thousands of copies cost one;
* a first wave meets at the first ``FIRST`` shingles of each prefix that others have too, and joins most groups; the
  second takes the whole prefix but only shingles at which different components still meet. Shingles with the very same members count once;
* in the second wave, parity bits of the sets go to the meetings first; they bound the overlap from above and leave the
  few pairs whose sets are then walked;
* the sketch has a fixed size (256 KB as levels); frequent shingles fall to the end of the order, out of the prefixes;
* hashes are keyed by a secret of the run, and what the trees find counts only after the real shingles of the two texts
  were compared, so no text can be written to be linked with another;
* a shingle at which more than ``GROUP`` nodes meet is dealt to blocks: in the first wave at random, in the second as
  all pairs of blocks, so that no task holds more than two blocks and no link is lost;
* texts travel compressed and only for nodes that may link.

Defined results: null and empty texts have an empty set and are linked with nothing; rows that share a doc_id are one
node with all their texts; a null doc_id has no component; ties go to the smallest doc_id; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.llm.common import WordHash, byte_table, discard, materialise, mix64, secret, slices, table
from filingloom.llm.components import components

CELLS, STRIP = 1 << 18, 256
FIRST, GROUP = 6, 1000
#: Bytes of texts that are hashed together, and shingles of texts that a walk remembers.
GROUPED, KNOWN = 4 << 20, 600_000
HASH_BITS = np.uint64((1 << 58) - 1)
WORDS = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def normalised(data: bytes | None) -> bytes:
    """Lower-cased words with one space between."""
    return b" ".join(data.translate(WORDS).split()) if data else b""


def shingles_of(texts: list[bytes], k: int, hasher: WordHash) -> Iterator[np.ndarray]:
    """Of each normalised text the sorted distinct hashes of its k-word shingles; of fewer words, of all of them as one."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < GROUPED):
            size += len(texts[end])
            end += 1
        group, at = texts[at:end], end
        words = [t.count(b" ") + 1 if t else 0 for t in group]
        x = hasher.of(b" ".join(filter(None, group))) if any(words) else np.zeros(0, np.uint64)
        full = np.full(max(0, len(x) - k + 1), k, np.uint64)  # all windows, those across two texts too
        for i in range(k if len(full) else 0):
            full = mix64(full + x[i : i + len(full)])
        full &= HASH_BITS
        begin = 0
        for n in words:
            if n >= k:
                yield np.unique(full[begin : begin + n - k + 1])
            elif n:
                one = np.full(1, n, np.uint64)
                for i in range(begin, begin + n):
                    one = mix64(one + x[i : i + 1])
                yield one & HASH_BITS
            else:
                yield np.zeros(0, np.uint64)
            begin += n


def real_shingles(text: bytes, k: int) -> set[bytes]:
    """The set itself; words of a normalised text hold no space."""
    words = text.split(b" ")
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CELLS - 1)).astype(np.int64)


def ordered(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order, as numbers that compare in it: the sketch's level above the hash."""
    return np.sort((levels[_cells(tokens)].astype(np.uint64) << np.uint64(58)) | tokens).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """How many first shingles of n must hold one of any set with the wanted similarity."""
    return n - (percent * n + 99) // 100 + 1


def needed(n: int, m: int, percent: int) -> int:
    """The least overlap of sets of n and m."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def mark_of(tokens: np.ndarray) -> bytes:
    """Parity bits of a set, two and more for each shingle: the bits in which two marks differ are no more than the
    shingles in which the sets do."""
    bits = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(a: tuple[int, int, int], b: tuple[int, int, int], percent: int) -> bool:
    """Whether sets (size, mark, bits) may be as similar as wanted: their marks rule nothing out that is."""
    n, x, p = a
    m, y, q = b
    while p > q:
        p >>= 1
        x = (x >> p) ^ (x & ((1 << p) - 1))
    while q > p:
        q >>= 1
        y = (y >> q) ^ (y & ((1 << q) - 1))
    return (x ^ y).bit_count() <= n + m - 2 * needed(n, m, percent)


class PrefixTree:
    """Ordered sets as paths; a node holds a run of numbers, the sets that end with it, and the span of sizes below."""

    __slots__ = ("run", "children", "ends", "low", "high", "any", "mixed")
    STEP = 64

    def __init__(self, run: list[int] | None = None) -> None:
        self.run = run or []
        self.children: dict[int, PrefixTree] = {}
        self.ends: list[tuple[int, int]] = []
        self.low, self.high, self.any, self.mixed = 1 << 60, 0, None, False

    def _meets(self, key: int, size: int, find) -> None:
        self.low, self.high = min(self.low, size), max(self.high, size)
        if self.any is None:
            self.any = key
        elif not self.mixed and find(self.any) != find(key):
            self.mixed = True

    def add(self, tokens: list[int], key: int, find) -> None:
        node, at, size = self, 0, len(tokens)
        while True:
            node._meets(key, size, find)
            if at == size:
                node.ends.append((key, size))
                return
            child = node.children.get(tokens[at])
            if child is None:
                leaf = PrefixTree(tokens[at:])
                leaf._meets(key, size, find)
                leaf.ends.append((key, size))
                node.children[tokens[at]] = leaf
                return
            run, same = child.run, 0
            most = min(len(run), size - at)
            while same < most and run[same] == tokens[at + same]:
                same += 1
            if same < len(run):  # part the run
                upper = PrefixTree(run[:same])
                upper.low, upper.high, upper.any, upper.mixed = child.low, child.high, child.any, child.mixed
                child.run = run[same:]
                upper.children[child.run[0]] = child
                node.children[tokens[at]] = upper
                child = upper
            node, at = child, at + same

    def similar(self, tokens: list[int], key: int, percent: int, find, same) -> Iterator[int]:
        """Keys of stored sets, none larger than this one, with the wanted similarity and of another component."""
        size, own = len(tokens), set(tokens)
        stack = [(self, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if 100 * node.high < percent * size or (not node.mixed and node.any is not None and same(node.any, key)):
                continue
            least = needed(size, node.low, percent)
            run, lost = node.run, False
            for i in range(0, len(run), self.STEP):
                piece = run[i : i + self.STEP]
                overlap += len(own.intersection(piece))
                depth += len(piece)
                if overlap + min(node.high - depth, size - bisect_right(tokens, piece[-1])) < least:
                    lost = True
                    break
            if lost:
                continue
            for other, n in node.ends:
                if overlap >= needed(size, n, percent) and not same(other, key):
                    yield other
            stack.extend((child, overlap, depth) for child in node.children.values())


class Sets:
    """Union-find over node ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def same(self, a: int, b: int) -> bool:
        return self.find(a) == self.find(b)

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _survey(k: int, key: bytes):
    """For each row: doc_id, set size and digest; at a task's end: the task's sketch in strips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch, held, waiting = WordHash(key), np.zeros(CELLS, np.int64), [], 0
        names = ["doc_id", "n", "sid", "strip", "counts"]
        for batch in slices(batches):
            sizes, digests = [], []
            for tokens in shingles_of(list(map(normalised, batch.column("data").to_pylist())), k, hasher):
                sizes.append(len(tokens))
                digests.append(hashlib.md5(tokens.tobytes()).digest())
                held.append(_cells(tokens))
                waiting += len(tokens)
                if waiting > 2_000_000:
                    sketch += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, waiting = [], 0
            n = len(sizes)
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=CELLS)
        strips = [i for i in range(CELLS // STRIP) if sketch[i * STRIP : (i + 1) * STRIP].any()]
        n = len(strips)
        counts = [sketch[i * STRIP : (i + 1) * STRIP].astype("<i8").tobytes() for i in strips]
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(strips, pa.int32()), pa.array(counts, pa.binary())], names=names)

    return run


def _levels(strips: DataFrame) -> np.ndarray:
    """Levels of the summed sketch: 0 up to four times the mean, then one more for each doubling. 1024 rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the strips that come one after another; at most one strip is held."""
        strip, total = None, None
        give = lambda: pa.record_batch([pa.array([strip], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["strip", "counts"])
        for batch in slices(batches):
            for i, counts in zip(batch.column("strip").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if i != strip:
                    if strip is not None:
                        yield give()
                    strip, total = i, np.zeros(STRIP, np.int64)
                total = total + np.frombuffer(counts, "<i8")
        if strip is not None:
            yield give()

    sums = np.zeros(CELLS)
    for row in strips.repartition("strip").sortWithinPartitions("strip").mapInArrow(add, "strip int, counts binary").collect():
        sums[row["strip"] * STRIP : (row["strip"] + 1) * STRIP] = np.frombuffer(bytes(row["counts"]), "<i8")
    ratio = sums / (4 * max(1.0, sums.mean()))
    return np.where(ratio > 1, np.minimum(31, np.floor(np.log2(np.maximum(ratio, 1))) + 1), 0).astype(np.uint8)


def _prefixes(k: int, percent: int, levels: np.ndarray, key: bytes):
    """doc_id, set digest and size, prefix, mark and compressed text; a task leaves out sets that it has given lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, pack, lately = WordHash(key), zstandard.ZstdCompressor(level=5), OrderedDict()
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            texts = list(map(normalised, batch.column("data").to_pylist()))
            for doc_id, text, tokens in zip(batch.column("doc_id").to_pylist(), texts, shingles_of(texts, k, hasher), strict=True):
                if doc_id is None or len(tokens) == 0:
                    continue
                sid = hashlib.md5(tokens.tobytes()).digest()
                if sid in lately:
                    continue
                lately[sid] = None
                if len(lately) > 50_000:
                    lately.popitem(last=False)
                first = ordered(tokens, levels)[: prefix_size(len(tokens), percent)]
                for column, value in zip(out, (doc_id, sid, len(tokens), first, mark_of(tokens), pack.compress(text)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["node", "sid", "n", "prefix", "mark", "body"])

    return run


def _walk(k: int, percent: int, levels: np.ndarray, secret_key: bytes):
    """Links between the members of each meeting; rows come sorted by (lead, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, unpack, sets = WordHash(secret_key), zstandard.ZstdDecompressor(), Sets()
        known: OrderedDict[bytes, list[int]] = OrderedDict()
        weight = 0

        def learn(bodies: list[bytes]) -> None:
            """Sets of texts, worked out together; those not used for longest are forgotten."""
            nonlocal weight
            new = [b for b in dict.fromkeys(bodies) if b not in known]
            for body, tokens in zip(new, shingles_of([unpack.decompress(b) for b in new], k, hasher), strict=True):
                known[body] = ordered(tokens, levels).tolist()
                weight += len(tokens)
            while weight > KNOWN and len(known) > 1:
                weight -= len(known.popitem(last=False)[1])

        def tokens_of(body: bytes) -> list[int]:
            if body not in known:
                learn([body])
            known.move_to_end(body)
            return known[body]

        def alike(a: bytes, b: bytes) -> bool:
            x, y = (real_shingles(unpack.decompress(body), k) for body in (a, b))
            both = len(x & y)
            return 100 * both >= percent * (len(x) + len(y) - both)

        def links(members: dict) -> list[tuple[int, int]]:
            if len(members) < 2:
                return []
            for node, comp in {(node, comp) for (node, _), comp in members.items()}:
                sets.join(node, comp)
            roots = {sets.find(node) for node, _ in members}
            if len(roots) < 2:
                return []
            rows = sorted(((tokens_of(body), node, body) for node, body in members), key=lambda r: (len(r[0]), r[1]))
            find = lambda i: sets.find(rows[i][1])
            same = lambda i, j: sets.same(rows[i][1], rows[j][1])
            tree, found = PrefixTree(), []
            for i, (tokens, node, body) in enumerate(rows):
                for j in tree.similar(tokens, i, percent, find, same):
                    if alike(body, rows[j][2]):
                        sets.join(node, rows[j][1])
                        found.append((rows[j][1], node))
                tree.add(tokens, i, find)
            return found

        def met(rows: list[tuple]) -> list[tuple[int, int]]:
            """Links of all meetings among rows (node, comp, tokens, body) of one lead and block, meeting by meeting."""
            by_token: dict[int, dict[tuple[int, bytes], int]] = {}
            for node, comp, tokens, body in rows:
                for token in tokens:
                    by_token.setdefault(token, {})[node, body] = comp
            return [link for token in sorted(by_token) for link in links(by_token[token])]

        def give(found: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        key, rows, found = None, [], []
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("lead", "block", "node", "comp", "tokens", "body")]
            learn(columns[-1])
            for lead, block, *row in zip(*columns, strict=True):
                if (lead, block) != key:
                    found += met(rows)
                    key, rows = (lead, block), []
                rows.append(row)
            if len(found) > 10_000:
                yield give(found)
                found = []
        yield give(found + met(rows))

    return run


def _pairs(percent: int):
    """Pairs of a meeting's members, of different components, whose sizes and marks allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()

        def pairs(members: list) -> list[tuple[int, int]]:
            members.sort()
            out = []
            for i, (n, node, comp, x, bits) in enumerate(members):
                most = 100 * n // percent
                for m, other, elsewhere, y, more in members[i + 1 :] if i + 1 < len(members) else ():
                    if m > most:
                        break
                    if comp != elsewhere and may_link((n, x, bits), (m, y, more), percent):
                        pair = (min(node, other), max(node, other))
                        if pair not in given:
                            if len(given) > 500_000:
                                given.clear()
                            given.add(pair)
                            out.append(pair)
            return out

        def give(found: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        key, members, found = None, [], []
        for batch in slices(batches):
            for token, block, node, comp, n, mark in zip(*(batch.column(c).to_pylist() for c in ("token", "block", "node", "comp", "n", "mark")), strict=True):
                if (token, block) != key:
                    found += pairs(members)
                    key, members = (token, block), []
                members.append((n, node, comp, int.from_bytes(mark, "little"), 8 * len(mark)))
            if len(found) > 10_000:
                yield give(found)
                found = []
        yield give(found + pairs(members))

    return run


def _one_of_equal(meetings: DataFrame) -> DataFrame:
    """meetings (token, node, comp) without tokens that have one component only or the same members as another; size and lead (the smallest node) added."""
    mark = F.xxhash64("node", F.lit(1))
    groups = meetings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(mark).alias("y"))
    kept = groups.where(F.col("c1") != F.col("c2")).groupBy("size", "lead", "x", "y").agg(F.min("token").alias("token")).select("token", "size", "lead")
    return meetings.join(kept, "token")


def _blocks(meetings: DataFrame, pairs: bool) -> DataFrame:
    """(lead, token, block, node, comp): a meeting in blocks, at random or, where all pairs are wanted, as pairs of blocks."""
    meetings = _one_of_equal(meetings)
    n = F.ceil(F.col("size") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("node", "token"), n).cast("int")
    if not pairs:
        return meetings.select("lead", "token", own.cast("long").alias("block"), "node", "comp")
    both = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.least(own, o).cast("long") * n + F.greatest(own, o))
    return meetings.select("lead", "token", F.explode(F.when(n == 1, F.array(F.lit(0).cast("long"))).otherwise(both)).alias("block"), "node", "comp")


def _with(given: DataFrame, meetings: DataFrame, *columns: str) -> DataFrame:
    """Columns of the nodes that meet."""
    return given.select("node", *columns).join(meetings.select("node").distinct(), "node", "left_semi")


def _links(meetings: DataFrame, given: DataFrame, walk, pairs: bool) -> DataFrame:
    """Verified links among the members of each meeting (token, node, comp).

    Meetings with the same smallest node (lead) go to one task, where what one of them has joined, the others need not
    look at; a node's text goes there once, with all the tokens by which it meets.
    """
    meetings = materialise(_blocks(meetings, pairs), "jaccard-meetings")
    rows = meetings.groupBy("lead", "block", "node", "comp").agg(F.collect_list("token").alias("tokens"))
    dealt = rows.join(_with(given, meetings, "body"), "node").repartition("lead", "block").sortWithinPartitions("lead", "block", "node")
    links = materialise(dealt.mapInArrow(walk, "a bigint, b bigint"), "jaccard-links")
    discard(meetings)
    return links


def _own_links(texts: DataFrame) -> DataFrame:
    """Links between the nodes (doc_id, node) of one doc_id."""
    least = texts.groupBy("doc_id").agg(F.min("node").alias("a"))
    return materialise(texts.join(least, "doc_id").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct(), "jaccard-own")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; links: 100 * intersection >= percent * union. Ids are integers."""
    rows, key = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")), secret()
    survey = materialise(rows.mapInArrow(_survey(k, key), "doc_id bigint, n bigint, sid binary, strip int, counts binary"), "jaccard-survey")
    levels = _levels(survey.where(F.col("strip").isNotNull()).select("strip", "counts"))
    named = survey.where(F.col("strip").isNull()).select("doc_id", "n", "sid")

    given = materialise(rows.mapInArrow(_prefixes(k, percent, levels, key), "node bigint, sid binary, n bigint, prefix array<bigint>, mark binary, body binary"), "jaccard-prefixes")
    nodes = given.groupBy("sid").agg(F.min("node").alias("node"))
    sets = given.join(nodes, ["sid", "node"])
    walk = _walk(k, percent, levels, key)
    # Ids with several texts, which link the nodes of their sets. Mostly there are none.
    several = named.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id")
    several = materialise(several, "jaccard-several")
    repeated = not several.isEmpty()

    every = sets.select("node", F.explode("prefix").alias("token"))
    met = every.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("token")
    every = materialise(every.join(met, "token").distinct(), "jaccard-met")
    # A node's first shingles that others have too; those that nobody has come before them.
    place = F.row_number().over(Window.partitionBy("node").orderBy("token"))
    first = every.withColumn("place", place).where(F.col("place") <= FIRST).select("token", "node", F.col("node").alias("comp"))
    links = _links(first, given, walk, False)
    if repeated:
        links = links.unionByName(_own_links(named.join(several, "doc_id").join(nodes, "sid")))
    labels = components(links)
    second = every.join(labels, "node", "left").select("token", "node", F.coalesce("comp", "node").alias("comp"))
    meetings = materialise(_blocks(second, True), "jaccard-meetings")
    dealt = meetings.join(_with(given, meetings, "n", "mark"), "node").repartition("token", "block").sortWithinPartitions("token", "block", "node")
    pairs = materialise(dealt.mapInArrow(_pairs(percent), "a bigint, b bigint").distinct(), "jaccard-pairs")
    discard(meetings, every)
    # Those that may link with a node meet at it.
    third = pairs.select(F.col("a").alias("token"), F.col("b").alias("node")).unionByName(pairs.select(F.col("a").alias("token"), F.col("a").alias("node")).distinct())
    third = third.join(labels, "node", "left").select("token", "node", F.coalesce("comp", "node").alias("comp"))
    more = _links(third, given, walk, True)
    discard(pairs, labels)
    links = links.unionByName(more)
    labels = components(links)

    # A set's node need not be its smallest document, nor the component's label.
    smallest = named.where(F.col("n") > 0).groupBy("sid").agg(F.min("doc_id").alias("least"))
    of_set = smallest.join(nodes, "sid").join(labels, "node", "left").select("sid", "least", F.coalesce("comp", "node").alias("comp"))
    of_comp = of_set.groupBy("comp").agg(F.min("least").alias("component_id"))
    final = of_set.join(of_comp, "comp").select("sid", "component_id")
    out = named.join(final, "sid", "left")
    alone = F.col("doc_id")
    if repeated:  # an empty text goes with the other texts of its id
        of_id = named.join(several, "doc_id").join(final, "sid").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        out, alone = out.join(of_id, "doc_id", "left"), F.coalesce("of_id", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, alone).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).alias("component_id"))
    out = materialise(out, "jaccard-components")
    discard(survey, given, several, labels)
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of like texts, the one with the smallest doc_id (null ids last), with all its columns.

    It goes by rows: where ids are null or repeated, rows are numbered by doc_id and digest, and each is a document.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("doc_id").isNull() | (F.col("n") > 1))
    if odd.isEmpty():
        return _without_copies(docs, "doc_id", k, percent).select(*docs.columns)
    number = "_row_number_"
    ordered_rows = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.md5(F.to_json(F.struct(*docs.columns)).cast("binary")))
    # Written once, so that each row keeps its number.
    numbered = materialise(ordered_rows.withColumn(number, F.monotonically_increasing_id()), "jaccard-numbered")
    return _without_copies(numbered, number, k, percent).select(*docs.columns)


def _without_copies(docs: DataFrame, id_col: str, k: int, percent: int) -> DataFrame:
    """The rows of ``docs`` whose id, one for each row, is the smallest of its component."""
    found = jaccard_components(docs, id_col=id_col, k=k, percent=percent)
    copies = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(copies, id_col, "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)
