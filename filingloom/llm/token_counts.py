"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens; a pre-token's tokens are the pieces of the vocabulary whose summed log probabilities are
the greatest (fewer pieces where sums are equal). The best sum for a prefix depends on that prefix alone, so all
pre-tokens that begin alike share it: each distinct pre-token is inserted in a trie over bytes whose nodes hold the
forward scores of their prefixes. Only nodes that are new are computed; a pre-token's last node gives its count, which
is stored and looked up for all its occurrences. One trie serves a worker, task after task.

The vocabulary is a public file of byte pieces with ranks (none is trained here); a piece's probability follows Zipf's
law over its rank. Scores are whole millionths, so that sums are exact and the same on every machine. All single bytes
are pieces, so every text has a segmentation.

A worker holds at most ``NODES`` nodes, forgets all beyond that and begins anew; the counts stay exact. A pre-token of more
than ``LONG`` bytes is computed in the same way but not stored. Nothing is shuffled.

Defined results: null and empty texts have no tokens; a pre-token of any length is one path; repeated rows are counted
row by row; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import math
import os
from collections.abc import Iterator
from importlib.util import find_spec

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import slices, table

#: Runs of letters, digits or other signs with at most one space before them, and runs of white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Nodes of a trie, some 250 bytes each with the counts, and bytes of a pre-token that is stored in it.
NODES, LONG = 1_000_000, 10_000


def default_vocabulary() -> str:
    """The folder of public vocabulary files that is installed, or the place where the image has it."""
    spec = find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


class PreTokenTrie:
    """Forward scores of all prefixes of the pre-tokens inserted, and the counts of the pre-tokens.

    A forward score is one whole number: the best sum of log probabilities in its upper digits, less the number of pieces
    in its lower ``DIGITS`` bits, so that the greatest is the best sum with the fewest pieces.
    """

    DIGITS = 40

    def __init__(self, ranks: dict[bytes, int]) -> None:
        norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.score = {p: -round(1e6 * (math.log(r + 1) + norm)) for p, r in ranks.items()}
        self.weight = {p: (s << self.DIGITS) - 1 for p, s in self.score.items()}
        #: The longest piece that ends with a byte pair.
        self.longest: dict[bytes, int] = {}
        for p in ranks:
            self.longest[p[-2:]] = max(self.longest.get(p[-2:], 1), len(p))
        self._begin()

    def _begin(self) -> None:
        #: Child by 256 * node + byte; of each node the forward score; of each terminal its count.
        self.child: dict[int, int] = {}
        self.best = [0]
        self.counts: dict[str, int] = {}

    def _extend(self, data: bytes, best: list[int]) -> None:
        """Add the forward scores of the prefixes of ``data`` that are longer than those given."""
        weight, longest = self.weight.get, self.longest.get
        for end in range(len(best), len(data) + 1):
            top = None
            for begin in range(end - 1, max(0, end - longest(data[max(0, end - 2) : end], 1)) - 1, -1):
                w = weight(data[begin:end])
                if w is not None:
                    w += best[begin]
                    if top is None or w > top:
                        top = w
            best.append(top)

    def _pieces(self, best: int) -> int:
        return -best & ((1 << self.DIGITS) - 1)

    def insert(self, token: str) -> int:
        """The pre-token's count."""
        data = token.encode()
        if len(data) > LONG:
            best = [0]
            self._extend(data, best)
            return self._pieces(best[-1])
        if len(self.best) + len(data) > NODES:
            self._begin()
        child, node, path = self.child.get, 0, [0]
        for byte in data:
            node = child(node << 8 | byte)
            if node is None:
                break
            path.append(node)
        if (shared := len(path) - 1) < len(data):
            best = [self.best[i] for i in path]
            self._extend(data, best)
            node, new = path[-1], len(self.best)
            for byte in data[shared:]:
                self.child[node << 8 | byte] = node = new
                new += 1
            self.best += best[shared + 1 :]
        n = self.counts[token] = self._pieces(self.best[node])
        return n

    def count(self, tokens: list[str]) -> int:
        """Pieces of all pre-tokens of a text."""
        counts = self.counts
        rest = {t: self.insert(t) for t in set(tokens).difference(counts)}
        known = counts if counts is self.counts and rest.keys() <= counts.keys() else {t: rest.get(t, counts.get(t)) for t in set(tokens)}
        return sum(map(known.__getitem__, tokens))


@functools.lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=1)
def _trie(path: str) -> PreTokenTrie:
    return PreTokenTrie(_ranks(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens of each row. vocabulary: a file that is installed on every machine."""
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, cut = _trie(path), regex.compile(pattern).findall
        for batch in slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                tokens = cut(text or "")
                found.append((len(tokens), trie.count(tokens)))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_pretokens bigint, n_tokens bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
