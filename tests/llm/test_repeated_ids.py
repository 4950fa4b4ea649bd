"""The Jaccard join where doc_ids are null or repeated."""

import random
from collections import Counter

from filingloom.llm import jaccard_join
from tests.llm.helpers import corpus, frame, words
from tests.llm.test_exact import brute_components

RNG = random.Random(5)
A, B, C, D = (words(RNG, 60) for _ in range(4))
row = lambda i, text: (i, text, "en", "s", 1)


def test_an_id_links_its_texts(spark):
    """The smallest id of A is not the one that B shares; an empty text goes with its id; the link may chain."""
    docs = [*corpus(seed=6, n=12), row(3003, A), row(3005, A), row(3005, B), row(3007, B), row(3007, ""), row(3009, C), row(3009, C)]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(frame(spark, docs), k=4, percent=85).collect())
    assert got == brute_components(docs, 4, 85)
    assert got[3007, 57, 3003] == got[3005, 57, 3003] / 2 == 1


def test_one_row_of_each_component(spark):
    """Repeated rows, null ids and unlike texts of one id."""
    docs = [row(5, A), row(5, A), row(3, A), row(5, B), row(None, B), row(None, C), row(None, C), row(7, D), row(None, "")]
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(frame(spark, docs)).collect())
    assert kept == Counter([(3, A), (5, B), (None, C), (7, D), (None, "")])  # an empty text is like nothing
