"""Classifiers by held-out accuracy and plain versions of their parts, and the pipeline stage by stage."""

import itertools
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import quality_classifier, quality_rules, toxicity
from filingloom.llm.common import RollingHash, materialise, mix64, table
from filingloom.llm.trees import auc, fit_forest, fit_isotonic

from .helpers import corpus, frame, words
from .test_exact import brute_components, brute_windows, low, save

DATA = "/root/testdata/sf0.1"


def held_out(df, spark, label, n, rest):
    labels = {r.doc_id: r[label] for r in table(spark, DATA, "labels").collect()}
    rows = df.collect()
    assert len(rows) == table(spark, DATA, "documents").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % n == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    rows = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in rows])
    return auc(np.array([r.score for r in rows]), y), float(np.mean(np.array([r.predicted for r in rows]) == y))


def test_quality_held_out(spark):
    area, right = held_out(quality_classifier.op2_quality_classifier(spark, DATA), spark, "quality", 5, 0)
    assert area > 0.98 and right > 0.94


def test_toxicity_held_out(spark):
    area, right = held_out(toxicity.op6_toxicity(spark, DATA), spark, "toxic", 4, 2)
    assert area > 0.98 and right > 0.98


def edges(spark, tmp_path, label, clash=True):
    labels = [(i, i % 2) for i in range(30)] + [(1, None), (100, 1), (101, 0), (None, 1)]
    return save({"documents": frame(spark, corpus(), clash=clash), "labels": spark.createDataFrame(labels, f"doc_id long, {label} int")}, tmp_path)


@pytest.mark.parametrize("op", ["op2", "op6"])
def test_classifiers_at_the_edges(spark, tmp_path, op):
    query, label = {"op2": (quality_classifier.op2_quality_classifier, "quality"), "op6": (toxicity.op6_toxicity, "toxic")}[op]
    folder = edges(spark, tmp_path, label)
    rows = query(spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in corpus())
    assert all(0 <= r.score <= 1 for r in rows)
    table(spark, folder, "labels").limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "labels.parquet"))
    table(spark, folder, "documents").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert len(query(spark, str(tmp_path / "none")).collect()) == len(corpus())
    table(spark, folder, "documents").limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    assert query(spark, str(tmp_path / "none")).count() == 0


def plain_places(data: bytes) -> set[int]:
    """Places of a text's n-grams and words, one by one."""
    low16 = lambda h: (int(h) & 0xFFFF) * quality_classifier.HASHED >> 16
    out = set()
    for n in quality_classifier.ORDERS:
        for i in range(len(data) - n + 1):
            out.add(low16(mix64(np.array([int.from_bytes(data[i : i + n], "big") + (n << 40)], np.uint64))[0]))
    split = "".join(chr(b) if b > 32 else " " for b in data).split(" ")
    split = [bytes(map(ord, w)) for w in split if w]
    hasher = RollingHash()
    for w in split:
        raw = np.frombuffer(w, np.uint8)
        out.add(low16(hasher.ranges(hasher.prefix(raw), np.array([0]), np.array([len(w)]))[0]))
    longest = max((sum(1 for _ in g) for _, g in itertools.groupby(split)), default=0)
    return out | {quality_classifier.HASHED + n for n in range(2, min(longest, quality_classifier.MOST_RUN) + 1)}


def test_quality_features_and_ratio():
    rng = random.Random(21)
    texts = [words(rng, rng.randint(0, 25)).encode() for _ in range(20)] + [b"", b" \n ", b"ab " * 40, b"x", "é ü".encode(), b"a a b b b"]
    hasher = RollingHash()
    rows = [quality_classifier.indicators(t, hasher) for t in texts]
    assert [set(r.tolist()) for r in rows] == [plain_places(t) for t in texts]
    assert all(r.max(initial=0) < quality_classifier.DIMS for r in rows)
    y = np.array([i % 3 > 0 for i in range(len(rows))], float)
    ratio = quality_classifier.log_count_ratio(rows, y)
    for place in {*rows[0][:50].tolist(), *rows[22].tolist(), 5}:
        p, q = (1 + sum(place in r for r, label in zip(rows, y, strict=True) if label == of) for of in (1, 0))
        p_all, q_all = (quality_classifier.DIMS + sum(len(r) for r, label in zip(rows, y, strict=True) if label == of) for of in (1, 0))
        assert ratio[place] == pytest.approx(np.log(p / p_all) - np.log(q / q_all))


def test_quality_score_is_the_scaled_margin():
    rng = random.Random(22)
    rows = [quality_classifier.indicators(words(rng, 20 + 10 * (i % 2)).upper().encode() if i % 2 else words(rng, 20).encode(), RollingHash()) for i in range(60)]
    y, held = np.array([i % 2 for i in range(60)], float), np.array([i % 4 == 0 or i % 4 == 3 for i in range(60)])
    model = quality_classifier.train_model(rows, y, held)
    fit = [i for i in range(60) if not held[i]]
    ratio = quality_classifier.log_count_ratio([rows[i] for i in fit], y[fit])
    for r in rows:
        x = np.zeros(quality_classifier.DIMS)
        x[r] = ratio[r]
        w = np.divide(model.weight, ratio, out=np.zeros_like(ratio), where=ratio != 0)
        margin = w @ x / np.linalg.norm(x) + model.bias
        assert model.score(r) == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), rel=1e-6)


@pytest.mark.parametrize("case", ["empty", "unmatched", "all 1", "all 0"])
def test_toxicity_without_a_model(spark, case):
    """Labels that teach nothing reject nothing."""
    labels = {"empty": [], "unmatched": [(9000 + i, i % 2) for i in range(50)], "all 1": [(i, 1) for i in range(40)], "all 0": [(i, 0) for i in range(40)]}[case]
    docs, labels = frame(spark, corpus(), clash=True), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, toxicity.trained_on(labels))
    assert not model.fitted
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    assert {r.score for r in toxicity.score_toxicity(rows, model).collect()} == {0.0}
    kept = toxicity.drop_toxic(docs, model)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d[0] for d in corpus()) and kept.columns == docs.columns


def test_quality_rules_without_labels(spark):
    """The base rules alone decide."""
    docs, none = frame(spark, corpus()), spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, none, F.lit(True))).collect()
    assert len(rows) == len(corpus()) and all(r.kept == (not r.base_failed) for r in rows) and any(r.kept for r in rows)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = np.where(x @ [1.0, -2.0, 0.5, 0.0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows = [(np.arange(4), v) for v in x]
    w = quality_classifier.dual_coordinate_descent(rows, y, 4, np.ones(60), epochs=500)
    primal = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    for _ in range(200):
        assert primal(w) <= primal(w + 0.01 * rng.normal(size=4)) + 1e-3


def test_forest_is_monotone_and_calibration_rises():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(1500, 3))
    y = (rng.uniform(size=1500) < np.where(x[:, 0] > 0.5, 0.2, 0.7) + 0.2 * np.sin(9 * x[:, 1])).astype(float)
    forest = fit_forest(x, y, monotone={0: -1})
    grid = np.repeat(rng.uniform(size=(50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(forest.margin(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    assert auc(forest.margin(x), y) > 0.75
    free = fit_forest(x, y)
    assert not (np.diff(free.margin(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    iso = fit_isotonic(forest.margin(x), y)
    assert (np.diff(iso(np.linspace(-5, 5, 99))) >= 0).all()
    assert abs(iso(forest.margin(x)).mean() - y.mean()) < 0.02


def test_flattened_trees_equal_plain_walks():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 5)), rng.integers(0, 2, 300)
    forest = fit_forest(x, y, n_trees=7, depth=4)
    for row, margin in zip(x[:40], forest.margin(x)[:40], strict=True):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - len(f)]
        assert abs(total - margin) < 1e-9


def brute_statistics(text):
    text = text or ""
    w = [x for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text).split(" ") if x]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = text.split("\n")
    dup = sum(bool(x.strip(" \t\n\x0b\f\r")) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_rules(spark, tmp_path):
    rng = random.Random(9)
    docs = corpus() + [(800, (words(rng, 12) + "\n") * 3 + "a|b <c> $5 é x\x85y", "en", "s", 1), (801, words(rng, 25) + "\n\n" + words(rng, 25), "en", "s", 1)]
    labels = [(i, int(i % 4 > 0)) for i in range(40)] + [(None, 1), (5, None)]
    folder = save({"documents": frame(spark, docs, clash=True), "labels": spark.createDataFrame(labels, "doc_id long, quality int")}, tmp_path)
    rows = {r.doc_id: r for r in quality_rules.op7_quality_rules(spark, folder).collect()}
    for d in docs:
        r, want = rows[d[0]], brute_statistics(d[1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_rules_verdict(spark):
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    docs = table(spark, DATA, "documents")
    train = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    forest = quality_rules.fit_rules(docs, table(spark, DATA, "labels"), train)
    rows = quality_rules.apply_rules(docs.where(~train), forest).collect()
    seen = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k == bool(y) for k, y in seen]) > 0.97
    assert quality_rules.apply_rules(docs.limit(0), forest).count() == 0


def test_rolling_hash_depends_on_content_only():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 500, dtype=np.uint8)
    both = np.concatenate((data[100:300], rng.integers(0, 256, 77, dtype=np.uint8), data))
    h = RollingHash()
    a, b = h.prefix(data), h.prefix(both)
    for n in (1, 7, 50):
        start = np.arange(100, 300 - n)
        assert (h.ranges(a, start, start + n) == h.ranges(b, start - 100, start - 100 + n)).all()
        assert len(np.unique(h.ranges(a, start, start + n))) == len({data[i : i + n].tobytes() for i in start})


def test_toxicity_features():
    flags = toxicity._Flags(toxicity.Lexicon(frozenset({"zorg"}), frozenset({"blar"}), frozenset({"zorg"})))
    x = dict(zip(toxicity.FEATURES, toxicity.features("You ZORG, stuuupid 1d1ot! blarney fine", flags), strict=True))
    assert x["word_density"] == pytest.approx(1 / 6) and x["prefix_density"] == pytest.approx(1 / 6)
    assert x["hidden_hits"] == pytest.approx(2 / 6) and x["near_second_person"] == pytest.approx(2 / 6)
    assert not toxicity.features("", flags).any()


def plain_toxicity(text, lexicon):
    """The features of a text, told word by word."""
    squeezed = lambda w: "".join(k for k, _ in itertools.groupby(w))
    words = text.split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    bare = [w.lower().strip(toxicity.EDGES) for w in words]
    plain = [w.lower().strip(toxicity.SENTENCE).translate(toxicity.LEET).strip(toxicity.EDGES) for w in words]
    seed, word = [b in toxicity.SEED_WORDS for b in bare], [b in lexicon.words for b in bare]
    prefix = [any(b[:n] in lexicon.prefixes for n in toxicity.PREFIXES if len(b) >= n) for b in bare]
    strong = [b in lexicon.strong or any(b[:n] in lexicon.prefixes and b[:n] + "*" in lexicon.strong for n in toxicity.PREFIXES if len(b) >= n) for b in bare]
    you = [b in toxicity.SECOND_PERSON for b in bare]
    hit = [any(x) for x in zip(seed, word, prefix, strict=True)]
    stretched = [any(b[i] == b[i + 1] == b[i + 2] for i in range(len(b) - 2)) for b in bare]
    known = lambda w: w in toxicity.SEED_WORDS or w in lexicon.words
    leet = [p != b and any(c.isalpha() for c in b) and any(not c.isalpha() for c in b) for p, b in zip(plain, bare, strict=True)]
    hidden = [not h and (s and known(squeezed(b)) or (le and known(p))) for h, s, b, le, p in zip(hit, stretched, bare, leet, plain, strict=True)]
    near = [h and any(you[max(0, i - 5) : i + 6]) for i, h in enumerate(hit)]
    raw, n = text.encode(), len(words)
    capitals = sum(65 <= b <= 90 for b in raw)
    letters = max(1, capitals + sum(97 <= b <= 122 or b >= 192 for b in raw))
    marks = sum(33 <= b <= 126 and not chr(b).isalnum() for b in raw)
    counts = [np.log1p(sum(x)) for x in (seed, word, prefix)]
    shares = lambda *xs: [sum(x) / n for x in xs]
    return [*shares(seed, word, prefix), *counts, *shares(strong, near, you), capitals / letters, raw.count(b"!") / n, marks / n, *shares(leet, stretched, hidden), np.log1p(n)]


def plain_margin(forest, x):
    total = forest.base
    for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + (x[f[node]] > t[node])
        total += v[node - len(f)]
    return total


def test_toxicity_scores_equal_a_plain_version(spark):
    """Features, trees and calibration one document at a time, for the registered query."""
    source = "/root/testdata/sf0.01"
    docs, labels = table(spark, source, "documents"), table(spark, source, "labels")
    model = toxicity.fit_toxicity(docs, labels, toxicity.trained_on(labels))
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.op6_toxicity(spark, source).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        score = float(np.clip(np.interp(plain_margin(model.forest, plain_toxicity(r.text or "", model.lexicon)), model.calibration.x, model.calibration.y), 0, 1))
        assert got[r.doc_id] == (pytest.approx(score), int(got[r.doc_id][0] >= 0.3)), r.doc_id


def plain_rules(text):
    """The sixteen statistics of a document, told one by one."""
    text = text or ""
    n, chars, symbols, dup, repeat = brute_statistics(text)
    if not n:
        return [0.0] * len(quality_rules.FEATURES)
    raw = text.encode()
    words_ = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    capitals, small = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    ends = sum(x.strip()[-1:] in (b".", b"!", b"?", b":") for x in lines)
    return [
        np.log1p(n), chars / n, symbols / n, dup / len(lines), repeat / n, capitals / max(1, capitals + small), sum(48 <= b <= 57 for b in raw) / max(1, chars), raw.count(b"!") / n, raw.count(b"|") / n, raw.count(b"%") / n,
        ends / len(lines), n / len(lines), len(set(words_)) / n, (raw.count(b".") + raw.count(b",")) / n, sum(b >= 0xC0 for b in raw) / max(1, chars), np.log1p(max(map(len, words_))),
    ]


def test_rules_verdict_equals_a_plain_version(spark):
    source = "/root/testdata/sf0.01"
    docs, labels = table(spark, source, "documents"), table(spark, source, "labels")
    forest = quality_rules.fit_rules(docs, labels, F.lit(True))
    got = {r.doc_id: (r.kept, r.score) for r in quality_rules.op7_quality_rules(spark, source).collect()}
    for r in docs.collect():
        base = brute_statistics(r.text)
        score = 1 / (1 + np.exp(-plain_margin(forest, plain_rules(r.text))))
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert got[r.doc_id] == (not failed and score >= 0.3, pytest.approx(score)), r.doc_id


@pytest.mark.parametrize("case", ["empty", "nulls", "repeated", "unlabelled"])
def test_pipeline_at_the_edges(spark, tmp_path, case):
    """Empty tables; nulls in every column; repeated rows and clashing names; labels that teach nothing keep all clean rows."""
    import corpus_pipeline

    rng = random.Random(31)
    docs = {"empty": [], "nulls": [(None, None, None, None, None)] * 3 + corpus(n=12), "repeated": corpus(n=12) * 2, "unlabelled": corpus(n=12)}[case]
    labels = {"empty": [], "unlabelled": []}.get(case, [(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(None, None, None)])
    items = [] if case == "empty" else [(None, None), (1, ""), (2, words(rng, 15))]
    folder = save({"documents": frame(spark, docs, clash=case == "repeated"), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame(items, "item_id long, text string")}, tmp_path)
    start = table(spark, folder, "documents")
    before = docs_now = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = materialise(stage(spark, docs_now, folder), f"test-{name}")
        assert docs_now.schema.names == start.schema.names and docs_now.count() <= before.count()
        before = docs_now
    if case == "unlabelled":
        kept = corpus_pipeline.toxicity(spark, start, folder)
        assert kept.count() == start.count()
    out = corpus_pipeline.run(spark, folder)
    assert set(start.columns) <= set(out.columns)
    assert (out.count() == 0) == (case == "empty")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.01"
    docs = table(spark, source, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]

    kept = materialise(stage["toxicity"](spark, docs, source), "test")
    model = toxicity.fit_toxicity(docs, table(spark, source, "labels"), toxicity.trained_on(table(spark, source, "labels")))
    flags = toxicity._Flags(model.lexicon)
    before = docs.collect()
    x = np.array([toxicity.features(r.text or "", flags) for r in before])
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r, s in zip(before, model.scores(x), strict=True) if s < 0.3}
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()

    lines = materialise(stage["line_dedup"](spark, kept, source), "test")
    count = Counter(k for r in kept.collect() for k in {low(x.strip(" \t\n\x0b\f\r")) for x in (r.text or "").split("\n")})
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if not (k := low(x.strip(" \t\n\x0b\f\r"))) or count[k] < 10) for r in kept.collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = materialise(stage["near_duplicates"](spark, lines, source), "test")
    rows = [tuple(r) for r in lines.select("doc_id", "text").collect()]
    assert {r.doc_id for r in near.collect()} == {i for i, _, c in brute_components(rows, 5, 80) if i == c}

    clean = materialise(stage["decontamination"](spark, near, source), "test")
    windows = {w for r in table(spark, source, "benchmark").collect() for w in brute_windows(r.text)[1]}
    sizes = {len(w) for w in windows}
    bad = {r.doc_id for r in near.collect() for w in [brute_windows(r.text)[0]] if any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - bad and bad

    mixed = stage["mixing"](spark, clean, source).collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean.collect()}
    total = sum(len(r.text or "") for r in clean.collect())
    assert 0.8 < sum(len(r.text or "") for r in mixed) / total < 1.2
    assert Counter((r.doc_id, r.mix_copy) for r in corpus_pipeline.run(spark, source).collect()) == Counter((r.doc_id, r.mix_copy) for r in mixed)
