"""Operators with one right answer, against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from filingloom.llm import chat, decontaminate, jaccard_join, line_dedup, mixing, suffix_dedup, token_counts
from filingloom.llm.common import merged, table

from .helpers import corpus, frame, words

SPACES = " \t\n\x0b\f\r"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def save(frames, folder):
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


# --- 1: decontamination


def brute_windows(text):
    w = [x for x in "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low(text or "")).split(" ") if x]
    return w, [tuple(w)] if 0 < len(w) < 10 else [tuple(w[i : i + 10]) for i in range(len(w) - 9)]


@pytest.mark.parametrize(("block", "chunk"), [(50_000, 1 << 24), (3, 1 << 24), (3, 1000), (1, 1)])
def test_decontamination(spark, tmp_path, monkeypatch, block, chunk):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    docs = corpus()
    rng = random.Random(5)
    long_words = docs[105 - 100 + 40][1].split(" ")
    items = [(1, " ".join(docs[5][1].split(" ")[-30:])), (12, "ONE"), (13, None), (14, ""), (2, words(rng, 12)), (1, " ".join(long_words[50:75])), (20, "ab ab"), (21, "!! ?")]
    docs += [(200, "so one, ONE: won", "en", "s", 3), (200, "so one, ONE: won", "en", "s", 3)]
    folder = save({"documents": frame(spark, docs, clash=True), "benchmark": spark.createDataFrame(items, "item_id long, text string")}, tmp_path)
    got = Counter(tuple(r) for r in decontaminate.op1_decontamination(spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    want = Counter()
    for d in docs:
        w, _ = brute_windows(d[1])
        hit, found = set(), set()
        for item, text in items:
            for p in brute_windows(text)[1]:
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i : i + len(p)]) == p:
                        hit.update(range(i, i + len(p)))
                        found.add(str(item))
        want[d[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    assert got == want
    clean = decontaminate.drop_contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k in want.elements() if not k[5])
    assert clean.columns == frame(spark, [], clash=True).columns


def test_decontamination_reads_documents_once(spark, tmp_path, monkeypatch, capsys):
    """However many blocks: one scan, one Python step, no shuffle; a task takes the blocks one by one."""
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    items = spark.createDataFrame([(i, words(random.Random(i), 40)) for i in range(9)], "item_id long, text string")
    assert len(decontaminate.blocks_of(decontaminate.benchmark_windows(items))) == (9 * 31 + 3) // 4
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    for df in (decontaminate.find_benchmark(table(spark, str(tmp_path), "documents"), items), decontaminate.drop_contaminated(table(spark, str(tmp_path), "documents"), items)):
        df.explain()
        plan = capsys.readouterr().out
        assert (plan.count("FileScan"), plan.count("MapInArrow"), plan.count("Exchange")) == (1, 1, 0)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_benchmark(frame(spark, []), none).count() == 0
    assert [r.spans for r in decontaminate.find_benchmark(frame(spark, corpus(n=2)), none).collect()] == [[]] * 10


# --- 3: token counts


def brute_tokens(data, score):
    best = [(0, 0)] + [None] * len(data)
    for end in range(1, len(data) + 1):
        best[end] = max(((best[a][0] + score[data[a:end]], best[a][1] - 1) for a in range(end) if data[a:end] in score), default=None)
    return -best[-1][1]


def test_token_counts(spark, tmp_path):
    """The registered query, with its own vocabulary."""
    trie = token_counts.PreTokenTrie(token_counts._ranks(token_counts.default_vocabulary()))
    docs = [d for d in corpus() if d[0] < 12 or 100 <= d[0] < 105] + [(300, "it's   tabs\t\tand 12345 ünïcödé 你好 \U0001f600\n", "en", "s", 1), (301, "a" * 300, "en", "s", 1), (301, "a" * 300, "en", "s", 1)]
    cut = token_counts.regex.compile(token_counts.PATTERN).findall
    folder = save({"documents": frame(spark, docs, clash=True)}, tmp_path)
    got = Counter(tuple(r) for r in token_counts.op3_token_counts(spark, folder).select("doc_id", "n_bytes", "n_pretokens", "n_tokens").collect())
    assert all("".join(cut(d[1] or "")) == (d[1] or "") for d in docs)
    assert got == Counter((d[0], len((d[1] or "").encode()), len(cut(d[1] or "")), sum(brute_tokens(t.encode(), trie.score) for t in cut(d[1] or ""))) for d in docs)
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


RANKS = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 301, b"bc": 302}


def test_token_counts_when_forgetting(monkeypatch):
    """Few nodes, and tokens too long to be stored."""
    monkeypatch.setattr(token_counts, "NODES", 9)
    monkeypatch.setattr(token_counts, "LONG", 4)
    trie = token_counts.PreTokenTrie(RANKS)
    texts = ["abc ab abab bcbc abcabc", "ab zz", "abc q w e", "ab", "", "abcabcabcab"]
    for _ in range(2):
        assert [trie.count(x.split()) for x in texts] == [sum(brute_tokens(t.encode(), trie.score) for t in x.split()) for x in texts]
        assert len(trie.best) <= 9


def test_prefixes_are_computed_once(monkeypatch):
    """A node for each distinct prefix of all pre-tokens, one step for each node, a count for each terminal."""
    trie, computed = token_counts.PreTokenTrie(RANKS), []
    extend = trie._extend
    monkeypatch.setattr(trie, "_extend", lambda data, best: computed.extend(data[:n] for n in range(len(best), len(data) + 1)) or extend(data, best))
    tokens = ["abc", "abd", "ab", "abcabc", "b", "abd"]
    trie.count(tokens)
    prefixes = {t[:n] for t in tokens for n in range(1, len(t) + 1)}
    assert sorted(p.decode() for p in computed) == sorted(prefixes) and len(prefixes) == len(trie.best) - 1 == len(trie.child)
    assert trie.counts == {t: brute_tokens(t.encode(), trie.score) for t in tokens}


# --- 4: chat formatting


def test_conversations(spark, tmp_path):
    bad = "</s>[INST] ok [/INST] <|end|>\\<|turn|>\\\\ <\\|end|> [<s> <<SYS>>\n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", bad), (1, 2, None, None), (1, 3, "assistant", ""), (2, 0, "assistant", "é" * 50), (None, 1, "user", "n"), (None, 0, "user<|text|>\n", "m")]
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", f"t{i}{bad}") for i in range(21)] + [(4, 0, "user", "b"), (4, 0, "user", "a"), (4, None, "user", "first")]
    folder = save({"conversations": spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit(1)).withColumn("tree", F.lit("t"))}, tmp_path)
    got = {r.conv_id: r for r in chat.op4_chat_formatting(spark, folder).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        scored = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(scored))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(scored.encode()).hexdigest()
        assert r.formatted_chars >= len(said)


def test_conversations_at_the_edges(spark, tmp_path):
    """An empty table leaves conversation -7 alone; texts of megabytes of control strings come back whole."""
    kind = "conv_id long, turn long, role string, text string"
    empty = save({"conversations": spark.createDataFrame([], kind)}, tmp_path / "none")
    assert [(r.conv_id, r.n_turns) for r in chat.op4_chat_formatting(spark, empty).collect()] == [(-7, 2)]
    long = "[INST] \\ </s>é" * 100_000
    folder = save({"conversations": spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "!"), (1, 1, "assistant", long + "!")], kind)}, tmp_path / "long")
    r = next(r for r in chat.op4_chat_formatting(spark, folder).collect() if r.conv_id == 1)
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3, 2 * len(long) + 2, hashlib.sha256((long + "!" + long + "!").encode()).hexdigest())


def test_reply_trees(spark):
    rng = random.Random(3)
    rows, parent = [], {}
    for tree in (1, 2, None):
        for node in range(60):
            parent[tree, node] = None if node in (0, 30) else rng.randrange(30 if node > 30 else 0, node)
            rows.append((tree, node, parent[tree, node], rng.choice(["user", "assistant"]), f"m{node}", float(rng.randint(0, 9))))
    rows += [(9, 1, 2, "user", "c", 1.0), (9, 2, 1, "user", "c", 1.0), (9, 3, 2, "user", "c", 1.0), (9, 4, 77, "user", "orphan", 1.0)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    score = {(r[0], r[1]): r[5] for r in rows}
    want = {}
    for tree in (1, 2, None):
        leaves = {n for n in range(60)} - {p for (t, _), p in parent.items() if t == tree}
        paths = []
        for leaf in leaves:
            path = [leaf]
            while (up := parent[tree, path[0]]) is not None:
                path.insert(0, up)
            paths.append((-sum(score[tree, n] for n in path), leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:5], 1):
            want[tree, leaf, rank] = path
    want[9, 4, 1] = [4]
    out = chat.format_paths(messages, chat.choose_paths(messages, top_k=5)).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {(r.tree, r.leaf, r["rank"]): [t.text for t in r.turns] for r in out.collect()}
    assert got == {k: [f"m{n}" if k[0] != 9 else "orphan" for n in path] for k, path in want.items()}
    empty = messages.limit(0)
    assert chat.format_paths(empty, chat.choose_paths(empty)).count() == 0


# --- 5: line dedup


def test_line_dedup(spark, tmp_path):
    docs = corpus(n=60) + [(8, "Licensed to  YOU, and All Others.\n\nend", "en", "s", 1), (None, "licensed to  you, and all others.", "en", "s", 1)]
    folder = save({"documents": frame(spark, docs, clash=True)}, tmp_path)
    keys = defaultdict(set)
    for d in docs:
        for x in (d[1] or "").split("\n"):
            keys[low(x.strip(SPACES))].add(d[0])
    want = Counter()
    for d in docs:
        lines = (d[1] or "").split("\n")
        kept = [x for x in lines if not (low(x.strip(SPACES)) and len(keys[low(x.strip(SPACES))]) >= 10)]
        want[d[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = line_dedup.op5_line_dedup(spark, folder).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any(k[2] for k in want)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


# --- 8: n-gram Jaccard join


def brute_components(docs, k, percent):
    sets = defaultdict(list)
    for d in docs:
        w = [x for x in "".join(" " if c in SPACES else c for c in low(d[1] or "")).split(" ") if x]
        sets[d[0]].append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return Counter((i, len(s), find(i)) for i in sets for s in sets[i])


@pytest.mark.parametrize("group", [1000, 3])
def test_jaccard_join(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rng = random.Random(11)
    docs = corpus(seed=2)
    base = words(rng, 80).split(" ")
    for i in range(25):  # a large group of near copies, and a chain of ever more changed ones
        copy = list(base)
        copy[rng.randrange(80)] = f"new{i}"
        docs.append((400 + i, " ".join(copy), "en", "s", 1))
    chain = words(rng, 150).split(" ")
    for i in range(12):
        chain[i * 9] = f"c{i}"
        docs.append((500 + i, "\t".join(chain).upper() if i % 2 else " ".join(chain), "en", "s", 1))
    docs += [(600 + i, "a b", "en", "s", 1) for i in range(5)] + [(3, docs[3][1], "en", "s", 1)]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(frame(spark, docs, clash=True), k=4, percent=85).collect())
    assert got == brute_components(docs, 4, 85)


def test_unlike_words_are_not_linked(spark, tmp_path):
    """A word of 1,024 letters after Thue and Morse and its complement cancel in polynomial hashes modulo 2**64."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    docs = [(1, word, "en", "s", 1), (2, word.translate(str.maketrans("ab", "ba")), "en", "s", 1), (3, f"x {word} y z", "en", "s", 1), (4, f"X {word}\ty z", "en", "s", 1)]
    folder = save({"documents": frame(spark, docs)}, tmp_path)
    assert {tuple(r) for r in jaccard_join.op8_jaccard_join(spark, folder).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 3)}


def test_links_are_confirmed_on_real_shingles(spark, monkeypatch):
    """Whatever the hashes of unlike shingles, the trees' links count only if the texts bear them out."""
    docs = corpus(seed=2, n=24)
    monkeypatch.setattr(jaccard_join, "real_shingles", lambda text, k: {text})
    got = jaccard_join.jaccard_components(frame(spark, docs), k=4, percent=85).collect()
    equal = [(d[0], " ".join(low(d[1] or "").split()), "", "", 0) for d in docs]
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, c) for (i, _, c), n in brute_components(equal, 10_000, 100).items() for _ in range(n))


def test_jaccard_join_keeps_one(spark):
    docs = corpus(seed=4)
    kept = jaccard_join.keep_one(frame(spark, docs + [(None, docs[0][1], "en", "s", 1)])).collect()
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter(i for (i, _, c), n in brute_components(docs, 5, 80).items() if i == c for _ in range(n))
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


# --- 9: suffix-array dedup


def brute_repeats(docs, match, seen=None):
    count = {n: Counter(d[i : i + n] for d in docs for i in range(len(d) - n + 1)) for n in {match, seen or match}}
    out = Counter()
    for d in docs:
        spans = {n: merged([(i, i + n) for i in range(len(d) - n + 1) if of[d[i : i + n]] > 1]) for n, of in count.items()}
        kept, at = b"", 0
        for a, b in spans[match]:
            kept, at = kept + d[at:a], b
        out[len(d), sum(b - a for a, b in spans[match]), len(spans[match]), kept + d[at:], sum(len(d[a:b].split()) > 50 for a, b in spans[seen or match])] += 1
    return out


def repeats(df):
    return Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_passages) for r in df.collect())


def repeating_docs():
    rng = random.Random(6)
    docs = corpus(seed=1, n=30)
    passage = words(rng, 160)
    docs += [(700 + i, words(rng, 20) + passage[rng.randrange(40) : 300 + rng.randrange(400)] + words(rng, 20), "en", "s", 1) for i in range(12)]
    return docs + [(0, docs[0][1] + " more", "en", "s", 1), (None, docs[4][1], "en", "s", 1), (None, docs[5][1], "en", "s", 1), docs[6]]


@pytest.mark.parametrize(("hot", "ranges", "seen"), [(1000, 8, 60), (1, 8, 60), (1000, 1, 45), (1, 2, 45), (3, 64, 45)])
def test_suffix_dedup(spark, monkeypatch, hot, ranges, seen):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "RANGES", ranges)
    docs = repeating_docs()
    got = suffix_dedup.remove_repeats(frame(spark, docs, clash=True), match=60, seen=seen, spread=25)
    assert repeats(got) == brute_repeats([(d[1] or "").encode() for d in docs], 60, seen)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_dedup_as_registered(spark, tmp_path):
    """The query with its own lengths, digests included."""
    docs = repeating_docs()
    folder = save({"documents": frame(spark, docs, clash=True)}, tmp_path)
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in suffix_dedup.op9_suffix_dedup(spark, folder).collect())
    want = brute_repeats([(d[1] or "").encode() for d in docs], 400, suffix_dedup.SEEN)
    assert got == Counter({(*k[:3], hashlib.sha256(k[3]).hexdigest(), k[4]): n for k, n in want.items()})
    assert any(k[1] and k[1] < k[0] for k in want) and any(k[4] and not k[1] for k in want)


def test_suffix_removal_passes_through_the_families(spark, monkeypatch):
    """Without what the suffix arrays find, nothing is removed."""
    docs = repeating_docs()
    monkeypatch.setattr(suffix_dedup, "HOT", 10**9)
    nothing = lambda batches: (b for b in batches if b.num_rows < 0)
    monkeypatch.setattr(suffix_dedup, "_families", lambda match, seen: nothing)
    assert all(r.n_removed == 0 for r in suffix_dedup.remove_repeats(frame(spark, docs), match=60, seen=45, spread=25).collect())


def test_suffix_family_by_levels():
    """New texts are scanned against the arrays of all levels; arrays of one level merge."""
    rng = random.Random(12)
    texts = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(13)]
    family = suffix_dedup.SuffixFamily(8, 6)
    for i, t in enumerate(texts):
        family.add(t, len(t) - 6 + 1, False)
        family.flush()
        assert [n is not None for n in family.levels] == [bool((i + 1) >> k & 1) for k in range((i + 1).bit_length())]
    whole = Counter(t[i : i + n] for n in (6, 8) for t in texts for i in range(len(t) - n + 1))
    assert family.long == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 7) if whole[t[i : i + 8]] > 1}
    assert family.short == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 5) if whole[t[i : i + 6]] > 1}


def test_suffix_dedup_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 100)
    rng = random.Random(7)
    text = words(rng, 200)
    docs = [(1, text + text[100:400], "en", "s", 1), (2, "é" * 90 + text[333:777], "en", "s", 1)]
    got = suffix_dedup.remove_repeats(frame(spark, docs), match=60, spread=25)
    assert repeats(got) == brute_repeats([d[1].encode() for d in docs], 60)


# --- 10: mixing


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, words(rng, 5), "en", "big" if i < 900 else f"s{i % 4}", 1) for i in range(1200)] + [(5000, None, "en", None, 1), (5001, "nul", "en", None, 1), (5001, "nul", "en", None, 1), (5002, "", "en", "void", 1)]
    df = frame(spark, docs, clash=True)
    out = mixing.mix_sources(df, weights={"big": 1, "s0": 1, "s1": 2, "s2": 0.0, "s3": 1}, epochs=3.0, seed=4).collect()
    total = sum(len(d[1] or "") for d in docs)
    chars = Counter()
    for r in out:
        chars[r.source] += len(r.text or "")
    for source, share in (("big", 0.2), ("s0", 0.2), ("s1", 0.4), ("s3", 0.2)):
        assert abs(chars[source] / (3 * total * share) - 1) < 0.2
    assert set(chars) == {"big", "s0", "s1", "s3"}
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for rows in by.values():
        assert sorted(r.mix_copy for r in rows) == list(range(1, rows[0].mix_copies + 1))
    again = mixing.mix_sources(df.repartition(7), weights={"big": 1, "s0": 1, "s1": 2, "s2": 0.0, "s3": 1}, epochs=3.0, seed=4).collect()
    assert Counter((r.doc_id, r.mix_copy) for r in again) == Counter((r.doc_id, r.mix_copy) for r in out)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert {r.source for r in mixing.mix_sources(df, epochs=200.0).collect()} >= {None, "big"}


def test_mixing_with_a_bound(spark):
    """A source of three characters takes its share in thousands of copies, or in no more than it is allowed to."""
    docs = [(i, "x" * 100, "en", "big", 1) for i in range(50)] + [(99, "abc", "en", "tiny", 1)]
    copies = lambda **k: sum(r.source == "tiny" for r in mixing.mix_sources(frame(spark, docs), seed=1, **k).collect())
    assert 600 < copies() < 1100 and copies(most_rate=4.0) < 20


def test_poisson_inverse(spark):
    import math

    rates = [0.0, 0.01, 1.0, 7.5, 60.0, 900.0]
    rows = [(u, r) for r in rates for u in (1e-9, 0.2, 0.5, 0.9, 1 - 1e-12)]
    df = spark.createDataFrame(rows, "u double, r double").withColumn("k", mixing.poisson_inverse(F.col("u"), F.col("r")))
    for row in df.collect():
        k, total = 0, 0.0
        while True:
            total += math.exp(k * math.log(row.r) - row.r - math.lgamma(k + 1)) if row.r else float(k == 0)
            if total > row.u or k > 3000:
                break
            k += 1
        assert abs(row.k - k) <= (1 if row.u > 1 - 1e-9 else 0), (row, k)


@pytest.mark.parametrize("op", [chat.op4_chat_formatting, line_dedup.op5_line_dedup, mixing.op10_mixing])
def test_native_plans(spark, capsys, op):
    """No Python on the executors, and no cross join beyond one row of totals."""
    op(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "MapIn", "Arrow", "Pandas", "CartesianProduct"))


def test_queries_and_sql_agree_on_names():
    from filingloom.llm import queries

    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
