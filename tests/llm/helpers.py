"""Documents that try the edges: nulls, empty and long texts, ties, repeated rows."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, data binary, at long, score double, lines string, node long, token long, mix_copy int, scan_bytes string, h string, key string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed: int = 0, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    shared = words(rng, 120)
    line = "Licensed to  YOU, and All Others."
    out = []
    for i in range(n):
        body = "\n".join(words(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            body += "\n" + line + ("\n" + line.upper() + " " if i % 8 == 0 else "")
        if i % 5 == 0:
            body += "\n" + shared
        if i % 7 == 0 and out:
            near = out[-1][1].split(" ")
            near[rng.randrange(len(near))] = "other"
            body = " ".join(near)
        out.append((i, body, "en", f"s{i % 3}", len(body)))
    out += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \n\n ", "en", "s1", 4), (103, out[min(3, n - 1)][1], "en", "s0", 1), (104, "one", "en", None, 3)]
    out += [(105, words(rng, 6000), "en", "s2", 1), (106, "ab " * 3000, "en", "s2", 1), (107, "x" * 2000, "en", "s0", 1)]
    return out


def frame(spark, rows, clash=False):
    if clash:
        rows = [(*r, b"z", 5, 0.5, "q", 7, 8, 9, "s", "h", "k") for r in rows]
    return spark.createDataFrame(rows, CLASH if clash else DOC)
