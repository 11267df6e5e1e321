"""Rows with every kind of edge, as a table with columns whose names clash with the operators' own."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, t string, n int, fp long, g int, size string, label int, a int, b int, sig int, node int, bucket int, host string, score string, runs int, h int, rep int, __id int, __k int, __gone int, __got int, __score int"


def words(rng, n):
    return [rng.choice("alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()) + str(rng.randrange(40)) for _ in range(n)]


def corpus():
    """Texts with every kind of edge: null, empty, wordless, short, long, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = list(base)
    near[60] = "changed"
    passage = " ".join(words(rng, 60))
    line = " ".join(words(rng, 12))
    texts = [None, "", " \t\n \x0b\x0c\r", "one", "one two three four", "ONE two Three four", " ".join(base), " ".join(near), " ".join(base).upper(), " ".join(base[:40])]
    texts += [" ".join(words(rng, 30)) + "\n" + passage + "\n" + " ".join(words(rng, 30)) for _ in range(4)]
    texts += ["\n".join([line, " ".join(words(rng, 20)), "", line, "short", "short"]) for _ in range(3)]
    texts += ["\n".join(" ".join(words(rng, 15)) for _ in range(400)), "naïve café ☃ " * 30, "x" * 500, "ab" * 300, "ab" * 300]
    texts += [" ".join(words(rng, rng.randrange(1, 90))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, " ".join(words(rng, 70))), (None, None)]
    return rows


def frame(spark, rows):
    full = [(k, t, "en" if (k or 0) % 3 else None, None if k is None else f"s{k % 4}", len(t or ""), 1, "clash", 2, 3, 4, "z", 5, 6, 7, 8, 9, 10, "h", "s", 11, 12, 13, 14, 15, 16, 17, 18) for k, t in rows]
    return spark.createDataFrame(full, SCHEMA)
