"""Personal data against the plain patterns and counts."""

import random

import pytest
from pyspark.sql import functions as F

from popspark.llm.pii import matches, personal_data, running, sanitised

from . import brute
from .data import corpus, frame, words

HARD = [
    "a@b.c d@e.f@g.h x_y%z+q-1@sub-2.example.co.uk. end", "a@b.c_d@e.f", "@@a@@b.c..d@e.f.", "no@dot and .34@mail7.example.com geiever", "x" * 3000 + "@",
    "1.2.3.4 256.1.1.1 1.2.3 01.002.0003.255 1.2.3.4.5.6.7.8 999.1.1.1.1 0000000255.0.0.0 0.0.0.00256",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 5500-0000-0000-0004x37828224631000512345678", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2",
    "+1 (017) 555-7713 rest +44 20 7946 0958, +1+12345678901 +(1) 23 +1 (2) 3 ... + 1 234 567 8901 +1234567890123456", "+1 555 123 4567 8901 2345 6789 x 4111 1111 1111 1111",
    "naïve ☃ 𝒳𝒳 café@x.org 10.0.0.1 ñandú", "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962",
]


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plot():
    """An address of many letters; who signs them, with a rare name, a common word, a class of names, copies of one passage."""
    rng = random.Random(12)
    rows, names = [], ["zelwig", "zelwora", "zelwin", "zelnot"]
    filler = lambda n: " ".join(w.rstrip("0123456789") for w in words(rng, n))
    for i in range(40):
        rows.append((i, f"{filler(12)} dear Quorvath {filler(2)} q.v@mail.example.org {filler(3)} regards {filler(9)}"))
    for i in range(40, 120):
        rows.append((i, f"{filler(30)} regards dear {filler(4)}"))
    for i in range(120, 150):
        rows.append((i, f"{filler(3)} {names[i % 4]} {filler(1)} +49 30 1234 5678 {filler(5)}"))
    for i in range(150, 156):
        rows.append((i, f"{filler(20)} zelwig {filler(10)}"))
    for i in range(200, 260):
        rows.append((i, f"{filler(i % 7)} many copied words around here mandrake 10.1.2.3 basilisk other quiet words follow after {filler(i % 5)}"))
    return rows


def check(spark, rows):
    d = frame(spark, rows).repartition(3)
    got = personal_data(d)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert result(got) == sorted(brute.personal_data(rows), key=repr)


def test_personal_data_hard(spark):
    rows = list(enumerate(HARD)) + [(50, None), (51, ""), (None, HARD[0]), (None, None), (3, HARD[1]), (3, HARD[1])]
    check(spark, rows)
    assert result(personal_data(frame(spark, rows[:2]).drop("t", "k", "n")))[0][1] > 0


def test_terms_that_reveal(spark):
    rows = plot()
    check(spark, rows)
    of = {r.doc_id: r.spans for r in personal_data(frame(spark, rows)).collect()}
    assert all("term:" in of[i] or "general:" in of[i] for i in range(40))  # the name beside the address
    assert all(of[i] == "" for i in range(40, 120)) and all(of[i] == "" for i in range(150, 156))  # no value, no span
    assert all(of[i].count(":") == 2 for i in range(200, 260))  # copies of one passage are one piece of evidence
    assert len({"general" in of[i] for i in range(120, 150)}) >= 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts(spark, seed):
    """Few letters and digits in all arrangements."""
    rng = random.Random(seed)
    bits = ["@", ".", "+", " ", "-", "(", "1", "23", "4111111111111111", "255", "ab", "abc", "Abcd", "_", "%", "é", "+15551234567", "a@b.cc", "10.0.0.1", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(300)]
    check(spark, rows)


def test_corpus_and_empty(spark, empty):
    check(spark, corpus())
    assert personal_data(empty).collect() == []


def test_many_values(spark):
    """A long text of values only; places come by doubling sums."""
    rng = random.Random(9)
    t = " x ".join(rng.choice(["a@b.cc", "10.0.0.1", "4111111111111111", "+1 555 123 4567"]) for _ in range(3000))
    check(spark, [(1, t), (2, "x"), (3, "9 " * 20000), (4, "1" * 3000), (5, "a" * 3000 + "@b")])
    long = [(1, "1" * 500_000), (2, "a" * 500_000 + "@b"), (3, "1 " * 250_000), (4, "1." * 250_000), (5, "+1" * 250_000), (6, "+" + "1" * 500_000)]
    assert [r[1:5] for r in result(personal_data(frame(spark, long)))] == [(0, 0, 0, 0)] * 3 + [(0, 62_500, 0, 0)] + [(0, 0, 0, 0)] * 2


def test_running_sums_and_places(spark):
    d = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7],), ([],), ([5],)], "a array<int>")
    assert [r[0] for r in d.select(running(F.col("a"))).collect()] == [[1, 3, 6, 10, 15, 21, 28], [], [5]]
    m = spark.createDataFrame([("aXbbXXc",)], "t string").select(matches(F.col("t"), "X+").alias("m")).first().m
    assert [(x.s, x.e, x.value, x.before, x.after) for x in m] == [(1, 2, "X", "a", "bb"), (4, 6, "XX", "bb", "c")]


def test_sanitised(spark):
    rows = [(0, "see a@b.cc, 10.0.0.1 +1 555 123 4567 or 4111 1111 1111 1111!"), (1, None), (2, "clean"), (3, "")]
    d = frame(spark, rows)
    out = sanitised(d)
    assert out.columns == d.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "see <email>, <ip> <phone> or <card>!", 1: None, 2: "clean", 3: ""}
    plots = plot()
    spans = {r.doc_id: r.spans for r in personal_data(frame(spark, plots)).collect()}
    for r in sanitised(frame(spark, plots)).collect():
        assert ("Quorvath" in r.text) == ("quorvath" in dict(plots)[r.doc_id].lower() and "term" not in spans[r.doc_id] and "general" not in spans[r.doc_id])
        assert "q.v@" not in r.text and "+49" not in r.text


def test_no_python(spark, docs):
    plan = personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_states_the_method():
    """The query's SQL gives the plain rows on texts with terms that reveal, copies and hard values."""
    import duckdb
    import pandas as pd

    from popspark.llm.oracles import OP12

    rows = plot() + [(1000 + i, t) for i, t in enumerate(HARD)] + [(2000, None), (2001, "")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [k for k, _ in rows], "text": pd.array([t for _, t in rows], dtype="string")}))
    assert sorted(map(tuple, con.sql(OP12).fetchall())) == sorted(brute.personal_data(rows))
