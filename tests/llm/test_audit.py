"""The filter audit against every order applied one by one."""

import random
from fractions import Fraction

from popspark.llm.audit import Removal, filter_audit

from . import brute
from .data import frame, words

LABELS = "doc_id long, quality int, toxic int, part string, n long, key int"


def result(df):
    return sorted(map(tuple, df.collect()))


def fixture():
    rng = random.Random(13)
    long = " ".join(words(rng, 260)).lower()
    texts = [long, long, long.upper(), " ".join(words(rng, 230)), "a b " * 150, "# " + long, long, "", None, None, "A", "☃ " * 300, "one " * 201 + "%", long + "\x85x", "\t".join(f"w{i}" for i in range(200)), "\x1c".join(f"w{i}" for i in range(300))]
    rows = [(40 - i, t) for i, t in enumerate(texts)] + [(25, texts[3]), (25, texts[0]), (None, long), (None, long), (None, "solo"), (3, long), (3, long)]
    labels = [(k, (k or 0) % 2, int((k or 0) % 3 == 0), "x", 1, 2) for k, _ in rows[::2]] + [(40, None, None, "x", 1, 2), (38, 1, 1, "x", 1, 2), (None, 1, 1, "x", 1, 2), (999, 1, 1, "x", 1, 2)]
    return rows, labels


def test_audit(spark):
    rows, labels = fixture()
    d = frame(spark, rows).repartition(3)
    want = brute.audit([(r.doc_id, r.text, r.source) for r in d.collect()], [x[:3] for x in labels])
    got = result(filter_audit(d, spark.createDataFrame(labels, LABELS)))
    assert got == sorted(want) and len(got) == 600 * 5


def test_audit_of_one_text(spark):
    """One text of most rows, over many partitions and parts."""
    rows = [(i % 900, "same words " * 120, f"s{i % 7}") for i in range(2000)] + [(i, f"other {i}", None) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    labels = [(i, 1, 0) for i in range(0, 900, 3)]
    assert result(filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == sorted(brute.audit(rows, labels))


def test_audit_empty(spark, empty):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit(empty, labels).collect() == []
    got = filter_audit(frame(spark, [(1, None)]), labels).collect()
    assert len(got) == 120 * 5 and {r.part for r in got} == {"s1"} and all(r.good_lost == 0 for r in got)


def test_polynomial():
    """Corners count removals, integrals are the shares of a pattern's filters."""
    rng = random.Random(3)
    counts = {m: rng.randrange(50) for m in range(32)}
    f = Removal(counts, 5)
    for corner in range(32):
        assert f.at(corner) == sum(c for m, c in counts.items() if m & corner)
    for i in range(5):
        assert f.shapley(i) == sum(Fraction(c, m.bit_count()) for m, c in counts.items() if m >> i & 1)
    assert sum(f.shapley(i) for i in range(5)) == f.at(31)
