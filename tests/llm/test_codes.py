"""Vector codes against plain Lloyd rounds."""

import random

import numpy as np
import pytest

from popspark.llm import codes
from popspark.llm.codes import Fit, product_codes

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, code int, error string, label_error int, at int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "z", 3, 4) for r in rows], SCHEMA)


def check(spark, rows, partitions=3):
    d = frame(spark, rows).repartition(partitions)
    coded, fit = product_codes(d)
    got = sorted(map(tuple, coded.collect()), key=repr)
    assert coded.columns == ["id", "label", "code", "error", "label_error"]
    floats = [(r.vec_id, r.embedding, r.label) for r in d.collect()]
    want, digest = brute.lloyd(floats)
    assert sorted(((k, c, e, s) for k, _, c, e, s in got), key=repr) == sorted(want, key=repr)
    assert fit.digest() == digest


def vectors(rng, n, dim=16, kinds=9):
    middles = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(kinds)]
    return [[x + rng.gauss(0, 0.1) for x in rng.choice(middles)] for _ in range(n)]


def test_codes(spark):
    rng = random.Random(4)
    rows = [(i, v, rng.choice([None, 1, 2])) for i, v in enumerate(vectors(rng, 400))]
    check(spark, rows)


def test_codes_ties_copies_and_edges(spark):
    """Grid vectors tie everywhere; one vector is a third of all; null, short, odd, infinite ones and null ids."""
    rng = random.Random(5)
    grid = [[rng.choice([-0.5, 0.0, 0.5]) for _ in range(8)] for _ in range(150)]
    rows = [(i, v, i % 4) for i, v in enumerate(grid)] + [(1000, grid[0], 1)] * 80 + [(3, grid[9], None), (3, grid[8], None), (None, grid[7], 2), (None, grid[7], 2)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [None] + [0.0] * 7, 1), (-2, [float("nan")] * 8, 1), (-1, [float("inf")] + [0.0] * 7, 1), (500, [0.1] * 16, 1), (501, [0.1] * 5, 7)]
    check(spark, rows)


def test_codes_of_large_components(spark):
    """Beyond exact floats the distances are those of whole numbers; an error beyond a long is null."""
    rng = random.Random(6)
    rows = [(i, [rng.choice([1e30, -1e30, 1e6, 3.0, 2.0**24, 0.1]) * rng.random() for _ in range(8)], 1) for i in range(60)]
    d = frame(spark, rows)
    coded, fit = product_codes(d)
    want, digest = brute.lloyd([(r.vec_id, r.embedding, r.label) for r in d.collect()])
    assert fit.digest() == digest
    assert sorted((r.id, r.code, r.error) for r in coded.collect()) == sorted((k, c, e if e <= codes.LONG else None) for k, c, e, _ in want)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_codes_of_few(spark, n):
    rng = random.Random(7)
    check(spark, [(i, v, None) for i, v in enumerate(vectors(rng, n, 8, 2))])
    assert product_codes(frame(spark, []))[0].collect() == []


def test_label_errors_of_many_labels(spark):
    """Rare labels are joined by a shuffle, frequent ones by a broadcast."""
    rows = [(i, i if i > 4000 else None if i > 2000 else 1, "00", i) for i in range(6000)]
    coded = spark.createDataFrame(rows, "id long, label int, code string, error long")
    got = {r.id: r.label_error for r in codes.with_label_errors(coded).collect()}
    per = {}
    for i, y, _, e in rows:
        per[y] = per.get(y, 0) + e
    assert got == {i: per[y] for i, y, _, e in rows}


def test_bounds_save_distances():
    """After the first round most groups are not scanned, and entries and distances are the plain ones."""
    rng = np.random.default_rng(8)
    x = np.floor((rng.integers(0, 6, (2000, 1)) + rng.normal(0, 0.05, (2000, 32))) * 4096)
    fit = Fit([[int(v) for v in r] for r in x[:16]], 8)
    at, low, work = np.zeros((2000, 8), np.uint8), np.zeros((2000, 8, 4), np.float32), []
    for _ in range(6):
        at, d, low, w = fit.coded(x, at, low)
        work.append(w)
        for p in range(8):
            far = codes.squares(x[:, p * 4 : p * 4 + 4], fit.book(p))
            assert (at[:, p] == far.argmin(1)).all() and (d[p] == far.min(1)).all()
        sums = {}
        codes.add_sums(sums, fit, x, at)
        fit = fit.moved(sums)
    assert work[-1] < 0.6 * work[0]
