import itertools

import numpy as np
from hypothesis import given, settings, strategies as st

from popspark.operators.flow import adjust, objective


def best(counts, feasible, diff, *how):
    options = []
    for r in range(len(counts)):
        idx = np.flatnonzero(feasible[r])
        total = int(counts[r, idx].sum())
        options.append((idx, [c for c in itertools.product(range(total + 1), repeat=len(idx)) if sum(c) == total] if len(idx) else [()]))
    least = None
    for choice in itertools.product(*[o for _, o in options]):
        a = np.zeros_like(counts)
        for r, (idx, _) in enumerate(options):
            a[r, idx] = choice[r]
        v = objective(counts, a, feasible, diff - (a - counts).sum(0), *how)
        least = v if least is None else min(least, v)
    return least


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.data())
def test_matches_brute_force(rows, data):
    counts = np.array(data.draw(st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3), min_size=rows, max_size=rows)))
    feasible = np.array(data.draw(st.lists(st.lists(st.booleans(), min_size=3, max_size=3), min_size=rows, max_size=rows)))
    counts = np.where(feasible, counts, 0)
    diff = np.array(data.draw(st.lists(st.integers(-4, 4), min_size=2, max_size=2)))
    diff = np.append(diff, -diff.sum())
    after, left = adjust(counts, feasible, diff)
    assert (after >= 0).all() and not after[~feasible].any()
    assert (after.sum(1) == counts.sum(1)).all()
    assert ((after - counts).sum(0) + left == diff).all()
    assert objective(counts, after, feasible, left) == best(counts, feasible, diff)


def test_infeasible_cell_and_zeros():
    s = np.array([[0, 30, 50, 20], [10, 55, 0, 15], [20, 60, 70, 25], [15, 75, 65, 30], [0, 40, 45, 35], [5, 50, 60, 40]])
    ok = np.ones_like(s, bool)
    ok[0, 0] = False
    after, left = adjust(s, ok, np.array([4, 1, -15, 10]))
    assert not left.any() and (after.sum(1) == s.sum(1)).all() and after[0, 0] == 0


def test_unsatisfiable_leaves_both_sides():
    after, left = adjust(np.array([[5, 4, 6], [3, 1, 2]]), np.ones((2, 3), bool), np.array([-10, 10, 0]))
    assert left.tolist() == [-2, 2, 0] and after[:, 0].tolist() == [0, 0]


def test_nothing_to_do():
    s = np.array([[1, 2]])
    after, left = adjust(s, np.ones_like(s, bool), np.array([0, 0]))
    assert (after == s).all() and not left.any()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.sampled_from([("relative", 0.0), ("absolute", 0.4), ("absolute", 3.0), ("relative", 0.2)]), st.data())
def test_options_match_brute_force(rows, how, data):
    counts = np.array(data.draw(st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3), min_size=rows, max_size=rows)))
    feasible = np.array(data.draw(st.lists(st.lists(st.booleans(), min_size=3, max_size=3), min_size=rows, max_size=rows)))
    counts = np.where(feasible, counts, 0)
    diff = np.array(data.draw(st.lists(st.integers(-3, 3), min_size=2, max_size=2)))
    diff = np.append(diff, -diff.sum())
    after, left = adjust(counts, feasible, diff, *how)
    assert (after >= 0).all() and not after[~feasible].any()
    assert (after.sum(1) == counts.sum(1)).all() and ((after - counts).sum(0) + left == diff).all()
    want = best(counts, feasible, diff, *how)
    assert abs(objective(counts, after, feasible, left, *how) - want) <= 1e-6 * max(1.0, want)


def test_relative_moves_where_counts_are_large():
    counts = np.array([[2, 50], [100, 50]])
    after, _ = adjust(counts, np.ones((2, 2), bool), np.array([-2, 2]), "relative")
    assert after.tolist() == [[2, 50], [98, 52]]


def test_penalty_gathers_changes():
    """Four units in as few cells as possible; without a penalty the split does not matter."""
    counts = np.array([[4, 0], [2, 2], [2, 2]])
    after, left = adjust(counts, np.ones((3, 2), bool), np.array([-4, 4]), "absolute", 1.0)
    assert not left.any() and after.tolist() == [[0, 4], [2, 2], [2, 2]]
