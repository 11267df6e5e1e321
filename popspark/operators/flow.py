"""Least-change adjustment of a count matrix, as a min-cost flow.

Cells are counts of (row, state); ``diff`` says by how much each state must
grow. Moving a unit from one state to another inside a row keeps the row sum
and changes two cells. A changed unit costs 1 (absolute deviation) or one over
the cell's count (relative), times the number of states; a path saves two units
of slack weighted by the number of cells, so shortest paths are taken until one
costs what it saves.

A spread penalty is a fixed cost of every cell that changes at all. The first
unit then costs more than the next, which no shortest path prices right: such
problems are solved by branch and bound. A node has cells that are open (their
fixed cost is paid), closed (they may not change) and undecided (each unit bears
the fixed cost's share of the largest change); its flow is a lower bound, and
its true cost an upper one.
"""

from __future__ import annotations

import heapq

import numpy as np

#: A count of 0 in the divisor of a relative deviation; fixed value.
EPSILON = 1e-6


def unit_costs(counts: np.ndarray, feasible: np.ndarray, deviation: str) -> np.ndarray:
    if deviation == "absolute":
        return np.ones(counts.shape)
    if deviation == "relative":
        now = np.where(feasible, counts, 0)
        return 1.0 / np.where(now > 0, now, EPSILON)
    raise ValueError(f"no deviation {deviation!r}")


def adjust(counts: np.ndarray, feasible: np.ndarray, diff: np.ndarray, deviation: str = "absolute", spread_penalty: float = 0.0, max_nodes: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(new counts, what is left of diff). Infeasible cells stay 0; no cell falls below 0.

    With a spread penalty the search ends after ``max_nodes`` flows with the best
    found; on matrices that need fewer the result is the optimum.
    """
    counts = np.where(feasible, counts, 0).astype(np.int64)
    diff = diff.astype(np.int64)
    unit = unit_costs(counts, feasible, deviation)
    worth = 2 * int(feasible.sum()) / counts.shape[1]  # what a unit of both slacks is worth in unit costs
    if spread_penalty <= 0:
        return _flow(counts, feasible, diff, unit, worth)
    most = int(min(diff[diff > 0].sum(), -diff[diff < 0].sum()))
    if not most:
        return counts, diff

    def true_cost(after: np.ndarray, left: np.ndarray) -> float:
        return objective(counts, after, feasible, left, deviation, spread_penalty)

    def node(opened: frozenset, closed: frozenset) -> tuple[float, np.ndarray, np.ndarray]:
        cost, may = unit + spread_penalty / most, feasible.copy()
        for i in opened:
            cost[i] = unit[i]
        for i in closed:
            may[i] = False
        after, left = _flow(counts, may, diff, cost, worth)
        bound = counts.shape[1] * (float((cost * np.abs(after - counts)).sum()) + spread_penalty * len(opened)) + int(feasible.sum()) * float(np.abs(left).sum())
        return bound, after, left

    bound, after, left = node(frozenset(), frozenset())
    best = (true_cost(after, left), after, left)
    todo, n = [(bound, 0, frozenset(), frozenset(), after)], 1
    while todo and n < max_nodes:
        bound, _, opened, closed, after = heapq.heappop(todo)
        if bound >= best[0] - 1e-9:
            break
        change = np.abs(after - counts)
        free = [tuple(map(int, i)) for i in np.argwhere(change > 0) if tuple(i) not in opened]
        if not free:
            continue
        at = min(free, key=lambda i: (abs(2 * change[i] - most), i))
        for o, c in ((opened | {at}, closed), (opened, closed | {at})):
            bound, after, left = node(o, c)
            n += 1
            cost = true_cost(after, left)
            if cost < best[0] - 1e-9:
                best = (cost, after, left)
            if bound < best[0] - 1e-9:
                heapq.heappush(todo, (bound, n, o, c, after))
    return best[1], best[2]


def _flow(counts: np.ndarray, feasible: np.ndarray, diff: np.ndarray, unit: np.ndarray, worth: float) -> tuple[np.ndarray, np.ndarray]:
    """Successive shortest paths at ``unit`` costs, up to those that cost ``worth``; only cells in ``feasible`` change."""
    rows, states = counts.shape
    change = np.zeros_like(counts)
    left = diff.copy()
    # node ids: states 0..S-1, rows S..S+R-1
    total = states + rows
    potential = np.zeros(total)
    # an arc whose flow would undo a change gives its cost back, so start potentials are 0 only while nothing has changed
    while True:
        sources = np.flatnonzero(left < 0)
        sinks = np.flatnonzero(left > 0)
        if not len(sources) or not len(sinks):
            break
        dist = np.full(total, np.inf)
        prev = np.full(total, -1)
        heap = []
        for s in sources:
            dist[s] = -potential[s]
            heap.append((dist[s], int(s)))
        base = min(d for d, _ in heap)
        for s in sources:
            dist[s] -= base
        heap = [(d - base, s) for d, s in heap]
        heapq.heapify(heap)
        done = np.zeros(total, bool)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < states:  # take a unit of state u out of some row
                ok = feasible[:, u] & (counts[:, u] + change[:, u] > 0)
                targets = np.flatnonzero(ok)
                cost = np.where(change[targets, u] > 0, -1.0, 1.0) * unit[targets, u]
                nodes = states + targets
            else:  # put it into another state of that row
                r = u - states
                targets = np.flatnonzero(feasible[r])
                cost = np.where(change[r, targets] < 0, -1.0, 1.0) * unit[r, targets]
                nodes = targets
            step = d + cost + potential[u] - potential[nodes]
            better = (step < dist[nodes] - 1e-9) & ~done[nodes]
            for v, x in zip(nodes[better], step[better]):
                dist[v], prev[v] = x, u
                heapq.heappush(heap, (float(x), int(v)))
        true = dist + potential + base
        end = sinks[np.argmin(true[sinks])]
        if not np.isfinite(dist[end]) or true[end] >= worth - 1e-9:
            break
        reached = np.isfinite(dist)
        potential[reached] += dist[reached]
        potential[~reached] += dist[reached].max() if reached.any() else 0.0
        path = [int(end)]
        while prev[path[-1]] >= 0:
            path.append(int(prev[path[-1]]))
        path.reverse()
        amount = min(int(-left[path[0]]), int(left[end]))
        for u, v in zip(path, path[1:]):
            if u < states:
                r = v - states
                amount = min(amount, int(counts[r, u] + change[r, u]), int(change[r, u]) if change[r, u] > 0 else amount)
            elif change[u - states, v] < 0:
                amount = min(amount, int(-change[u - states, v]))
        for u, v in zip(path, path[1:]):
            if u < states:
                change[v - states, u] -= amount
            else:
                change[u - states, v] += amount
        left[path[0]] += amount
        left[end] -= amount
    return counts + change, left


def objective(before: np.ndarray, after: np.ndarray, feasible: np.ndarray, left: np.ndarray, deviation: str = "absolute", spread_penalty: float = 0.0) -> float:
    """The weighted sum of changes, changed cells and slack that ``adjust`` minimises."""
    before = np.where(feasible, before, 0)
    change = np.abs(after - before)
    deviations = (unit_costs(before, feasible, deviation) * change)[feasible].sum()
    return float(before.shape[1] * (deviations + spread_penalty * int((change > 0).sum())) + int(feasible.sum()) * np.abs(left).sum())
