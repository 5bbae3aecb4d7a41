"""Solvers for user oracles: knapsack by branch and bound, supermodular choice by minimum cut, auction demand by assignment.

Each solves one agent and runs inside :class:`choicefold.operators.pricing.UserOracle`; Spark's tasks are the parallelism.
"""

from __future__ import annotations

from collections import deque

import numpy as np


def quadratic_knapsack(value: np.ndarray, pair: np.ndarray, weight: np.ndarray, capacity: float, most_nodes: int = 200_000) -> tuple[np.ndarray, float, float]:
    """argmax of ``value.b + b'Qb/2`` with ``weight.b <= capacity``; bundle, payoff and gap (0: exact).

    Depth first; the bound adds each open item's value with all positive couplings to what is taken or open, best by weight first.
    """
    m = len(value)
    order = np.argsort(-(value + np.maximum(pair, 0).sum(1) / 2))
    v, q, w = value[order], pair[np.ix_(order, order)], weight[order]
    best, best_b, nodes, open_bound = 0.0, np.zeros(m, bool), 0, 0.0
    up = np.maximum(q, 0)

    def bound(k: int, b: np.ndarray, worth: float, room: float) -> float:
        free = np.arange(k, m)
        gain = v[free] + q[np.ix_(free, np.flatnonzero(b))].sum(1) + up[np.ix_(free, free)].sum(1) / 2
        ok = (gain > 0) & (w[free] <= room)
        gain, load = gain[ok], w[free][ok]
        out = worth
        for i in np.argsort(-gain / np.maximum(load, 1e-12)):
            part = min(1.0, room / load[i]) if load[i] > 0 else 1.0
            out += part * gain[i]
            room -= part * load[i]
            if room <= 0:
                break
        return out

    stack = [(0, np.zeros(m, bool), 0.0, float(capacity))]
    while stack:
        k, b, worth, room = stack.pop()
        if worth > best + 1e-15:
            best, best_b = worth, b
        if k == m:
            continue
        top = bound(k, b, worth, room)
        if top <= best + 1e-12:
            continue
        nodes += 1
        if nodes > most_nodes:
            open_bound = max([top, *[bound(*s) if s[0] < m else s[2] for s in stack]])
            break
        stack.append((k + 1, b, worth, room))
        if w[k] <= room:
            c = b.copy()
            c[k] = True
            stack.append((k + 1, c, worth + v[k] + q[k] @ b, room - w[k]))
    out = np.zeros(m, bool)
    out[order] = best_b
    return out, float(best), max(0.0, open_bound - best)


class Flow:
    """Maximum flow by shortest augmenting levels, with integer capacities."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, cap: int, back: int = 0) -> None:
        for x, y, c in ((a, b, cap), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s], todo = 0, deque([s])
        while todo:
            x = todo.popleft()
            for e in self.out[x]:
                if self.cap[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    todo.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> list[bool]:
        """Which nodes the source still reaches once the flow is greatest."""
        while (level := self._levels(s))[t] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    push = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    x, path = s, []
                while at[x] < len(self.out[x]):
                    e = self.out[x][at[x]]
                    if self.cap[e] > 0 and level[self.to[e]] == level[x] + 1:
                        break
                    at[x] += 1
                if at[x] < len(self.out[x]):
                    path.append(self.out[x][at[x]])
                    x = self.to[path[-1]]
                elif path:
                    e = path.pop()
                    x = self.to[e ^ 1]
                    at[x] += 1
                else:
                    break
        return [v >= 0 for v in self._levels(s)]


def supermodular(value: np.ndarray, rows: np.ndarray, cols: np.ndarray, pair: np.ndarray, digits: int = 8) -> tuple[np.ndarray, float]:
    """argmax of ``value.b + sum pair b_i b_j`` with pair >= 0, by a minimum cut over integer-scaled capacities: the smallest best set."""
    if len(pair) and np.min(pair) < 0:
        raise ValueError("pairs must be at least 0")
    m = len(value)
    scale = 10.0**digits / max(1e-300, np.abs(value).max(initial=0), np.abs(pair).max(initial=0))
    unit = [int(round(float(x) * scale)) for x in value]
    f = Flow(m + 2)
    for i, j, p in zip(rows.tolist(), cols.tolist(), pair, strict=True):
        c = int(round(float(p) * scale))
        unit[i] += c  # i alone would gain c; without j it loses it again
        f.arc(i, j, c)
    for i, c in enumerate(unit):
        f.arc(m, i, c) if c > 0 else f.arc(i, m + 1, -c)
    b = np.array(f.run(m, m + 1)[:m])
    return b, float(value @ b + sum(p for i, j, p in zip(rows, cols, pair, strict=True) if b[i] and b[j]))


def assignment(worth: np.ndarray) -> tuple[np.ndarray, float]:
    """Best partial matching of rows to columns with non-negative worth: column of each row (-1: none) and the total."""
    n, m = worth.shape
    cost = -np.hstack([np.maximum(worth, 0), np.zeros((n, n))])
    u, v, of = np.zeros(n + 1), np.zeros(m + n + 1), np.zeros(m + n + 1, int)
    for i in range(1, n + 1):  # shortest augmenting path for each row; column 0 stands for its start
        of[0], j0 = i, 0
        least, used, way = np.full(m + n + 1, np.inf), np.zeros(m + n + 1, bool), np.zeros(m + n + 1, int)
        while True:
            used[j0] = True
            free = ~used
            free[0] = False
            reduced = np.full(m + n + 1, np.inf)
            reduced[1:] = cost[of[j0] - 1] - u[of[j0]] - v[1:]
            better = free & (reduced < least)
            least[better], way[better] = reduced[better], j0
            j1 = int(np.where(free, least, np.inf).argmin())
            delta = least[j1]
            u[of[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if of[j0] == 0:
                break
        while j0:
            of[j0] = of[way[j0]]
            j0 = way[j0]
    col = np.full(n, -1)
    for j in range(1, m + 1):
        if of[j] and worth[of[j] - 1, j - 1] > 0:
            col[of[j] - 1] = j - 1
    return col, float(sum(worth[i, c] for i, c in enumerate(col) if c >= 0))


def greedy_demand(worth: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, float]:
    """Demand of a bidder whose value of items is their best assignment to its slots (gross substitutes): items are added while one gains."""
    taken, total = np.zeros(worth.shape[1], bool), 0.0
    while True:
        best, at, value = 1e-12, -1, 0.0
        for j in np.flatnonzero(~taken):
            own = np.append(np.flatnonzero(taken), j)
            got = assignment(worth[:, own])[1]
            if got - total - price[j] > best:
                best, at, value = got - total - price[j], int(j), got
        if at < 0:
            return taken, total - float(price[taken].sum())
        taken[at], total = True, value
