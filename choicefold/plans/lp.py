"""A small linear program whose rows only grow: minimise c.x over lower <= x <= upper and A x >= b.

Dual simplex on the constraints that are active at the vertex.  With n variables the working inverse is n by n
however many rows there are, and added rows leave the vertex dual feasible, so every solve starts from the last one.
"""

from __future__ import annotations

import numpy as np

PRIMAL, PIVOT = 1e-12, 1e-11
#: A violation of this relative size may stay when pivots don't move the vertex any more.
NOISE = 1e-9
REFRESH = 40


class GrowingLP:
    def __init__(self, c, lower, upper):
        self.c, self.lower, self.upper = (np.array(v, float) for v in (c, lower, upper))
        n = len(self.c)
        if not (np.isfinite(self.lower).all() and np.isfinite(self.upper).all() and (self.lower <= self.upper).all()):
            raise ValueError("bounds must be finite, lower at most upper")
        self.n = n
        self.a, self.b = np.zeros((0, n)), np.zeros(0)
        self.start()

    def start(self) -> None:
        """The corner of the box that the costs point to."""
        self.active = np.where(self.c >= 0, np.arange(self.n), self.n + np.arange(self.n))
        self._refresh()

    def add(self, rows, rhs) -> None:
        self.a, self.b = np.vstack([self.a, np.atleast_2d(rows)]), np.append(self.b, rhs)

    def keep(self, mask: np.ndarray) -> None:
        """Drop rows; one that is active makes the next solve start from a corner."""
        used = self.active[self.active >= 2 * self.n] - 2 * self.n
        lost = not mask[used].all()
        at = np.cumsum(mask) - 1
        self.a, self.b = self.a[mask], self.b[mask]
        if lost:
            self.start()
        else:
            self.active = np.where(self.active >= 2 * self.n, 2 * self.n + at[np.maximum(self.active - 2 * self.n, 0)], self.active)

    def _row(self, i: int) -> np.ndarray:
        if i >= 2 * self.n:
            return self.a[i - 2 * self.n]
        e = np.zeros(self.n)
        e[i % self.n] = 1.0 if i < self.n else -1.0
        return e

    def _rhs(self, i: int) -> float:
        return self.b[i - 2 * self.n] if i >= 2 * self.n else self.lower[i] if i < self.n else -self.upper[i - self.n]

    def _refresh(self) -> None:
        self.g = np.array([self._row(i) for i in self.active])
        self.inverse = np.linalg.inv(self.g)
        self.y = np.maximum(np.linalg.solve(self.g.T, self.c), 0)
        self._place()

    def _place(self) -> None:
        self.x = self.inverse @ np.array([self._rhs(i) for i in self.active])

    def solve(self, most: int = 100_000) -> np.ndarray:
        stalled = 0
        norms = np.maximum(1.0, np.abs(self.a).max(1, initial=0))
        for it in range(most):
            short = np.concatenate([self.lower - self.x, self.x - self.upper, (self.b - self.a @ self.x) / norms])
            short[self.active] = 0
            limit = PRIMAL * max(1.0, np.abs(self.x).max())
            if short.max() <= limit or (stalled > 10 * self.n + 100 and short.max() <= limit * NOISE / PRIMAL):
                return self.x
            p = int(np.flatnonzero(short > limit)[0]) if stalled > 5 * self.n + 50 else int(short.argmax())
            alpha = self.inverse.T @ self._row(p)
            can = np.flatnonzero(alpha > PIVOT)
            if not len(can):
                raise ArithmeticError("the rows contradict the box")
            ratio = self.y[can] / alpha[can]
            t = ratio.min()
            ties = can[ratio <= t + 1e-12 * max(1.0, t)]
            out = int(ties[self.active[ties].argmin()]) if stalled > 5 * self.n + 50 else int(ties[alpha[ties].argmax()])
            stalled = stalled + 1 if t <= 1e-14 else 0
            self.y = np.maximum(self.y - t * alpha, 0)
            self.y[out] = t
            self.active[out] = p
            if it % REFRESH == REFRESH - 1 or alpha[out] < 1e-7:
                self._refresh()
            else:
                self.g[out] = self._row(p)
                row = alpha.copy()
                row[out] -= 1.0
                # Inverse of G with one row replaced.
                self.inverse -= np.outer(self.inverse[:, out] / alpha[out], row)
                self._place()
        raise ArithmeticError("no end of pivots")

    def finish(self) -> None:
        """Clean numbers at the last vertex."""
        self._refresh()

    def row_duals(self) -> np.ndarray:
        out = np.zeros(len(self.b))
        own = self.active >= 2 * self.n
        out[self.active[own] - 2 * self.n] = self.y[own]
        return out

    def bound_duals(self) -> dict[int, float]:
        """Reduced costs of variables at a bound: positive at a lower one, negative at an upper one."""
        return {int(i % self.n): float(y if i < self.n else -y) for i, y in zip(self.active, self.y, strict=True) if i < 2 * self.n}
