"""The master program: minimise c.theta + sum_a w_a u_a over installed cuts u_a >= phi.theta + epsilon, u_a >= u_lower, theta in a box.

Slacks are taken out: what all agents' cuts are worth at theta is one convex function, so a linear program in theta and one total is
solved with tangents of it until value and tangents agree.  A tangent is the sum of each agent's highest cut there, so
its multiplier spreads over those cuts, which gives the dual of every installed cut.  A proximal penalty makes the program
of theta and total a quadratic one over the same tangents; its multipliers are those of the penalised program.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np

from .lp import GrowingLP
from .proximal import proximal

AGREE = 1e-11
KEEP_TANGENTS = 1500


@dataclass(frozen=True)
class CutRow:
    """One cut; identity is (agent_id, bundle_key)."""

    rep_id: int
    agent_id: int
    phi: np.ndarray = field(compare=False)
    epsilon: float = field(compare=False)
    bundle_key: bytes

    def __post_init__(self):
        phi = np.array(self.phi, float)
        if phi.ndim != 1 or not np.isfinite(phi).all() or not np.isfinite(self.epsilon):
            raise ValueError("a cut needs a finite vector phi and a finite epsilon")
        phi.flags.writeable = False
        object.__setattr__(self, "phi", phi)
        object.__setattr__(self, "epsilon", float(self.epsilon))

    @property
    def key(self) -> tuple[int, bytes]:
        return self.agent_id, self.bundle_key


@dataclass(frozen=True)
class CutReadings:
    """Dual and slack of installed cuts by (agent_id, bundle_key)."""

    dual: Mapping[tuple[int, bytes], float] | None
    slack: Mapping[tuple[int, bytes], float] | None


class Master:
    """``weight``: an agent's weight, as a number, a mapping or a function of its id. ``u_lower``: a number, or None for no lower bound."""

    def __init__(self, bounds: tuple, c, weight: float | Mapping[int, float] | Callable[[int], float] = 1.0, u_lower: float | None = 0.0):
        lower, upper = (np.array(b, float) for b in bounds)
        c = np.array(c, float)
        if not (lower.shape == upper.shape == c.shape and np.isfinite(c).all() and np.isfinite(lower).all() and np.isfinite(upper).all() and (lower <= upper).all()):
            raise ValueError("bounds and coefficients must be finite and of one length, lower at most upper")
        self.K, self.c, self.lower, self.upper, self.u_lower = len(c), c, lower, upper, u_lower
        self._weight = weight if callable(weight) else weight.__getitem__ if isinstance(weight, Mapping) else lambda a: weight
        self.rows: list[CutRow] = []
        self.known: set[tuple[int, bytes]] = set()
        self._dirty, self._lp = True, None
        self._theta, self._total = np.where(c >= 0, lower, upper), 0.0
        self._ref, self._penalty, self._reduced = np.zeros(self.K), 0.0, {}

    # -- cuts ---------------------------------------------------------------------------------------------------------

    @property
    def n_active_cuts(self) -> int:
        return len(self.rows)

    def add_cuts(self, rows: Iterable[CutRow]) -> int:
        """Installs cuts that aren't yet; how many were."""
        new = []
        for r in rows:
            if len(r.phi) != self.K:
                raise ValueError(f"a cut has {len(r.phi)} coefficients, not {self.K}")
            if r.key not in self.known:
                w = self._weight(r.agent_id)
                if not np.isfinite(w) or w < 0:
                    raise ValueError(f"weight {w} of agent {r.agent_id}")
                self.known.add(r.key)
                new.append(r)
        if new:
            self.rows += new
            self._arrays()
        return len(new)

    reinstall = add_cuts

    def extract_cuts(self) -> list[CutRow]:
        """Installed cuts in canonical order."""
        return sorted(self.rows, key=lambda r: (r.agent_id, r.bundle_key))

    def remove_cuts(self, keys: Iterable[tuple[int, bytes]]) -> int:
        gone = set(keys) & self.known
        if gone:
            self.rows = [r for r in self.rows if r.key not in gone]
            self.known -= gone
            self._lp = None
            self._arrays()
        return len(gone)

    def set_rhs(self, updates: Mapping[tuple[int, bytes], float]) -> None:
        """New epsilons by key; an unknown key is an error before any change."""
        if lost := set(updates) - self.known:
            raise KeyError(f"not installed: {sorted(lost)[:3]}")
        self.rows = [CutRow(r.rep_id, r.agent_id, r.phi, updates.get(r.key, r.epsilon), r.bundle_key) for r in self.rows]
        self._lp = None
        self._arrays()

    @property
    def penalty(self) -> float:
        """Weight of the proximal term that the next solve has; 0 for a linear program."""
        return self._penalty

    def set_penalty(self, ref, weight: float) -> None:
        """Adds ``weight |theta - ref|^2`` to the objective in place of any such term; a weight of 0 or less takes it out."""
        if not np.isfinite(weight):
            raise ValueError(f"weight {weight} of a penalty must be finite")
        if weight <= 0:
            self._dirty, self._penalty = self._dirty or self._penalty > 0, 0.0
            return
        ref = np.array(ref, float)
        if ref.shape != (self.K,) or not np.isfinite(ref).all():
            raise ValueError(f"a penalty needs {self.K} finite reference values")
        if weight != self._penalty or not np.array_equal(ref, self._ref):
            self._ref, self._penalty, self._dirty = ref, float(weight), True

    def _arrays(self) -> None:
        ids = np.array([r.agent_id for r in self.rows], np.int64)
        self.order = np.argsort(ids, kind="stable")
        ids = ids[self.order]
        self.phi = np.array([r.phi for r in self.rows], float).reshape(-1, self.K)[self.order]
        self.eps = np.array([r.epsilon for r in self.rows], float)[self.order]
        self.agents, self.first = np.unique(ids, return_index=True)
        self.of = np.searchsorted(self.agents, ids)
        self.w = np.array([self._weight(int(a)) for a in self.agents], float)
        self._dirty = True

    # -- solving ------------------------------------------------------------------------------------------------------

    def _highest(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """u of each agent with cuts, and its highest cut (the first of equals; -1 at the lower bound)."""
        v = self.phi @ theta + self.eps
        top = np.maximum.reduceat(v, self.first)
        at = np.full(len(self.agents), len(v))
        hit = np.flatnonzero(v == top[self.of])
        np.minimum.at(at, self.of[hit], hit)
        if self.u_lower is not None:
            at = np.where(top > self.u_lower, at, -1)
            top = np.maximum(top, self.u_lower)
        return top, at

    def _tangent(self, at: np.ndarray) -> tuple[np.ndarray, float]:
        on = at >= 0
        w = self.w[on]
        rest = float(self.w[~on].sum() * (self.u_lower or 0.0))
        return w @ self.phi[at[on]], float(w @ self.eps[at[on]]) + rest

    def solve(self) -> None:
        if not self._dirty:
            return
        self._dirty = False
        if self._penalty:
            self._solve_penalised()
            return
        if not self.rows:
            self._theta, self._total = np.where(self.c >= 0, self.lower, self.upper), 0.0
            self._lp = None
            return
        reach = np.abs(self.phi) @ np.maximum(np.abs(self.lower), np.abs(self.upper)) + np.abs(self.eps)
        most = float(self.w @ np.maximum.reduceat(reach, self.first)) + abs(self.u_lower or 0.0) * float(self.w.sum()) + 1.0
        low = float(self.w.sum()) * self.u_lower if self.u_lower is not None else -most
        # A tangent sums over all agents: the program is solved in units of their number, else rows of millions stand beside ones. A power of two rounds nothing.
        steep = float(self.w @ np.maximum.reduceat(np.abs(self.phi).max(1, initial=0.0), self.first))
        self._unit = 2.0 ** np.ceil(np.log2(max(1.0, steep, np.abs(self.c).max(initial=0.0))))
        self._lp = GrowingLP(np.append(self.c / self._unit, 1.0), np.append(self.lower, low / self._unit), np.append(self.upper, most / self._unit))
        self._on: list[np.ndarray] = []
        self._added(self._theta)
        before = None
        for _ in range(20_000):
            x = self._lp.solve()
            theta, total = x[:-1], float(x[-1]) * self._unit
            u, at = self._highest(theta)
            value = float(self.w @ u)
            if value - total <= AGREE * max(1.0, abs(value)) or (before is not None and np.array_equal(before, x)):
                break  # they agree, or the last tangent was within the program's own precision
            before = x.copy()
            self._added(theta, at)
            if len(self._on) > KEEP_TANGENTS:
                loose = self._lp.a @ x - self._lp.b
                mask = loose <= np.partition(loose, KEEP_TANGENTS // 2)[KEEP_TANGENTS // 2]
                self._on = [o for o, k in zip(self._on, mask, strict=True) if k]
                self._lp.keep(mask)
        else:
            raise ArithmeticError("tangents don't meet the value")
        self._lp.finish()
        self._theta = np.clip(self._lp.x[:-1], self.lower, self.upper)
        self._total = float(self.w @ self._highest(self._theta)[0])
        mult = self._lp.row_duals()
        self._pi = np.zeros(len(self.rows))
        for m, on in zip(mult, self._on, strict=True):
            if m > 0:
                own = on >= 0
                np.add.at(self._pi, on[own], m * self.w[own])

    def _solve_penalised(self) -> None:
        ref, weight, self._lp = self._ref, self._penalty, None
        x = np.clip(self._theta, self.lower, self.upper)
        if not self.rows:
            slope = self.c + 2 * weight * (np.clip(ref - self.c / (2 * weight), self.lower, self.upper) - ref)
            self._theta, self._total = np.clip(ref - self.c / (2 * weight), self.lower, self.upper), 0.0
            self._reduced = dict(enumerate(np.where((self._theta > self.lower) & (self._theta < self.upper), 0.0, slope).tolist()))
            return
        g, h, on, before = np.zeros((0, self.K)), np.zeros(0), [], None
        u, at = self._highest(x)
        for _ in range(20_000):
            if before is not None and float(self.w @ u) - total <= AGREE * max(1.0, abs(total)):
                break
            a, b = self._tangent(at)
            g, h, on = np.vstack([g, a]), np.append(h, b), [*on, at]
            x, total, share, cost = proximal(self.c, self.lower, self.upper, g, h, ref, weight, x)
            if before is not None and np.array_equal(before, x):
                break  # the last tangent was within the program's own precision
            before = x.copy()
            u, at = self._highest(x)
            if len(on) > KEEP_TANGENTS:
                used = share > 0
                g, h, share, on = g[used], h[used], share[used], [o for o, k in zip(on, used, strict=True) if k]
        else:
            raise ArithmeticError("tangents don't meet the value")
        self._theta, self._total = x, float(self.w @ self._highest(x)[0])
        self._reduced = dict(enumerate(cost.tolist()))
        self._pi = np.zeros(len(self.rows))
        for m, chosen in zip(share, on, strict=True):
            if m > 0:
                own = chosen >= 0
                np.add.at(self._pi, chosen[own], m * self.w[own])

    def _added(self, theta: np.ndarray, at: np.ndarray | None = None) -> None:
        at = self._highest(theta)[1] if at is None else at
        g, h = self._tangent(at)
        self._lp.add(np.append(-g / self._unit, 1.0), h / self._unit)
        self._on.append(at)

    # -- readings -----------------------------------------------------------------------------------------------------

    def theta(self) -> np.ndarray:
        self.solve()
        return self._theta.copy()

    def worth(self, theta: np.ndarray, total: float) -> float:
        """The objective at a theta where all u sum to ``total``."""
        return float(self.c @ theta) + total + self._penalty * float(((theta - self._ref) ** 2).sum())

    def objective(self) -> float:
        self.solve()
        return self.worth(self._theta, self._total)

    def u_values(self) -> dict[int, float]:
        """u of the agents that have cuts."""
        self.solve()
        if not self.rows:
            return {}
        return dict(zip(self.agents.tolist(), self._highest(self._theta)[0].tolist(), strict=True))

    def cut_readings(self) -> CutReadings:
        self.solve()
        if not self.rows:
            return CutReadings({}, {})
        u = self._highest(self._theta)[0]
        slack = np.maximum(0.0, u[self.of] - (self.phi @ self._theta + self.eps))
        keys = [self.rows[i].key for i in self.order]
        return CutReadings(dict(zip(keys, self._pi.tolist(), strict=True)), dict(zip(keys, slack.tolist(), strict=True)))

    def dual_values(self) -> dict[tuple[int, bytes], float]:
        return dict(self.cut_readings().dual)

    def bound_duals(self) -> dict[int, float]:
        """Reduced costs of theta at a bound, those that aren't zero."""
        self.solve()
        if self._penalty:
            return {k: v for k, v in self._reduced.items() if abs(v) > 1e-12}
        if self._lp is None:
            return {k: float(v) for k, v in enumerate(self.c) if v}
        return {k: v * self._unit for k, v in sorted(self._lp.bound_duals().items()) if k < self.K and abs(v * self._unit) > 1e-12}
